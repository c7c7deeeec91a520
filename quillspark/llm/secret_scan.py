"""Secret scans through a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean query over trigrams is derived: a text that matches must hold these
trigrams. The documents' postings for the queried trigrams are kept in blocks of BLOCK document ids, so a
list is never longer than that however common its trigram; lists are intersected and united block by block,
and only the candidates are verified with the regex. A rule whose regex has no mandatory trigram scans every
text while it is read. Candidates that a count proves few are broadcast to the scan; more of them meet the
texts in an ordinary shuffled join. The index of the query holds the trigrams that its rules ask for; without a list
of trigrams it holds them all, may be stored, and answers the queries of rules that come later.

Defined results: null text counts as empty; a document with a null doc_id can't be in the index, so every
rule scans it; a very long text is scanned whole, in time proportional to its length; spans that begin at one place
stand in the order of the rules; repeated rows each get their own result; an empty table gives an empty result; columns
other than doc_id and text are ignored by secret_spans and kept by redacted, whatever their names.
"""

from __future__ import annotations

import re
from re import _constants as rc
from re import _parser as rp
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import spans
from .common import fresh, keyed_texts, small, stored, table

#: Document ids in a block of postings.
BLOCK = 1024
#: A run of alternatives is expanded into at most so many strings.
MOST_STRINGS = 64
MASK = "[SECRET]"


class Rule(NamedTuple):
    """A match counts if its group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # Runs of a class with a least length: the same spans as the open run followed by a length test.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
)


# --- Boolean trigram queries: None (always true), a trigram, ("and", parts) or ("or", parts) ---


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return None if None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str):
    return _all(s[i : i + 3] for i in range(len(s) - 2))


def _exact(node) -> set[str] | None:
    """The lower-cased strings that a node stands for, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _exact_run(arg[-1])
    if op is rc.BRANCH:
        sides = [_exact_run(x) for x in arg[1]]
        return set().union(*sides) if None not in sides else None
    if op is rc.MAX_REPEAT and arg[1] <= 3:
        one = _exact_run(arg[2])
        if one is None:
            return None
        found, now = set(), {""}
        for n in range(int(arg[1]) + 1):
            found |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
        return found
    return None


def _exact_run(nodes) -> set[str] | None:
    run = {""}
    for node in nodes:
        e = _exact(node)
        if e is None or len(run) * len(e) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in e}
    return run


def _query(nodes):
    """What every match of a sequence of nodes must hold."""
    parts, run = [], {""}

    def flush():
        nonlocal run
        parts.append(_any([_of_string(s) for s in sorted(run)]))
        run = {""}

    for node in nodes:
        e, (op, arg) = _exact(node), node
        if e is not None and len(e) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in e}
            continue
        flush()
        if e is not None and len(e) <= MOST_STRINGS:
            run = e
        elif op is rc.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is rc.BRANCH:
            parts.append(_any([_query(x) for x in arg[1]]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
    flush()
    return _all(parts)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex over lower-cased text; None if it has no mandatory trigram."""
    return _query(rp.parse(pattern))


def trigrams_of(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- index, candidates ---


def places(trigrams: list[str] | None) -> str:
    """A regex that matches, without taking anything, wherever one of the trigrams begins (any, without a list); its group 1.

    One pass finds all of them: alternatives that begin alike share their first character.
    """
    if trigrams is None:
        return r"(?s)(?![\uDC00-\uDFFF])(?=(...))"  # never from the second half of a character
    heads: dict[str, list[str]] = {}
    for g in sorted(trigrams):
        heads.setdefault(g[0], []).append(g[1:])
    inner = "|".join(f"{re.escape(h)}(?:{'|'.join(map(re.escape, rest))})" for h, rest in heads.items())
    first = "".join(map(re.escape, heads))
    return f"(?=[{first}])(?=({inner}))"


def postings(docs: DataFrame, trigrams: list[str] | None = None) -> DataFrame:
    """block, trigram, doc_ids (ascending, at most BLOCK of them): which documents hold a trigram; all trigrams without a list."""
    low = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    pairs = low.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(places(trigrams)), F.lit(1)))).alias("trigram"))
    block = F.floor(F.col("doc_id") / BLOCK).alias("block")
    return pairs.groupBy(block, "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def _lists(query) -> Column:
    """The query's document ids in a block, from the map `lists` of its postings."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("lists", F.lit(query)), F.array().cast("array<bigint>"))
    out, join = None, F.array_intersect if query[0] == "and" else F.array_union
    for part in query[1]:
        out = _lists(part) if out is None else join(out, _lists(part))
    return out


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """doc_id, kinds: the rules whose query a document satisfies."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "doc_ids"))).alias("lists"))
    named = lambda k: lambda d: F.struct(d.alias("doc_id"), F.lit(k).alias("kind"))
    each = F.flatten(F.array(*[F.transform(_lists(q), named(k)) for k, q in queries.items()]))
    return blocks.select(F.inline(each)).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


# --- verification ---


SPAN = "array<struct<start:int,number:int,end:int>>"


def spans_of(text: str, rule: Rule, number: int) -> str:
    """SQL: array of (start, number, end) of a rule's counted matches, in code points, end exclusive."""
    found = spans(text, rule.pattern, "", f"${rule.group}" if rule.group else "")
    return f"transform(filter({found}, f -> length({'f.g' if rule.group else 'f.m'}) >= {rule.least}), f -> named_struct('start', f.s, 'number', {number}, 'end', f.e))"


def with_spans(docs: DataFrame, name: str, rules=RULES) -> DataFrame:
    """docs with a column `name`: array of (start, number, end) by start, then rule; docs needs doc_id and text."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    key, kinds = fresh("id"), fresh("kinds")
    if indexed:
        index = postings(keyed_texts(docs), sorted(set().union(*map(trigrams_of, indexed.values()))))
        found = stored(candidates(index, indexed), "secret-candidates")
        docs = docs.join(small(found.select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds))), F.col("doc_id") == F.col(key), "left")
    else:
        docs = docs.withColumns({key: F.lit(None), kinds: F.array().cast("array<string>")})
    parts = []
    for n, rule in enumerate(rules):
        part = spans_of("coalesce(text, '')", rule, n)
        if rule.kind in indexed:
            part = f"IF(doc_id IS NULL OR coalesce(array_contains({kinds}, '{rule.kind}'), false), {part}, cast(array() AS {SPAN}))"
        parts.append(part)
    return docs.withColumn(name, F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(key, kinds)


def _named(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["number"]], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, one count per base rule, base_sha256, spans, one row per document."""
    rows = with_spans(keyed_texts(docs), "__spans", rules)
    base = [n for n, r in enumerate(rules) if r.base]
    of = lambda n: F.size(F.filter("__spans", lambda s: s["number"] == n)).cast("long")
    counts = [of(n).alias(f"n_{rules[n].kind}") for n in base]
    only_base = F.filter("__spans", lambda s: s["number"].isin(base))
    return rows.select("doc_id", *counts, F.sha2(_named(only_base, rules), 256).alias("base_sha256"), _named(F.col("__spans"), rules).alias("spans"))


def redacted(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with MASK in place of every secret (overlapping spans: one mask) and n_chars, if there, set anew."""
    columns, kinds = docs.columns, dict(docs.dtypes)
    found, masked = fresh("spans"), fresh("text")
    rows = with_spans(docs, found, rules)
    text, start = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size(found) > 0
    rows = rows.withColumn(masked, F.when(hit, clean).otherwise(text))
    new = {"text": F.col(masked)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(hit, F.length(masked).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _oracle_kind(n: int, rule: Rule, least: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {n} AS n, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (
  SELECT doc_id, i, m, g, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT doc_id, gaps, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g
    FROM documents WHERE regexp_matches(text, '{p}')))) WHERE length(g[i]) >= {least}"""


ORACLE = f"""
WITH hits AS ({" UNION ALL ".join(_oracle_kind(n, r, r.least) for n, r in enumerate(RULES))}),
per AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
  coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, n) FILTER (n < 3), '') AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, n) AS spans FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)
"""
