"""Citations and bibliographies as relations, and the joins between them.

Text is read with curly quotes made plain. A citation's branch is the first of: exact match, year mismatch,
co-author only, substring of another surname, group prefix, missing. Citations and entries of a document meet in
one join, by doc_id, and are compared within its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import cut, has, java, lit, spans, strip

# How citations and entries look.
_NAME = r"[A-Za-z][A-Za-z0-9&.\'\-]+"
PARENTHETICAL = rf"\(({_NAME}(?:\s+{_NAME})*(?:\s*[,&]\s*{_NAME}(?:\s+{_NAME})*)*(?:\s+et\s+al\.?)?),?\s*(\d{{4}}[a-z]?)\)"
MULTIPLE = r"\(([^)]+(?:;[^)]+)+)\)"
ONE_OF_MULTIPLE = rf"^({_NAME}(?:\s+{_NAME})*(?:\s+et\s+al\.?)?),?\s*(\d{{4}}[a-z]?)"
_CAPITAL = r"[A-Z][A-Za-z\'\-]+(?:\s+[A-Z][A-Za-z\'\-]+)*(?:\s+et\s+al\.?)?"
NARRATIVE = rf"(?<![A-Za-z])({_CAPITAL}(?:\s+(?:and|&)\s+{_CAPITAL})*)\s+\((\d{{4}}[a-z]?)\)"
LOWER_GROUP = r"(?<![A-Za-z])([a-z][a-z0-9&.\'-]{1,12})\s+\((\d{4}[a-z]?)\)"
DISCOURSE = r"^(?:meanwhile|however|furthermore|moreover|additionally|therefore|thus|finally|recently|previously|notably|importantly|consequently|subsequently|alternatively|specifically|overall|collectively|indeed|similarly|as|conversely|nonetheless|nevertheless)\s+"
LOWER_STOP = ("and", "but", "data", "figure", "finding", "findings", "paper", "paragraph", "research", "result", "results", "section", "study", "table", "text", "this", "that", "these", "those")
GROUP_MARKS = r"\b(Association|Institute|University|Ministry|Department|Agency|Organization|Organisation|Committee|Council|Board|Office|Bureau|Commission|Foundation|Network|Group|Team|Consortium|Inc\.|Ltd\.|LLC|Corp\.?|Research|Center|Centre|Gartner|PwC|PWC|Deloitte|McKinsey|Forrester)\b"
ENTRY_NAME, ENTRY_YEAR = rf"^{_NAME}(?:\s+{_NAME})*", r"\((\d{4}[a-z]?)(?=[,\s)])"
SURNAMES = r"\b([A-Z][A-Za-z\'\-]+(?:\s+[A-Z][A-Za-z\'\-]+)*)\b"
CURLY_QUOTES, PLAIN_QUOTES = "’‘“”", "''\"\""
POSSESSIVE = "['’]s?$"
#: Citations that begin within so many characters of another are the same.
CLOSE = 3
BUCKETS = ("spelling_mismatch", "year_mismatch", "missing_reference", "co_author_only", "uncited_reference")


def plain_quotes(text: str) -> str:
    return f"translate({text}, '{CURLY_QUOTES}', {lit(PLAIN_QUOTES)})"


def surname(text: str) -> str:
    """A name for comparison: no end marks, no possessive, lower case."""
    bare = f"regexp_replace({strip(text)}, '[.,;]+$', '')"
    return f"lower(regexp_replace({bare}, {lit(POSSESSIVE)}, ''))"


#: What stands before the first comma of a part.
HEAD = "substring_index(p, ',', 1)"


def author_list(text: str) -> str:
    """Normalised surnames; the split at `and` needs no word boundary, so it also falls inside names."""
    bare = strip(f"regexp_replace({text}, {lit(java(r'\bet\s+al\.?', ''))}, '')")
    parts = f"split({bare}, {lit(java(r'\s*(?:&|and)\s*', 'i'))})"
    parts = f"filter(transform({parts}, p -> regexp_replace({strip('p')}, '[.,]+$', '')), p -> p <> '')"
    heads = f"filter(transform({parts}, p -> IF(instr(p, ',') > 0, {strip(HEAD)}, p)), p -> p <> '')"
    return f"transform({heads}, p -> {surname('p')})"


def year_base(year: str) -> str:
    return f"regexp_replace({year}, '[a-z]+$', '')"


def parsed(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """keys, nth, raw, authors, year, form, at: the citations of each text in the order of the passes."""
    t = texts.selectExpr(*keys, f"{plain_quotes(text)} AS t")
    one = "transform({spans}, f -> named_struct('raw', f.m, 'a', {a}, 'y', {y}, 'form', '{form}', 'at', f.s))"
    both, of = ("$1", "$2"), ("f.g", "f.h")
    single = one.format(spans=spans("t", PARENTHETICAL, "", *both), a=of[0], y=of[1], form="parenthetical")
    part = f"regexp_extract({strip('p')}, {lit(java(ONE_OF_MULTIPLE))}, "
    multi = f"""flatten(transform({spans('t', MULTIPLE, '', '$1')}, f -> transform(filter(split(f.g, ';'), p -> {part} 2) <> ''),
      p -> named_struct('raw', {strip('p')}, 'a', {part} 1), 'y', {part} 2), 'form', 'parenthetical', 'at', f.s))))"""
    cleaned = strip(f"regexp_replace({of[0]}, {lit(java(DISCOURSE, 'i'))}, '')")
    narrative = one.format(spans=spans("t", NARRATIVE, "", *both), a=cleaned, y=of[1], form="narrative")
    stop = ", ".join(lit(w) for w in LOWER_STOP)
    lower = one.format(spans=f"filter({spans('t', LOWER_GROUP, '', *both)}, f -> lower({of[0]}) NOT IN ({stop}))", a=of[0], y=of[1], form="lower")
    t = t.selectExpr(*keys, f"concat({single}, {multi}) AS fixed", f"concat({narrative}, {lower}) AS loose")
    # A later pass only adds what doesn't begin close to anything seen so far.
    apart = f"NOT exists(a, o -> abs(o.at - x.at) < {CLOSE})"
    t = t.selectExpr(*keys, f"posexplode(aggregate(loose, fixed, (a, x) -> IF({apart}, concat(a, array(x)), a))) AS (nth, c)")
    authors = f"IF(c.form = 'lower', array({surname('c.a')}), {author_list('c.a')})"
    return t.selectExpr(*keys, "nth", "c.raw AS raw", f"{authors} AS authors", "c.y AS year", "IF(c.form = 'lower', 'narrative', c.form) AS form", "c.at AS at")


def entries(bibliographies: DataFrame, text: str = "refs") -> DataFrame:
    """doc_id, line, raw, first_author, all_surnames, year, is_group: the entries of each bibliography."""
    lines = bibliographies.selectExpr("doc_id", f"posexplode(filter(transform(split({text}, '\\\\R'), l -> {strip('l')}), l -> l <> '')) AS (line, raw)")
    name = f"regexp_extract(raw, {lit(java(ENTRY_NAME))}, 0)"
    lines = lines.filter(f"NOT {has('raw', r'^\s*References?\s*$', 'i')}").selectExpr("doc_id", "line", "raw", f"{name} AS name").filter("name <> ''")
    cut_at_year = f"regexp_replace(raw, {lit(java(r'\(\d{4}[a-z]?\).*'))}, '')"
    found = f"transform(filter(regexp_extract_all({cut_at_year}, {lit(java(SURNAMES))}, 1), s -> length(s) > 2), s -> {surname('s')})"
    return lines.selectExpr("doc_id", "line", "raw", f"{surname('name')} AS first_author", f"{found} AS all_surnames", f"regexp_extract(raw, {lit(java(ENTRY_YEAR))}, 1) AS year", f"{has('name', GROUP_MARKS, 'i')} AS is_group")


_first_word = "coalesce(get(filter(split({x}, '(?U)\\\\s+'), w -> w <> ''), 0), '')"
_word_count = "size(filter(split({x}, '(?U)\\\\s+'), w -> w <> ''))"


def compared(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, rs (its entries), ms (its citations, each with the branch it takes): one row per document.

    cites as parsed() gives them, refs as entries() gives them. Both are read once and meet once, by doc_id; from then
    on all of a document is in one row, as it is in memory of whoever reads it.
    """
    c = cites.selectExpr("doc_id", "idx", "nth", "raw", "year", "coalesce(get(authors, 0), '') AS author", f"{year_base('year')} AS base")
    c = c.selectExpr("*", f"{_first_word.format(x='author')} AS head", f"{_word_count.format(x='author')} AS n_words")
    r = refs.selectExpr("doc_id", "line", "raw", "first_author", "all_surnames", "year", f"{year_base('year')} AS base", "is_group", f"{_first_word.format(x='first_author')} AS head", f"{_word_count.format(x='first_author')} AS n_words")
    packed = lambda df, first, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*first, *[x for x in df.columns if x != "doc_id" and x not in first]))).alias(name))
    docs = packed(c, ("idx", "nth"), "cs").join(packed(r, ("line",), "rs"), "doc_id", "full_outer")
    docs = docs.withColumns({"cs": F.coalesce("cs", F.array().cast(docs.schema["cs"].dataType)), "rs": F.coalesce("rs", F.array().cast(docs.schema["rs"].dataType))})
    same = "r.first_author = c.author"
    group = "r.is_group AND r.head <> '' AND r.head = c.head AND r.base = c.base AND c.n_words < r.n_words"
    branch = f"""CASE WHEN exists(rs, r -> {same} AND r.base = c.base) THEN 'exact' WHEN exists(rs, r -> {same}) THEN 'year_mismatch'
      WHEN exists(rs, r -> array_contains(r.all_surnames, c.author)) THEN 'co_author_only' WHEN exists(rs, r -> r.first_author <> c.author AND instr(r.first_author, c.author) > 0) THEN 'substring'
      WHEN exists(rs, r -> {group}) THEN 'group_prefix' ELSE 'missing' END"""
    kept = ", ".join(f"'{x}', c.{x}" for x in ("idx", "nth", "raw", "year", "author", "base"))
    docs = docs.selectExpr("doc_id", "rs", f"transform(cs, c -> named_struct('c', c, 'branch', {branch})) AS bs")
    years = f"IF(b.branch = 'year_mismatch', transform(filter(rs, r -> {same.replace('c.', 'b.c.')}), r -> r.base), null)"
    author = f"IF(b.branch = 'group_prefix', get(filter(rs, r -> {group.replace('c.', 'b.c.')}), 0).first_author, null)"
    return docs.selectExpr("doc_id", "rs", f"transform(bs, b -> named_struct({kept.replace('c.', 'b.c.')}, 'branch', b.branch, 'reference_years', {years}, 'group_author', {author})) AS ms")


def matched(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, idx, nth, raw, year, author, base, branch, reference_years (year mismatch), group_author (group prefix)."""
    return compared(cites, refs).selectExpr("doc_id", "inline(ms)")


#: The keys (first author, year) of the entries that a document's citations have matched.
_KEYS = """flatten(transform(ms, m -> CASE m.branch WHEN 'exact' THEN array(named_struct('a', m.author, 'y', m.base)) WHEN 'year_mismatch' THEN transform(m.reference_years, y -> named_struct('a', m.author, 'y', y))
  WHEN 'group_prefix' THEN array(named_struct('a', m.group_author, 'y', m.base)) ELSE cast(array() AS array<struct<a:string,y:string>>) END))"""
_UNCITED = f"transform(array({_KEYS}), k -> filter(rs, r -> NOT array_contains(k, named_struct('a', r.first_author, 'y', r.base))))[0]"


def _misspelt(threshold: int) -> str:
    """array of (idx, nth, raw, line, reference, author, first_author, distance): the first citation of each pair."""
    pair = "struct(least(x.author, x.first_author), greatest(x.author, x.first_author))"
    made = f"named_struct('idx', m.idx, 'nth', m.nth, 'raw', m.raw, 'line', r.line, 'reference', r.raw, 'author', m.author, 'first_author', r.first_author, 'distance', levenshtein(m.author, r.first_author, {threshold}))"
    near = f"flatten(transform(ms, m -> filter(transform(filter(rs, r -> r.base = m.base AND r.first_author <> m.author), r -> {made}), x -> x.distance BETWEEN 1 AND {threshold})))"
    return f"transform(array({near}), xs -> transform(array(transform(xs, x -> {pair})), ps -> filter(xs, (x, i) -> array_position(ps, {pair}) = i + 1))[0])[0]"


def uncited(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, line, raw, first_author, ...: entries whose key no citation has matched."""
    return compared(cites, refs).selectExpr("doc_id", f"inline({_UNCITED})")


def misspelt(cites: DataFrame, refs: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs of different first authors of one year within `threshold` edits: the first citation of each pair."""
    return compared(cites, refs).selectExpr("doc_id", f"inline({_misspelt(threshold)})")


ISSUE = {"bucket": "string", "idx": "int", "nth": "int", "line": "int", "citation": "string", "reference": "string", "distance": "int", "cited_year": "string", "reference_years": "array<string>", "severity": "string"}


def issues(cites: DataFrame, refs: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, bucket, idx, nth, line, citation, reference, distance, cited_year, reference_years, severity."""

    def shaped(of: str, bucket: str, **have: str) -> str:
        have = {"bucket": lit(bucket), **have}
        return f"transform({of}, x -> named_struct({', '.join(f"'{k}', cast({have.get(k, 'null')} AS {t})" for k, t in ISSUE.items())}))"

    taken = lambda *branches: f"filter(ms, m -> m.branch IN ({', '.join(map(lit, branches))}))"
    cite = {"idx": "x.idx", "nth": "x.nth", "citation": "x.raw", "severity": "'warning'"}
    parts = [
        shaped(_misspelt(threshold), BUCKETS[0], **cite, line="x.line", reference="substring(x.reference, 1, 100)", distance="x.distance"),
        shaped(taken("year_mismatch"), BUCKETS[1], **cite, cited_year="x.year", reference_years="x.reference_years"),
        shaped(taken("substring", "missing"), BUCKETS[2], **(cite | {"severity": "IF(x.branch = 'missing', 'error', 'warning')"})),
        shaped(taken("co_author_only"), BUCKETS[3], **cite),
        shaped(_UNCITED, BUCKETS[4], line="x.line", reference="substring(x.raw, 1, 100)", severity="'warning'"),
    ]
    return compared(cites, refs).selectExpr("doc_id", f"inline(concat({', '.join(parts)}))")


def checked(paragraphs: DataFrame, bibliographies: DataFrame, threshold: int = 2) -> DataFrame:
    """Issues of whole documents: every paragraph but the reference entries is read for citations."""
    return issues(parsed(paragraphs.filter("NOT is_ref"), "r"), entries(bibliographies), threshold)
