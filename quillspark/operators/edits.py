"""Screening of proposed sentence edits, the citation lock, text chunks and applying accepted edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import NONE, SENTENCE_END, java, lit, running, spans, strip, words
from . import citations

HEAVY = 0.40
WORDS_PAID, WORDS_TRIAL = 5000, 3000
SUGGESTION = "struct<original:string,revised:string,reason:string>"


#: An answer that is nothing but an array, and the array within other text.
WHOLE_ARRAY = r"(?s)^\s*\[.*\]\s*$"
INNER_ARRAY = r"(?s)\[.*\]"


def flat(text: str) -> str:
    return strip(f"regexp_replace({text}, {lit(java(r'\s+'))}, ' ')")


def payload(raw: str) -> str:
    """The suggestions of a model's answer: the objects of a JSON array, bare, fenced or within other text; else none.

    array<struct<original, revised, reason>>, an item a row; an item that isn't an object is null, and so is a field
    that isn't a string.
    """
    clean = f"regexp_replace({strip(raw)}, {lit(java(r'^```(?:json)?\s*|\s*```$', 'm'))}, '')"
    inner = f"regexp_extract({clean}, {lit(INNER_ARRAY)}, 0)"
    whole = f"try_parse_json(IF({clean} RLIKE {lit(WHOLE_ARRAY)}, {clean}, {inner}))"
    items = f"coalesce(try_variant_get({whole}, '$', 'array<variant>'), try_variant_get(try_parse_json({inner}), '$', 'array<variant>'), cast(array() AS array<variant>))"
    field = lambda c: f"IF(schema_of_variant(variant_get(v, '$.{c}')) = 'STRING', try_variant_get(v, '$.{c}', 'string'), null)"
    made = ", ".join(f"'{c}', {field(c)}" for c in ("original", "revised", "reason"))
    return f"transform({items}, v -> IF(startswith(schema_of_variant(v), 'OBJECT'), named_struct({made}), null))"


def cited(rows: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, raws: the distinct citation strings of a column in order of their place."""
    found = citations.parsed(rows, column, keys)
    listed = F.sort_array(F.collect_list(F.struct("at", "nth", "raw")))
    return found.groupBy(*keys).agg(F.array_distinct(listed["raw"]).alias(f"{column}_cites"))


def screened(answers: DataFrame) -> DataFrame:
    """doc_id, item, original, revised, reason, change_ratio, edit_type, status of each proposed edit.

    answers: doc_id, text (the chunk), answer (the model's). status is kept, not_found, citation_lock or skipped.
    """
    items = answers.selectExpr("doc_id", "text", f"posexplode({payload('answer')}) AS (item, x)").filter("x IS NOT NULL")
    items = items.selectExpr("doc_id", "item", "text", *[f"{strip(f'coalesce(x.{c}, {lit(str())})')} AS {c}" for c in ("original", "revised", "reason")])
    keys = ("doc_id", "item")
    rows = items.join(cited(items, "original", keys), list(keys), "left").join(cited(items, "revised", keys), list(keys), "left")
    none = "cast(array() AS array<string>)"
    old, new = f"coalesce(original_cites, {none})", f"coalesce(revised_cites, {none})"
    kept = f"forall({old}, c -> instr(revised, c) > 0) AND forall({new}, c -> array_contains({old}, c))"
    there = f"instr(text, original) > 0 OR instr({flat('text')}, {flat('original')}) > 0"
    ratio = "IF(original = revised, 0D, levenshtein(original, revised) / greatest(length(original), length(revised)))"
    status = f"CASE WHEN original = '' OR revised = '' OR original = revised THEN 'skipped' WHEN NOT ({there}) THEN 'not_found' WHEN NOT ({kept}) THEN 'citation_lock' ELSE 'kept' END"
    rows = rows.selectExpr("doc_id", "item", "original", "revised", "IF(reason = '', 'unspecified', reason) AS reason", f"{ratio} AS ratio", f"{status} AS status")
    return rows.selectExpr("doc_id", "item", "original", "revised", "reason", "bround(ratio, 3) AS change_ratio", f"IF(ratio > {HEAVY}, 'heavy', 'light') AS edit_type", "status")


def screen_counts(rows: DataFrame) -> DataFrame:
    """doc_id, n_kept, n_not_found, n_citation_lock: counters over all edits of a document."""
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("kept", "not_found", "citation_lock")])


def mock_answer(text: str) -> str:
    """What the offline stand-in for a model proposes: the first of three lines in the past passive, in the present."""
    lines = f"filter(transform(split({text}, '\\\\R'), l -> {strip('l')}), l -> l <> '')"
    hit = f"get(filter(slice({lines}, 1, 3), l -> instr(l, ' was ') > 0 OR instr(l, ' were ') > 0), 0)"
    made = f"transform(array({hit}), h -> array(named_struct('original', h, 'revised', replace(replace(h, ' was ', ' is '), ' were ', ' are '), 'reason', 'passive voice (mock)')))[0]"
    return f"IF({hit} IS NULL, '[]', to_json({made}))"


def applied(text: str, edits: str) -> str:
    """text after the edits (array of original, revised) in order, each at the first place it is found."""
    at = "instr(t, e.original)"
    return f"aggregate({edits}, {text}, (t, e) -> IF(e.original <> '' AND {at} > 0, concat(substring(t, 1, {at} - 1), e.revised, substring(t, {at} + length(e.original))), t))"


def estimate(text: str, cap: int) -> str:
    """Chunks that a text is charged for; 1 for an empty one."""
    return f"greatest(1, cast(ceil({words(text)} / {cap}D) AS int))"


def _sentence_chunks(unit: str, cap: int) -> str:
    """An oversize unit cut after sentences once a piece has at least cap words; citations stay whole."""
    ends = spans("u", SENTENCE_END)
    marks = f"IF(instr(u, '(') = 0, {NONE}, concat({spans('u', citations.PARENTHETICAL)}, {spans('u', citations.MULTIPLE)}, {spans('u', citations.NARRATIVE)}))"
    # Ends stand at white space, so words before each are a running sum over the sentences, and one more number is that of all.
    counts = running(f"concat(transform(split(u, {lit(java(SENTENCE_END))}, -1), p -> {words('p')}), array(0))")
    counted = f"zip_with({ends}, slice(w, 2, size(w) - 2), (f, n) -> named_struct('s', f.s, 'n', n))"
    free = f"filter({counted}, f -> NOT exists(k, c -> c.s <= f.s AND f.s < c.e))"
    step = f"(a, f) -> IF(w[size(w) - 1] - a.n > {cap} AND f.n - a.n >= {cap}, named_struct('n', f.n, 'cuts', concat(a.cuts, array(f.s))), a)"
    cuts = f"aggregate({free}, named_struct('n', 0, 'cuts', array(0)), {step}, a -> a.cuts)"
    pieces = f"transform(array({cuts}), x -> transform(x, (at, i) -> {strip('IF(i + 1 < size(x), substring(u, at + 1, x[i + 1] - at), substring(u, at + 1))')}))[0]"
    return f"transform(array({unit}), u -> transform(array({marks}), k -> transform(array({counts}), w -> {pieces})[0])[0])[0]"


def chunks(text: str, cap: int) -> str:
    """array<string>: a text in chunks of at most cap words where paragraphs allow, else cut after sentences."""
    units = f"transform(filter(split({text}, '(?<=\\\\n\\\\n)(?=[^\\\\n])'), u -> u <> ''), u -> named_struct('u', u, 'n', {words('u')}))"
    out = "IF(a.cur = '', a.out, concat(a.out, array(a.cur)))"
    large = f"named_struct('out', concat({out}, {_sentence_chunks(strip('x.u'), cap)}), 'cur', '', 'n', 0)"
    fresh = f"named_struct('out', {out}, 'cur', x.u, 'n', x.n)"
    more = f"named_struct('out', a.out, 'cur', concat(a.cur, x.u), 'n', a.n + x.n)"
    step = f"(a, x) -> CASE WHEN x.n > {cap} THEN {large} WHEN a.n + x.n > {cap} AND a.cur <> '' THEN {fresh} ELSE {more} END"
    fold = f"aggregate({units}, named_struct('out', cast(array() AS array<string>), 'cur', '', 'n', 0), {step}, a -> {out})"
    return f"IF({words(text)} <= {cap}, array({text}), filter(transform({fold}, c -> {strip('c')}), c -> c <> ''))"
