"""Rules over the entries of a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import folded, gated, has, lit, spans, strip
from .paragraphs import in_doc
from .rules import ERROR, WARNING

# The patterns that define the entry rules.
_ENTRY_AND = r"(?:[A-Z][a-z]+(?:[-\'][A-Z][a-z]+)?,\s+[A-Z]\.(?:\s+[A-Z]\.)?\s+)and\s+[A-Z]"
_ENTRY_AND_FULL = r"\b[A-Z][a-z]+,\s+[A-Z]\.\s+(?:[A-Z]\.\s+)?and\s+[A-Z][a-z]+,"
TITLE_SEGMENT = r"\(\d{4}[^)]*\)\.\s+(.+?)\.\s+"
TITLE_EXEMPT = ("I", "AI", "APA", "COVID", "USA", "US", "UK")
TITLE_SMALL = "a an and as at but by for from in into nor of on or the to with without".split()
AUTHOR_YEAR = r"^(.+?)\.\s*\((\d{4})([a-z]?)(?:,\s+[A-Za-z]+\s+\d+)?\)\."


def _title_case(r: str) -> str:
    """At least two capitals in a title where sentence case has none."""
    title = strip(f"regexp_extract({r}, {lit('(?Ud)' + TITLE_SEGMENT)}, 1)")
    word = spans("t", r"\b[A-Za-z][A-Za-z-]*\b")
    listed = lambda ws: ", ".join(lit(w) for w in ws)
    after_colon = "substring(t, 1, f.s) RLIKE ':(?U)\\\\s*$'"
    odd = f"(lower(f.m) IN ({listed(TITLE_SMALL)}) AND f.m <> lower(f.m)) OR (f.m RLIKE '^[A-Z]' AND substring(f.m, 2) <> upper(substring(f.m, 2)))"
    kept = f"filter({word}, (f, i) -> i > 0 AND NOT {after_colon} AND f.m NOT IN ({listed(TITLE_EXEMPT)}) AND ({odd}))"
    return f"exists(transform(array({title}), t -> size({kept})), n -> n >= 2)"


def _has(pattern: str, flags: str = "") -> str:
    return gated(has("r", pattern, flags), pattern, "low")


#: rule, severity, section, SQL over r and low, which is r folded().
ENTRY_RULES = (
    ("REF001", WARNING, "9.34", _has(r"http://doi\.org/|http://dx\.doi\.org/", "i")),
    ("REF002", WARNING, "9.34", _has(r"\bDOI:\s*10\.|\bdoi:\s*10\.", "i")),
    ("REF003", WARNING, "9.34", _has(r"\bRetrieved\s+from\s+https?://", "i")),
    ("REF004", WARNING, "9.34", _has(r"\bAccessed\s+from\s+https?://", "i")),
    ("REF005", WARNING, "9.34", _has(r"https?://\S+\.\s*$")),
    ("REF006", ERROR, "9.14", f"({_has(r'\(nd\)|\(n\.d\)|\(no\s+date\)|\(no-date\)', 'i')} OR {_has(r'\(N\.D\.\)')})"),
    ("REF007", WARNING, "9.8", f"({_has(_ENTRY_AND)} OR {_has(_ENTRY_AND_FULL)})"),
    ("REF008", ERROR, "9.8", _has(r"\bet\s+al\.?\b", "i")),
    ("REF009", WARNING, "9.19", _has(r"\((?:\d+(?:st|nd|rd|th)\s+)?edition\)", "i")),
    ("REF022", WARNING, "9.10", _has(r"\bEditors\b(?!\s+\()", "i")),
    ("REF010", WARNING, "9.29", _has(r"\b(Inc\.|Ltd\.|LLC|L\.L\.C\.|Co\.)\s", "i")),
    ("REF011", WARNING, "9.13", _has(r"\(\d{4}(?:[a-z])?\)\s+[A-Z]")),
    ("REF012", WARNING, "9.14", _has(r"\(in-press\)|\(In Press\)|\(In press\)")),
    ("REF013", WARNING, "9.25", _has(r"(\d+)\s+\((\d+)\)")),
    ("REF014", WARNING, "9.27", f"({_has(r'\barticle\s+[a-zA-Z0-9]+', 'i')} AND NOT {_has(r'\bArticle\s+[a-zA-Z0-9]+')})"),
    ("REF015", WARNING, "9.39", f"({_has(r'\bTrans\.\)', 'i')} AND NOT {_has(r'\(Original\s+work\s+published\s+\d{4}\)', 'i')})"),
    ("REF016", WARNING, "9.40", _has(r"\boriginally\s+published\b|\bfirst\s+published\b", "i")),
    ("REF017", WARNING, "6.27", _has(r"\b\d+\s*(?:kgs|cms|mgs|mls|lbs|hrs|mins|secs)\b", "i")),
    ("REF023", WARNING, "9.34", _has(r"\bISBN[:\s]|\bISSN[:\s]", "i")),
    ("REF024", WARNING, "9.19", _title_case("r")),
    ("REF025", ERROR, "8.9", _has(r"\bpersonal\s+communication\b", "i")),
    ("REF018", WARNING, "9.44", "key < before"),
    ("REF019", ERROR, "9.43", _has(r"^\s*Bibliography\s*$", "i")),
    ("REF020", WARNING, "9.43", _has(r"^\s*Reference\s*$")),
)


def sort_key(text: str) -> str:
    """The first author of an entry as it is alphabetised."""
    plain = f"regexp_replace({strip(text)}, '(?iU)^(?:The|A|An)\\\\s+', '')"
    name = f"regexp_extract({plain}, '^([A-Za-z\\\\-\\' ]+?)(?:,|\\\\()', 1)"
    return f"IF({plain} RLIKE '^[A-Za-z\\\\-\\' ]+?(?:,|\\\\()', regexp_replace(lower(trim({name})), '[ \\\\-\\']', ''), lower(substring({plain}, 1, 20)))"


def entry_findings(paragraphs: DataFrame) -> DataFrame:
    """One row per entry and rule; all rules of an entry are tested in one pass over its text."""
    rows = paragraphs.filter("is_ref").withColumns({"key": F.expr(sort_key("r")), "low": F.expr(folded("r"))})
    rows = rows.withColumn("before", F.lag("key").over(in_doc()))
    one = lambda n, rule: f"IF({rule[3]}, named_struct('rule_id', '{rule[0]}', 'severity', '{rule[1]}', 'rank', {n}), null)"
    rows = rows.selectExpr("doc_id", "idx", "r", f"inline(array_compact(array({', '.join(one(n, r) for n, r in enumerate(ENTRY_RULES))})))")
    found = rows.selectExpr("doc_id", "idx", "4 AS stage", "rank", "0 AS nth", "rule_id", "severity", "0 AS s", "0 AS e", "'' AS match", "substring(r, 1, 80) AS excerpt")
    return found.union(same_author_year(paragraphs)).union(plain_periodicals(paragraphs))


def same_author_year(paragraphs: DataFrame) -> DataFrame:
    """REF021: entries of one document with the same author key and year, whatever letter follows the year."""
    year = lambda n: f"regexp_extract({strip('r')}, {lit('(?Ud)' + AUTHOR_YEAR)}, {n})"
    rows = paragraphs.filter("is_ref").selectExpr("doc_id", "idx", f"{year(2)} AS year", f"{sort_key(year(1))} AS author").filter("year <> ''")
    same = Window.partitionBy("doc_id", "author", "year")
    rows = rows.withColumn("n", F.count("*").over(same)).withColumn("first", F.min("idx").over(same)).filter("n > 1")
    return rows.selectExpr("doc_id", "idx", "4 AS stage", "100 AS rank", "first AS nth", "'REF021' AS rule_id", f"'{WARNING}' AS severity", "0 AS s", "0 AS e", "'' AS match", "'' AS excerpt")


def plain_periodicals(paragraphs: DataFrame) -> DataFrame:
    """REF026: an entry whose periodical and volume are not in italics."""
    rows = paragraphs.filter("is_ref AND NOT italic_ok")
    return rows.selectExpr("doc_id", "idx", "4 AS stage", "101 AS rank", "0 AS nth", "'REF026' AS rule_id", f"'{WARNING}' AS severity", "0 AS s", "0 AS e", "'' AS match", "substring(IF(italic_excerpt = '', r, italic_excerpt), 1, 80) AS excerpt")
