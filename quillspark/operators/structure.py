"""Rules over the order of paragraphs: headings, lists, the abstract, indents; and the structure of Word files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import has, java, lit, sentences, strip, words
from .paragraphs import COLUMNS, LABEL, LIST_ITEM, LONGEST_HEADING, PAREN_YEAR, REFERENCES_HEADING, SENTENCE_END, all_caps, in_doc, mask, so_far
from .rules import WARNING, Config

INDENT, INDENT_TOLERANCE, INDENT_WORDS, INDENT_SENTENCES = 720, 80, 25, 2
ABSTRACT_WORDS, LIST_WORDS = 250, 8
FINDING = "doc_id idx stage rank nth rule_id severity s e match excerpt replacement".split()
WORD = r"\b\w+\b"  # fixed value
_WORD_COUNT = f"regexp_count(r, {lit(java(WORD))})"


def _found(rows: DataFrame, rule_id: str, stage: int, excerpt: str = "substring(r, 1, 80)") -> DataFrame:
    return rows.selectExpr("doc_id", "idx", f"{stage} AS stage", "0 AS rank", "0 AS nth", f"'{rule_id}' AS rule_id", f"'{WARNING}' AS severity", "0 AS s", "0 AS e", "'' AS match", f"{excerpt} AS excerpt")


def skipped_levels(paragraphs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """HED001: a heading more than one level below the heading before it."""
    heads = paragraphs.filter("NOT is_ref AND level >= 1").withColumn("before", F.lag("level").over(in_doc()))
    return _found(heads.filter(f"{str(cfg.flag_skipped_levels).lower()} AND level > before + 1"), "HED001", 1)


def headings_without_body(paragraphs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """HED002: a heading whose next row (layout left out) is a heading of the same or a higher level."""
    rows = paragraphs.filter("is_ref OR level IS NULL OR level >= 1")
    rows = rows.withColumn("next", F.lead(F.expr("IF(is_ref, cast(null AS int), level)")).over(in_doc()))
    return _found(rows.filter(f"{str(cfg.flag_heading_without_body).lower()} AND NOT is_ref AND level >= 1 AND next <= level"), "HED002", 2)


def list_runs(paragraphs: DataFrame) -> DataFrame:
    """doc_id, idx (first item), items: runs of at least two list items; anything else ends a run."""
    rows = paragraphs.select("doc_id", "idx", "r", F.expr("is_list AND NOT is_ref").alias("item"))
    rows = rows.withColumn("run", F.sum((~F.col("item")).cast("int")).over(so_far())).filter("item")
    # A run is a stretch of one document, so it is no larger than a document.
    runs = rows.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "r"))).alias("l"))
    return runs.selectExpr("doc_id", "l[0].idx AS idx", f"filter(transform(l.r, x -> {strip('x')}), x -> x <> '') AS items").filter("size(items) >= 2")


def list_findings(paragraphs: DataFrame) -> DataFrame:
    """MEC029: a run of short items without end marks; MEC030: a run of mixed case or end marks."""
    marks, uppers = "transform(items, x -> IF(right(x, 1) IN ('.', ';', ':'), right(x, 1), ''))", "transform(items, x -> x RLIKE '^\\\\p{Lu}')"
    count = _WORD_COUNT.replace("(r,", "(x,")
    runs = list_runs(paragraphs).selectExpr("*", f"{marks} AS marks", f"{uppers} AS uppers", f"transform(items, x -> {count}) AS counts")
    shown = "substring(array_join(slice(items, 1, 3), '; '), 1, 120)"
    plain = runs.filter(f"forall(marks, x -> x = '') AND forall(counts, x -> x <= {LIST_WORDS})")
    mixed = runs.filter("size(array_distinct(uppers)) > 1 OR size(array_distinct(marks)) > 1")
    return _found(plain, "MEC029", 3, shown).union(_found(mixed, "MEC030", 3, shown))


def long_abstracts(paragraphs: DataFrame) -> DataFrame:
    """MEC016: more than 250 words between an Abstract paragraph and the next heading or layout row."""
    rows = paragraphs.withColumn("start", F.expr(f"lower({strip('r')}) = 'abstract'"))
    rows = rows.withColumn("open", F.max(F.col("start").cast("int")).over(so_far()))
    rows = rows.withColumn("closing", F.expr("open = 1 AND NOT start AND level IS NOT NULL"))
    rows = rows.withColumn("closed", F.max(F.col("closing").cast("int")).over(so_far())).filter("open = 1 AND closed = 0")
    inside = F.expr(f"IF(start OR is_ref, 0, {words('r')})")
    total = rows.groupBy("doc_id").agg(F.max(F.when(F.col("start"), F.col("idx"))).alias("idx"), F.sum(inside).alias("n"))
    return _found(total.filter(f"n > {ABSTRACT_WORDS}"), "MEC016", 0, "'(Abstract section)'")


def missing_indents(paragraphs: DataFrame) -> DataFrame:
    """MEC023: a body paragraph of some length whose first line isn't indented by half an inch."""
    body = f"has_format AND level IS NULL AND NOT is_ref AND NOT is_list AND {has('r', SENTENCE_END)} AND ({_WORD_COUNT} >= {INDENT_WORDS} OR {sentences('r')} >= {INDENT_SENTENCES})"
    return _found(paragraphs.filter(f"{body} AND (indent IS NULL OR abs(indent - {INDENT}) > {INDENT_TOLERANCE})"), "MEC023", 5)


# --- Word files ---

# Names of styles.
HEADING_STYLES = ("Heading 1", "Heading 2", "Heading 3", "Heading 4", "Heading 5")
LAYOUT_STYLES = "Title|Subtitle|Author|Date|TOC Heading|TOC 1|TOC 2|TOC 3|Caption|Figure Caption|Table Caption|Endnote Text|Footnote Text|Header|Footer|List Paragraph|List Bullet|List Number|Cover|Cover Page".split("|")
BLOCK_QUOTE_STYLES = "Quote|Intense Quote|Block Text|Block Quote|Blockquote".split("|")
BLOCK_QUOTE_INDENT = 720


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(lit(v) for v in values)})"


def word_level(text: str = "r") -> str:
    """The level of a Word paragraph by its style, its formatting and its text, the first that applies."""
    short = f"length({text}) <= {LONGEST_HEADING}"
    caps = f"instr({text}, '\\n') = 0 AND NOT {has(text, LIST_ITEM)} AND NOT {has(text, PAREN_YEAR)} AND {all_caps(text)} AND {short}"
    return f"""CASE WHEN {_in('style', HEADING_STYLES)} THEN cast(right(style, 1) AS int) WHEN {_in('style', LAYOUT_STYLES)} THEN 0
      WHEN {has(text, LABEL, 'i')} THEN 0 WHEN centered AND all_bold AND {short} THEN 1 WHEN {has(text, SENTENCE_END)} THEN null
      WHEN all_bold AND all_italic AND {short} THEN 3 WHEN all_bold AND {short} THEN 2 WHEN {caps} THEN 1
      WHEN {words(text)} <= 8 AND NOT {text} RLIKE '[.!?]' THEN 0 END"""


def classified(raw: DataFrame) -> DataFrame:
    """The paragraph table of Word files, from the rows of sources.docx.

    raw: doc_id, idx, style, text, in_table, page_break, numbered, left_indent, indent, centered, all_bold,
    all_italic, italic_ok, italic_excerpt.
    """
    rows = raw.withColumn("r", F.expr(strip("text")))
    before = in_doc().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("page", (F.coalesce(F.sum(F.col("page_break").cast("int")).over(before), F.lit(0)) + 1).cast("int"))
    rows = rows.filter("r <> '' AND NOT in_table")
    rows = rows.withColumn("level0", F.expr(f"IF(numbered, 0, {word_level()})"))
    rows = rows.withColumn("label", F.expr(has("r", LABEL, "i")))
    rows = rows.withColumn("refs_head", F.expr(f"level0 IS NOT NULL AND {has('r', REFERENCES_HEADING, 'i')}"))
    rows = rows.withColumn("in_refs", F.max(F.col("refs_head").cast("int")).over(so_far()))
    # A label's title: the next row, unless an entry, a block quotation or a page break comes between.
    carried = rows.withColumn("before_label", F.lag(F.expr("label AND NOT page_break AND NOT numbered")).over(in_doc()))
    title = f"coalesce(before_label, false) AND NOT numbered AND length(r) <= {LONGEST_HEADING} AND NOT {has('r', SENTENCE_END)} AND NOT {has('r', PAREN_YEAR)} AND NOT {has('r', LIST_ITEM)}"
    rows = carried.withColumn("level0", F.expr(f"IF({title}, 0, level0)"))
    rows = rows.withColumn("is_ref", F.expr("in_refs = 1 AND NOT refs_head AND level0 IS NULL"))
    rows = rows.filter(f"is_ref OR NOT ({_in('style', BLOCK_QUOTE_STYLES)} OR coalesce(left_indent, 0) >= {BLOCK_QUOTE_INDENT})")
    # Before the first heading of the text itself there are only title lines.
    explicit, real = F.expr(_in("style", HEADING_STYLES)), F.expr("level0 >= 1 AND NOT is_ref")
    rows = rows.withColumn("first_explicit", F.min(F.when(explicit, F.col("idx"))).over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("first_body", F.min(F.when(F.expr("level0 IS NULL AND NOT is_ref"), F.col("idx"))).over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("last_title", F.max(F.when(real & (F.col("idx") < F.col("first_body")), F.col("idx"))).over(Window.partitionBy("doc_id")))
    early = "level0 >= 1 AND NOT is_ref AND CASE WHEN first_explicit IS NOT NULL THEN idx < first_explicit ELSE idx < last_title END"
    rows = rows.withColumn("level", F.expr(f"IF({early}, 0, level0)"))
    counted = F.expr("(is_ref OR level IS NULL)").cast("int")
    rows = rows.withColumn("para_on_page", F.sum(counted).over(Window.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("m", F.expr(f"IF(is_ref, r, {mask('r')})"))
    return rows.withColumns({"is_list": F.col("numbered"), "has_format": F.lit(True)}).select(*COLUMNS)
