"""Paragraph tables: the ordered, typed rows that every rule works on.

Columns: doc_id, idx, style, r (raw text), m (quotations masked), level (null body, 0 layout, 1-5 heading),
is_ref, page, para_on_page, is_list, indent, has_format, italic_ok, italic_excerpt. Order is (doc_id, idx),
never the physical order; all windows share one shuffle by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import QUOTE_MASK, has, java, lit, strip

# What a quotation, a list item, a year, a label and an end of sentence look like.
QUOTATION = r'“[^”]*?”|"[^"]*?"'
LIST_ITEM, PAREN_YEAR, SENTENCE_END = r"^[\d]+[.)]\s|^[-•*–]\s", r"\(\d{4}[a-z]?\)", r"[.!?]\s*$"
LABEL, REFERENCES_HEADING = r"^(?:Table|Figure)\s+\d+\s*$", r"^\s*references?\s*$"
LONGEST_HEADING = 200

COLUMNS = "doc_id idx style r m level is_ref page para_on_page is_list indent has_format italic_ok italic_excerpt".split()


def in_doc():
    """A document's paragraphs in order."""
    return Window.partitionBy("doc_id").orderBy("idx")


def so_far():
    """A document's paragraphs up to the current one."""
    return in_doc().rowsBetween(Window.unboundedPreceding, 0)


def mask(text: str) -> str:
    return f"regexp_replace({text}, {lit(java(QUOTATION))}, {lit(QUOTE_MASK)})"


def all_caps(text: str) -> str:
    """Has letters, and all of them are upper case."""
    letters = f"regexp_replace({text}, '\\\\P{{L}}', '')"
    return f"({letters} <> '' AND NOT {letters} RLIKE '[^\\\\p{{Lu}}]')"


def likely_heading(text: str) -> str:
    """A heading by its text alone (pasted text has no styles)."""
    one_line = f"instr({text}, '\\n') = 0 AND NOT {has(text, LIST_ITEM)} AND NOT {has(text, PAREN_YEAR)} AND length({text}) <= {LONGEST_HEADING}"
    return f"({one_line} AND ({all_caps(text)} OR NOT {has(text, SENTENCE_END)}))"


def from_text(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Paragraphs of pasted texts (doc_id, text); idx counts empty parts too, as the separator makes them."""
    parts = docs.selectExpr("doc_id", f"posexplode(split(coalesce(text, ''), {lit(separator)}, -1)) AS (idx, part)")
    rows = parts.selectExpr("doc_id", "idx", f"{strip('`part`')} AS r").filter("r <> ''")
    rows = rows.withColumn("label", F.expr(has("r", LABEL, "i")))
    title = f"coalesce(before_label, false) AND length(r) <= {LONGEST_HEADING} AND NOT {has('r', SENTENCE_END)} AND NOT {has('r', PAREN_YEAR)}"
    rows = rows.withColumn("before_label", F.lag("label").over(in_doc()))
    rows = rows.withColumn("level", F.expr(f"CASE WHEN label OR ({title}) THEN 0 WHEN {likely_heading('r')} THEN 1 END"))
    rows = rows.withColumn("para_on_page", F.sum(F.col("level").isNull().cast("int")).over(so_far()).cast("int"))
    return rows.selectExpr(
        "doc_id", "idx", "IF(level = 1, 'Heading 1', 'Normal') AS style", "r", f"{mask('r')} AS m", "level", "false AS is_ref", "1 AS page", "para_on_page", "false AS is_list", "cast(null AS int) AS indent", "false AS has_format", "cast(null AS boolean) AS italic_ok", "'' AS italic_excerpt"
    )


def split_pasted(texts: DataFrame) -> DataFrame:
    """doc_id, body, refs: a pasted text cut at its first line that is References; both trimmed."""
    lines = "split(text, '\\n')"
    at = f"array_position(transform({lines}, l -> {has('l', REFERENCES_HEADING, 'i')}), true)"
    body = f"IF({at} = 0, text, array_join(slice({lines}, 1, cast({at} AS int) - 1), '\\n'))"
    refs = f"IF({at} = 0, '', array_join(slice({lines}, cast({at} AS int) + 1, 1000000000), '\\n'))"
    return texts.selectExpr("doc_id", f"{strip(body)} AS body", f"{strip(refs)} AS refs")


def reference_text(paragraphs: DataFrame) -> DataFrame:
    """doc_id, refs: the reference entries of each document, one a line."""
    rows = paragraphs.filter("is_ref").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "r"))).alias("l"))
    return rows.selectExpr("doc_id", "array_join(l.r, '\\n') AS refs")
