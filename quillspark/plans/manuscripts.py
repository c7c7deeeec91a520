"""Manuscripts and bibliographies derived from the order tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.partitions import spread
from ..operators.paragraphs import COLUMNS, mask
from .templates import TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def of_family(family: str) -> list[tuple[int, str, str, str | None]]:
    """(number, rule, text, what is found or None) of a family's templates."""
    out = []
    for rule, text in TEMPLATES:
        if rule.startswith(family):
            hit = text.split("[[")[1].split("]]")[0] if "[[" in text else None
            out.append((len(out), rule, text.replace("[[", "").replace("]]", ""), hit))
    return out


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


#: One paragraph for each order: orders of a customer are a document.
PARAGRAPHS_SQL = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS idx, CAST(o_orderkey % {k} AS INTEGER) AS k FROM orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, those of a customer in one task."""
    return spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey")


def positions(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"), (F.col("o_orderkey") % k).cast("int").alias("k"))


def manuscripts(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """A paragraph table whose texts are a family's templates, with `target`: the rule each is about."""
    rows = of_family(family)
    texts = spark.createDataFrame([(k, rule, text) for k, rule, text, _ in rows], "k int, target string, r string")
    p = positions(spark, sf_dir, len(rows)).join(F.broadcast(texts), "k")  # one row per template
    have = {"style": "'Normal'", "m": mask("r"), "level": "cast(null AS int)", "is_ref": "false", "page": "1", "para_on_page": "idx + 1", "is_list": "false", "indent": "cast(null AS int)", "has_format": "false", "italic_ok": "cast(null AS boolean)", "italic_excerpt": "''"}
    return p.selectExpr(*[f"{have[c]} AS {c}" if c in have else c for c in COLUMNS], "target")
