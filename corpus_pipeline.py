"""From raw documents to packed training sequences, stage by stage; part of quillspark.llm, without which it can't be imported.

Each stage takes all that its predecessor kept: the quality classifier rejects documents, exact dedup keeps the
least doc_id of equal texts, near-dedup keeps the least doc_id of each class, the secret scan masks what it
finds, and packing lays the rest out in sequences. All stages but the last keep every column of their input.

Defined results: null text counts as empty; very long texts pass whole; a row is named by doc_id and text together, so
rows that share a doc_id are judged each by its own text, and rows that repeat one another whole share their fate;
rows with a null doc_id pass both dedup stages; of equal or similar texts the least doc_id stays; an empty table gives
an empty result; extra columns are kept up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, near_dedup, packing, quality, secret_scan
from quillspark.llm.common import fresh, small, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = exact_dedup.exact_groups(docs).filter("NOT kept AND doc_id IS NOT NULL")
    key, digest = fresh("id"), fresh("sha")
    gone = stored(gone.select(F.col("doc_id").alias(key), F.substring("text_sha256", 1, 16).alias(digest)), "copies")
    # Text and id together name a row: another text under the same id stays.
    sha = F.substring(F.sha2(exact_dedup.normalised(F.col("text")), 256), 1, 16)
    return docs.join(small(gone), (F.col("doc_id") == F.col(key)) & (sha == F.col(digest)), "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dedup.near_classes(docs).filter("NOT is_representative AND doc_id IS NOT NULL")
    key, digest = fresh("id"), fresh("hash")
    gone = stored(gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct(), "near-copies")
    # Again text and id name a row.
    here = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(small(gone), (F.col("doc_id") == F.col(key)) & (here == F.col(digest)), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: A trained classifier, near-duplicate classes and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
