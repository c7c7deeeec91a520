"""Findings of documents as they land in a folder.

Each micro-batch has whole documents, so all windows are within the batch and no state is kept; a document that
lands twice is checked twice, and the sink's batch number tells repeats of a batch apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import findings, paragraphs
from ..operators.rules import Config

SCHEMA = "doc_id long, text string"


def stream(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], cfg: Config = Config(), files_a_batch: int = 100) -> StreamingQuery:
    """Start checking the parquet files (doc_id, text) of a folder; sink gets the findings of each batch."""
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def check(batch: DataFrame, number: int) -> None:
        sink(findings.findings(paragraphs.from_text(batch), cfg), number)

    return docs.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(found: DataFrame, number: int) -> None:
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write
