"""Helpers shared by the training-data operators: shared tables, size-checked joins, text reading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many ids (8 bytes each) may be broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000


#: Rows and bytes in an Arrow batch sent to Python, at most: whole texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, once the session sends Python small batches.

    This sets two settings of the session, as Spark has none for a plan, unless they differ from Spark's own defaults.
    """
    conf = df.sparkSession.conf
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if conf.get(key, usual) == usual:
            conf.set(key, value)
    return df


def settled(run):
    """A function of Arrow batches that gives memory it no longer needs back to the machine at the end of its task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process (tests, bench)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and the whole text, null as empty; clashing extra columns are gone."""
    return small_batches(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if a count proves them few; ids must be stored."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
