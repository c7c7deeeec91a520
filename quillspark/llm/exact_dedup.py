"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own content says so, so an insertion moves few cuts. Every distinct
chunk is shuffled once (repeats are combined before the shuffle) to prove that its 64-bit hash stands for
that chunk alone; from then on a document is its ordered list of chunk identifiers, and lists are compared
instead of texts.

Defined results: null text counts as empty and empties are copies of each other; a very long text is many chunks; a
null doc_id is never the smallest unless a group has no other; repeated rows with the smallest doc_id are all kept; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_texts, stored

#: A chunk has at least MIN_CHUNK characters (the last may be shorter) and at most MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: A cut is between a blank with one of these letters before it and one of those after it.
CUT = r"(?<=[nrst] )(?=[a-h])"
SPACES = r"[\x20\x09-\x0D]+"
HASH_BITS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(norm: Column) -> Column:
    """Ordered chunks of a text; their concatenation is the text."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{CUT}|\z)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def chunk_hash(chunk: Column, bits: int = HASH_BITS) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def chunk_store(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """h, chunk: every distinct chunk once."""
    cut = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    return cut.select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()


def shared_hashes(store: DataFrame) -> DataFrame:
    """h of the hashes that stand for more than one chunk."""
    return store.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def recipes(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, text_sha256, recipe: array of verified chunk identifiers (hash, rank among its chunks)."""
    docs = keyed_texts(docs)
    store = chunk_store(docs, bits)
    clashes = stored(shared_hashes(store), "clashes")
    norm = normalised(F.col("text"))
    plain = docs.select("doc_id", F.sha2(norm, 256).alias("text_sha256"), F.transform(chunks(norm), lambda c: chunk_hash(c, bits)).alias("recipe"))
    if clashes.isEmpty():
        return plain
    # Hashes that stand for several chunks get a rank; only documents that hold one are taken apart.
    ranks = store.join(clashes, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("chunk")).alias("same"))
    parts = docs.select("doc_id", F.sha2(norm, 256).alias("text_sha256"), F.posexplode_outer(chunks(norm)).alias("pos", "chunk"))
    parts = parts.withColumn("h", chunk_hash(F.col("chunk"), bits)).distinct()
    parts = parts.join(ranks, "h", "left").withColumn("rank", F.coalesce(F.array_position("same", F.col("chunk")), F.lit(0)).cast("long"))
    listed = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "h", "rank"))))
    redone = parts.groupBy("doc_id", "text_sha256").agg(F.flatten(F.transform(listed, lambda x: F.array(x["h"], x["rank"]))).alias("recipe"))
    again = redone.select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__s"), F.col("recipe").alias("__r"))
    out = plain.join(again, plain["doc_id"].eqNullSafe(again["__d"]) & (plain["text_sha256"] == again["__s"]))
    return out.select("doc_id", "text_sha256", F.col("__r").alias("recipe"))


def exact_groups(docs: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    listed = stored(recipes(docs, bits).withColumn("n_chunks", F.size("recipe")), "recipes")
    groups = listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # The second key makes both sides exchanges of the join, which AQE may split where a group is hot.
    groups = groups.filter("group_size > 1").withColumn("n_chunks", F.size("recipe"))
    out = listed.join(groups, ["recipe", "n_chunks"], "left")
    lone = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")))
    return out.select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast(T.LongType()).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
