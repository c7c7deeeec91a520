"""Findings of a stream of documents are those of the documents."""

from quillspark.operators import findings, paragraphs
from quillspark.streaming import ingest


def test_stream(spark, tmp_path):
    docs = [(n, f"The end result was given in trial {n}. It ended.") for n in range(6)]
    for k in range(3):
        spark.createDataFrame(docs[2 * k : 2 * k + 2], ingest.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), ingest.appended(str(tmp_path / "out")), files_a_batch=1)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = findings.findings(paragraphs.from_text(spark.createDataFrame(docs, ingest.SCHEMA)))
    key = lambda df: sorted((r.doc_id, r.rule_id, r.s) for r in df.collect())
    assert key(got) == key(want) and key(want)
