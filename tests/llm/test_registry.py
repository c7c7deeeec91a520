"""The native queries and the URL filter give their SQL's rows; ten operators and the pipeline are registered."""

import os

import pytest

from quillspark.llm import registry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, DATA).toPandas()
    text = lambda f: sorted(map(tuple, f[sorted(want.columns)].astype(str).values))
    assert text(got) == text(want)
