"""Exact dedup and secret scans, against plain Python."""

import hashlib
import random
import re

import pytest

from quillspark.llm import exact_dedup, secret_scan

SCHEMA = "doc_id long, text string, kept string, recipe int"  # clashing extra columns
LONG = " ".join(random.Random(1).choices("the next branch stops here and another bears fruit at dawn under green hills".split(), k=15000))
ROWS = [(1, "a b"), (2, "a\t\n b"), (3, None), (4, ""), (5, " "), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "x" + LONG), (2, "a  b"), (None, "a b"), (None, "only"), (10, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    got = exact_dedup.exact_groups(frame(spark, ROWS), bits).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    want = []
    for (i, _), n in zip(ROWS, norm):
        ids = [j for (j, _), m in zip(ROWS, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_groups_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_chunks_are_the_text(spark):
    from pyspark.sql import functions as F

    row = frame(spark, [(1, LONG)]).select(exact_dedup.chunks(F.col("text")).alias("c")).first()
    assert "".join(row.c) == LONG and len(row.c) > 20
    assert all(exact_dedup.MIN_CHUNK <= len(c) <= exact_dedup.MAX_CHUNK for c in row.c[:-1])
    moved = frame(spark, [(1, "new words " + LONG)]).select(exact_dedup.chunks(F.col("text")).alias("c")).first()
    assert len(set(row.c) & set(moved.c)) > len(row.c) // 2  # cuts follow the content


def base_spans(text):
    kinds = (
        ("assign", r"(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    out = []
    for n, (kind, p, g, least) in enumerate(kinds):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    (1, 'é password = "abcdef12" and PassWord:xyz'), (2, "token=token: abcdefgh"), (3, "AKIA" + "A" * 16 + " AKIA" + "B" * 15), (4, "f" * 24 + " " + "0" * 23), (5, None), (6, ""),
    (7, "my api_key: 'a.b-c=d' apikey=123456 APIKEY = /////////"), (None, "secret=0123456789abcdef0123456789abcdef"), (8, "🙂 secret : 0123456789abcdef0123456789abcdef"), (8, "passwd=longenough"),
    (2000, "secret=abcdefg" + " word" * 20000 + " token = zzzzzz"), (9, "pass word sec ret tok en"), (10, "-----BEGIN RSA PRIVATE KEY-----"),
]


def test_secret_spans(spark):
    got = secret_scan.secret_spans(frame(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    want = []
    for i, t in TEXTS:
        b = base_spans(t or "")
        want.append((i, *(sum(k == n for k, _, _ in b) for n in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    assert next(r for r in got if r.doc_id == 10).spans == "pem:0:31"


def test_secret_spans_empty(spark):
    assert secret_scan.secret_spans(frame(spark, [])).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q(r"[0-9a-f]{24,}") is None and q(r"ab") is None
    assert q(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert q(r"(?:abc|defg)x*") == ("or", ("abc", ("and", ("def", "efg"))))
    assert q(r"abc?d\d+efg") == ("and", (("or", (("and", ("abc", "bcd")), "abd")), "efg"))


def test_postings_are_bounded_and_right(spark):
    rows = [(i, "a token" if i % 2 else "none") for i in range(3000)]
    index = secret_scan.postings(frame(spark, rows).select("doc_id", "text"), ["tok"]).collect()
    assert all(len(r.doc_ids) <= secret_scan.BLOCK for r in index)
    assert sorted(d for r in index for d in r.doc_ids) == [i for i in range(3000) if i % 2]


def test_places_find_every_trigram_once(spark):
    rng = random.Random(12)
    trigrams = ["abc", "bca", "b.c", "-ab", "^]a", "\\\\b"]
    rows = [(i, "".join(rng.choices("abc.-^]\\", k=60))) for i in range(300)] + [(300, "ABC"), (301, ""), (302, "é🙂abcé")]
    got = {(d, r.trigram) for r in secret_scan.postings(frame(spark, rows).select("doc_id", "text"), trigrams).collect() for d in r.doc_ids}
    assert got == {(i, g) for i, t in rows for g in trigrams if g in t.lower()}
    whole = secret_scan.postings(frame(spark, rows).select("doc_id", "text")).collect()
    assert {(d, r.trigram) for r in whole for d in r.doc_ids} == {(i, t.lower()[k : k + 3]) for i, t in rows for k in range(len(t) - 2)}
    # A rule that comes later is looked up in the index of all trigrams.
    found = secret_scan.candidates(secret_scan.postings(frame(spark, rows).select("doc_id", "text")), {"new": secret_scan.trigram_query(r"\.-ab?c")}).collect()
    assert {r.doc_id for r in found} >= {i for i, t in rows if re.search(r"\.-ab?c", t)}


def test_redacted_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x password=abcdefgh y", 21, "a"), (2, "clean", 5, "b"), (3, None, None, "c")], "doc_id long, text string, n_chars long, __extra string")
    rows = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert rows[1].text == "x [SECRET] y" and rows[1].n_chars == 12
    assert rows[2].text == "clean" and rows[3].text is None and rows[3]["__extra"] == "c"
