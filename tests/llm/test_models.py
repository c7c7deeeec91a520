"""Classifiers by held-out accuracy, near duplicates against brute force, and the whole pipeline."""

import random

import numpy as np
import pytest

from quillspark.llm import near_dedup, quality, toxicity
from quillspark.llm.boosting import Boosted, Isotonic


def prose(rng, n, odd=()):
    words = ["river", "town", "then", "stone", "blue", "walks", "over", "night", "the", "a", "of"]
    return " ".join(rng.choice(odd) if odd and rng.random() < 0.08 else rng.choice(words) for _ in range(n))


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = Boosted().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == (y[1500:] > 0.5)).mean() > 0.95
    step = Isotonic().fit(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(step.y) >= 0).all() and step.predict(np.array([0.25]))[0] == pytest.approx(0.5)


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    bad = ("loser", "idiot", "scum", "morons")
    rows = [(i, prose(rng, 60, bad if i % 5 == 0 else ()), i % 5 == 0) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5000, ""), (5000, ""), (5001, "x " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == 904 and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.notna() & (got.doc_id < 900)]
    assert (held.predicted == (held.doc_id % 5 == 0)).mean() > 0.97
    assert got[got.doc_id == 5000].score.nunique() == 1
    import zlib

    assert set(held.doc_id.astype(int)) == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        good = i % 4 > 0
        t = prose(rng, 80)
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "en", f"src{i % 3 + (0 if good else 3)}", len(t)))
    rows += [(None, None, None, None, None), (9000, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).toPandas()
    unseen = got[got.doc_id.notna() & (got.doc_id % 2 == 1) & (got.doc_id < 600)]
    assert (unseen.accepted == (unseen.doc_id % 4 > 0)).mean() > 0.98 and len(got) == 602
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got[got.accepted].doc_id.dropna().astype(int)) | ({None} if got[got.doc_id.isna()].accepted.any() else set())


def test_quality_without_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted(docs, none).count() == 1 and quality.accepted(docs.limit(0), none).count() == 0


def test_co_training_teaches_the_other_view():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 3000).astype(float)
    a, b = y[:, None] + rng.normal(0, 0.3, (3000, 2)), y[:, None] + rng.normal(0, 0.3, (3000, 2))
    hold = np.arange(60) % 3 == 0
    free = {0: np.ones(1940, bool), 1: np.ones(1940, bool)}

    def surest(views, asked):
        out = {}
        for (teacher, label), n in asked.items():
            p = views[teacher].predict((a, b)[teacher][60:2000])
            sure = np.where(free[1 - teacher], p if label else 1 - p, 0)
            rows = [k for k in np.argsort(-sure)[:n] if sure[k] >= quality.CERTAIN]
            free[1 - teacher][rows] = False
            out[(teacher, label)] = (a[60:2000][rows], b[60:2000][rows])
        return out

    m = quality.co_train(a[:60], b[:60], y[:60], hold, surest)
    assert ((m.score(a[2000:], b[2000:])[2] > 0.5) == (y[2000:] > 0.5)).mean() > 0.93


def test_the_surest_of_all_rows_are_labelled(spark):
    class View:
        def predict(self, x):
            return x[:, 0]

    rng = np.random.default_rng(5)
    values = rng.permutation(4000) / 4000
    rows = [(float(v), float(1 - v), n) for n, v in enumerate(values)] + [(0.9999, 0.0001, 10_000)] * 50  # a hot key
    pool = spark.createDataFrame(rows, "x double, z double, key long").selectExpr("array(cast(x AS float)) AS a", "array(cast(z AS float)) AS b", "key")
    ask = quality._surest(pool)
    asked = {(0, 1): 20, (0, 0): 10, (1, 1): 5, (1, 0): 7}
    first, second = ask([View(), View()], asked), ask([View(), View()], asked)
    for (teacher, label), n in asked.items():
        column = np.array([r[teacher] for r in rows[:4001]], np.float32)
        want = np.sort(column if label else 1 - column)[::-1]
        for got, part in ((first, want[:n]), (second, want[n : 2 * n])):  # no row comes twice
            x = got[(teacher, label)][teacher][:, 0]
            assert np.allclose(np.sort(x if label else 1 - x)[::-1], part, atol=1e-6)


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            s, t = sets[i], sets[j]
            if s == t or (s and t and len(s & t) >= 0.8 * len(s | t)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows, n = [], 0
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.randint(60, 160))
        for _ in range(rng.choice([1, 2, 40])):
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((n, " ".join(edited)))
            n += 1
    rng.shuffle(rows)
    return rows + [(5000, ""), (5001, None), (5002, "two words"), (5003, "Two  words"), (5004, "x " * 20000)]


def test_near_classes_are_the_brute_force_ones(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    together = [(i, j) for i in want for j in want if i < j and got[i] == got[j]]
    assert all(want[i] == want[j] for i, j in together)  # no class holds what isn't linked


def test_links_in_a_large_bucket_of_documents_below_the_bound(spark):
    own = lambda i, k: [f"w{i}x{j}" for j in range(k)]
    passage = own("p", 400)
    tails = [own(i, 56) for i in range(240)]
    for i in range(0, 60, 2):  # planted: 12 words more in common, 0.82
        tails[i + 1][:12] = tails[i][:12]
    rows = [(i, " ".join(passage + t)) for i, t in enumerate(tails)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 210


def test_repeated_lines_dont_part_similar_sets(spark):
    rows = []
    for i in range(150):
        own = [[f"w{i}{x}{j}" for j in range(k)] for x, k in (("a", 66), ("b", 30), ("c", 5), ("d", 5))]
        rows += [(2 * i, " ".join(own[0] + own[1] + own[1][:4] + own[2])), (2 * i + 1, " ".join(own[0] + own[1] * 50 + own[1][:4] + own[3]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_prefix_pairs_hold_every_similar_pair(spark):
    rng = np.random.default_rng(8)
    sets = {i: sorted({*range(int(rng.integers(20, 40))), *(1000 + rng.integers(0, 12, int(rng.integers(0, 9)))).tolist()}) for i in range(150)}
    frame = spark.createDataFrame(list(sets.items()), "rep long, sh array<long>")
    rest = spark.createDataFrame([(i, i % 40) for i in sets], "rep long, class long")
    got = {(r.a, r.b) for r in near_dedup.verified(near_dedup.prefix_pairs(rest, frame, 0.8), frame, 0.8).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and i % 40 != j % 40 and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.8}
    assert got == want and len(want) > 100


def test_near_classes_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "nothing like it at all here"), (2, "z")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "2"), ("None", "1"), ("None", "None")]
    assert near_dedup.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probminhash_estimates_the_similarity():
    rng = np.random.default_rng(6)
    common, own = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, (2, 50)).astype(np.uint64)
    a, b = (np.concatenate([common, o]) for o in own)
    s = near_dedup.signatures([(a, np.ones(450)), (b, np.ones(450)), (a[:1], np.ones(1))])
    assert abs((s[0] == s[1]).mean() - 400 / 500) < 0.12
    assert (s[2] == (a[0] & np.uint64(0xFFFFFFFF))).all()  # one shingle is first everywhere


def test_probminhash_follows_weights():
    e = np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hits = near_dedup.signatures([(near_dedup.mix(e + np.uint64(1000 * k)), np.array([9.0, 1.0])) for k in range(200)])
    first = np.array([near_dedup.mix(e + np.uint64(1000 * k))[0] & np.uint64(0xFFFFFFFF) for k in range(200)])
    assert abs((hits == first[:, None]).mean() - 0.9) < 0.03


def test_classes_of_edges(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in near_dedup.classes_of(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(7)
    good = [prose(rng, 80) for _ in range(300)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in good[i].split()), "en", "s", len(good[i]) + 160) for i in range(100)]
    more = [(2000, good[5], "en", "s", 400), (2001, good[6] + " tail", "en", "s", 405), (2002, prose(rng, 80) + " password=hunter2hunter2 " + prose(rng, 9), "en", "s", 410), (None, prose(rng, 50), None, None, None)]
    docs = spark.createDataFrame(rows + junk + more, "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    d = "file://" + tempfile.mkdtemp()
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1) for r in rows] + [(r[0], 0) for r in junk], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        if name != "packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert kept["quality"] == {r[0] for r in rows + more}
    assert kept["exact_dedup"] == kept["quality"] - {2000} and kept["near_dedup"] == kept["exact_dedup"] - {2001}
    assert kept["packing"] == kept["secret_scan"] == kept["near_dedup"]
    assert corpus_pipeline.run(spark, d).count() == now.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rep long, h long, k1 long, rank long, length long, score double, bands string, __q_id long, a double, x double"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, 1, 1, 1, 0.5, "b", 1, 0.5, 0.5) for i, t in rows], CLASHING)


def test_extra_columns_of_any_name(spark):
    from quillspark.llm import media, packing

    rng = random.Random(8)
    rows = [(i, prose(rng, 40)) for i in range(20)] + [(20, None), (21, ""), (22, "w " * 60_000), (3, "other words entirely " * 9)]
    docs, ids = clashing(spark, rows), sorted(i for i, _ in rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    for got in (near_dedup.near_classes(docs), toxicity.toxicity(docs, labels), quality.quality_scores(docs, labels), media.read_back(media.media_files(docs))):
        assert sorted(r.doc_id for r in got.collect()) == ids
    assert sorted({r.doc_id for r in packing.packed(docs).collect()}) == sorted(set(ids))


def test_rows_that_share_an_id_stay_apart(spark):
    rng = random.Random(9)
    a, b = prose(rng, 90), " ".join(f"b{k}" for k in range(90))
    rows = [(3, a), (7, a + " tail"), (7, b), (3, a + " end"), (9, b + " more"), (3, a)]
    got = sorted((r.doc_id, r.class_id, r.is_representative) for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # One text stands for the class of a; its row comes twice. The class of b is named by 7.
    assert [x[:2] for x in got] == [(3, 3), (3, 3), (3, 3), (7, 3), (7, 7), (9, 7)]
    assert sum(x[2] for x in got if x[1] == 7) == 1 and sum(x[2] for x in got if x[1] == 3) in (1, 2)


def test_scores_of_repeated_rows_and_tied_labels(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 40, ("loser", "idiot") if i % 4 == 0 else ())) for i in range(400)]
    docs = clashing(spark, rows + rows[:50])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(400)] * 2, "doc_id long, quality int, toxic int")
    for scored in (quality.quality_scores(docs, labels), toxicity.toxicity(docs, labels, 200)):
        got = {}
        for r in scored.collect():
            got.setdefault(r.doc_id, []).append(r.score)
        assert all(len(v) == (2 if i < 50 else 1) and len(set(v)) == 1 for i, v in got.items())
    # Twice the same sample and the same scores.
    again = [{r.doc_id: r.score for r in toxicity.toxicity(docs, labels, 200).collect()} for _ in range(2)]
    assert again[0] == again[1]


def test_pipeline_loses_no_row_that_shares_an_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, long = prose(rng, 90), " ".join(f"b{k}" for k in range(90)), " ".join(f"l{k}" for k in range(30_000))
    rows = [(3, a), (7, a + " tail"), (7, b), (8, b), (9, long), (9, long), (11, None), (12, ""), (None, a)]
    folder = f"file://{tmp_path}"
    clashing(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), now.schema)
    kept = sorted((str(r.doc_id), (r.text or "")[:9]) for r in now.collect())
    assert kept == sorted([("3", a[:9]), ("7", b[:9]), ("9", long[:9]), ("9", long[:9]), ("11", ""), ("None", a[:9])])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {3, 7, 9, 11, None} and sum(r.length for r in packed if r.doc_id == 9) > 60_000


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    clashing(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
