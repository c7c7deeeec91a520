"""Document quality by co-training a text-content view and a page-metadata view.

Boosted trees of each view start from at most SAMPLE labelled rows. In each of ROUNDS rounds both views judge every
unlabelled row on the executors, either view labels those of which it is most sure, in the proportion of the labels,
and the other view learns from them: at most SHARE of the labelled rows, the surest of all unlabelled ones. Each view
is then calibrated on labelled rows that no tree has seen, a logistic fit on them weighs the two, and every whole
document is scored. Features are computed once, while texts are read, and stored as numbers.

Defined results: null text counts as empty, null metadata is a value of its own; without labels of both kinds
every document gets the labelled share of label 1 (1 without labels, so that nothing is rejected); a very long text is
read whole; of rows of which a view is equally sure those of least hash are taken; repeated rows each get their own,
equal result; an empty table gives an empty result; other columns are ignored by quality_scores and kept by accepted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, logit, sigmoid
from .common import settled, small, small_batches, stored, table
from .toxicity import sample

#: Labelled rows, at most; they are those of least hash.
SAMPLE = 12_000
ROUNDS = 3
#: Pseudo-labels in a round: at most this share of the labelled rows, and only beyond this certainty.
SHARE, CERTAIN = 0.1, 0.95
#: Documents with a lower score are rejected.
THRESHOLD = 0.5
HOLD = 5
#: Blocks in which the surest rows are looked for before they meet.
BLOCKS = 64
SLOTS = 24

_MARKS = b"#$%&*|!?.,;:-_/\\<>[]{}()=+~^@\"'"


def text_row(text: str) -> list[float]:
    """Features of the content alone."""
    words = text.split()
    n, raw = len(words), np.frombuffer(text.encode(), np.uint8)
    chars = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    capital = sum(map(str.isupper, words))
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    marked = [float(chars[c]) / size for c in _MARKS]
    ends = sum(not w[-1].isalnum() for w in words)
    letters = chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum()
    return [
        *marked, math.log1p(n), distinct / max(1, n), again / max(1, n), capital / max(1, n), float(sizes.mean()) if n else 0.0, float(sizes.std()) if n else 0.0, float(sizes.max(initial=0)), ends / max(1, n),
        float(letters) / size, float(chars[48:58].sum()) / size, float(chars[65:91].sum()) / size, len(set(lines)) / len(lines), n / len(lines), float(chars[32]) / size,
    ]


def _slot(value, slots: int) -> list[float]:
    out = [0.0] * slots
    out[zlib.crc32(repr(value).encode()) % slots] = 1.0
    return out


def meta_row(lang, source, n_chars) -> list[float]:
    """Features of what is known about the page, not of its text."""
    n = -1 if n_chars is None or n_chars != n_chars else int(n_chars)
    return [*_slot(lang, 8), *_slot(source, SLOTS), math.log1p(max(0, n)), float(n < 0)]


def _matrix(rows: list[list[float]]) -> np.ndarray:
    return np.array(rows, float) if rows else np.zeros((0, 1))


def _rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    none = [None] * len(frame)
    of = lambda c: [None if pd.isna(v) else v for v in frame[c]] if c in frame else none
    return _matrix([text_row(t or "") for t in of("text")]), _matrix([meta_row(*r) for r in zip(of("lang"), of("source"), of("n_chars"), strict=True)])


class Model:
    """Both views, their calibration and how they are weighed; `share` alone without labels of both kinds."""

    def __init__(self, share: float):
        self.share, self.views, self.steps, self.weights = share, None, None, None

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, of the metadata view, and of both."""
        if self.views is None:
            p = np.full(len(a), self.share)
            return p, p, p
        pa_, pb = (s.predict(v.predict(x)) for s, v, x in zip(self.steps, self.views, (a, b), strict=True))
        w = self.weights
        return pa_, pb, sigmoid(w[0] + w[1] * logit(pa_) + w[2] * logit(pb))


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias first) of a ridge logistic fit; the ridge pulls towards the mean of both views."""
    x = np.column_stack([np.ones(len(z)), z])
    start = np.array([0.0, 0.5, 0.5])
    w = start.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (p - y) + (w - start))
    return w


def co_train(xa, xb, y, hold, surest) -> Model:
    """hold: rows kept for calibration; surest(views, asked) gives the rows that the views label.

    surest is asked with both fitted views and, for each (teacher, label), how many rows it may label; it answers with
    the features (a, b) of the rows for each, and never gives a view a row twice.
    """
    model = Model(float(y.mean()) if len(y) else 1.0)
    if len(np.unique(y[~hold])) < 2 or len(np.unique(y[hold])) < 2:
        return model
    views = [(xa[~hold], y[~hold]), (xb[~hold], y[~hold])]
    share, quota = float(y.mean()), int(SHARE * (~hold).sum())
    asked = {(k, label): math.ceil(quota * (share if label else 1 - share)) for k in (0, 1) for label in (1, 0)}
    for r in range(ROUNDS + 1):
        fitted = [Boosted().fit(x, t) for x, t in views]
        if r == ROUNDS:
            break
        for (teacher, label), rows in surest(fitted, asked).items():
            other = 1 - teacher
            x, t = views[other]
            if len(rows[other]):
                views[other] = (np.vstack([x, rows[other]]), np.append(t, np.full(len(rows[other]), float(label))))
    model.views = fitted
    raw = [v.predict(x[hold]) for v, x in zip(fitted, (xa, xb), strict=True)]
    model.steps = [Isotonic().fit(p, y[hold]) for p in raw]
    model.weights = _logistic(np.column_stack([logit(s.predict(p)) for s, p in zip(model.steps, raw, strict=True)]), y[hold])
    return model


def features(docs: DataFrame) -> DataFrame:
    """doc_id, a, b: the features of both views, one row per row of docs; stored."""
    have = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    known = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *have)

    def run(batches):
        for batch in batches:
            a, b = _rows(batch.select(["text", *have]).to_pandas())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(a), _lists(b)], names=["doc_id", "a", "b"])

    return stored(known.mapInArrow(settled(run), "doc_id bigint, a array<float>, b array<float>"), "quality-features")


def _lists(x: np.ndarray) -> pa.Array:
    width = x.shape[1] if len(x) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.astype(np.float32).ravel()))


def _table(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 1))


def _surest(pool: DataFrame):
    """A surest() for co_train over all rows of pool: a, b, key (equal rows have one)."""
    taken: dict[int, set[int]] = {0: set(), 1: set()}  # keys that each view has been given: at most ROUNDS quotas of two labels

    def ask(views, asked):
        closed, most = {k: frozenset(v) for k, v in taken.items()}, max(asked.values())

        def run(batches):
            for b in batches:
                # Rows that repeat one another count once.
                keys, once = np.unique(b.column("key").to_numpy(), return_index=True)
                x = _table(b.column("a"))[once], _table(b.column("b"))[once]
                found = []
                for teacher, view in enumerate(views):
                    p = view.predict(x[teacher])
                    for label, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(sure >= CERTAIN)
                        at = at[[k not in closed[1 - teacher] for k in keys[at].tolist()]] if len(at) else at
                        at = at[np.argsort(-sure[at], kind="stable")[:most]]
                        found.append((keys[at], np.full(len(at), teacher, np.int32), np.full(len(at), label, np.int32), sure[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["key", "teacher", "label", "sure"])

        judged = pool.select("key", "a", "b").mapInArrow(settled(run), "key bigint, teacher int, label int, sure double").groupBy("teacher", "label", "key").agg(F.max("sure").alias("sure"))
        # The surest of each block, then of all: no more than BLOCKS times the quota meet in one task.
        order = [F.desc("sure"), F.xxhash64("key"), "key"]
        block = Window.partitionBy("teacher", "label", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(BLOCKS))).orderBy(*order)
        best = judged.withColumn("k", F.row_number().over(block)).filter(F.col("k") <= most)
        best = best.withColumn("k", F.row_number().over(Window.partitionBy("teacher", "label").orderBy(*order)))
        wanted = F.expr("CASE " + " ".join(f"WHEN teacher = {t} AND label = {v} THEN {n}" for (t, v), n in asked.items()) + " END")
        chosen = [(r["key"], r["teacher"], r["label"]) for r in best.filter(F.col("k") <= wanted).collect()]  # four quotas at most
        ids = pool.sparkSession.createDataFrame([(k,) for k in {k for k, _, _ in chosen}], "key bigint")
        rows = {r["key"]: (r["a"], r["b"]) for r in pool.join(F.broadcast(ids), "key").groupBy("key").agg(F.first("a").alias("a"), F.first("b").alias("b")).collect()} if chosen else {}
        out = {}
        for t, v in asked:
            mine = sorted(k for k, teacher, label in chosen if (teacher, label) == (t, v))
            taken[1 - t].update(mine)
            out[(t, v)] = tuple(_matrix([rows[k][side] for k in mine]) for side in (0, 1))
        return out

    return ask


def train(rows: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """rows as features() gives them."""
    labelled = sample(rows, labels, "quality", bound)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("known_id")).distinct()
    known = small(stored(known, "labelled-ids"))
    pool = rows.join(known, F.col("doc_id") == F.col("known_id"), "left_anti").withColumn("key", F.xxhash64("doc_id", "a", "b"))
    # At most `bound` rows of features reach the driver, in an order of their own.
    got = sorted(labelled.select("doc_id", "__q_y", "a", "b").collect(), key=lambda r: (r["doc_id"], r["__q_y"], r["a"]))
    y = np.array([r["__q_y"] for r in got])
    a, b = (_matrix([r[c] for r in got]) for c in "ab")
    hold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % HOLD == 0 for r in got], bool)
    return co_train(a, b, y, hold, _surest(stored(pool, "pool")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score_text, score_meta, score, accepted: one row per document."""
    rows = features(docs)
    model = train(rows, labels)

    def run(batches):
        for b in batches:
            scores = model.score(_table(b.column("a")), _table(b.column("b")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.float64()) for x in scores)], names=["doc_id", "score_text", "score_meta", "score"])

    scored = rows.mapInArrow(settled(run), "doc_id bigint, score_text double, score_meta double, score double")
    return scored.withColumn("accepted", F.col("score") >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are not rejected."""
    model = train(features(docs), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        a, b = _rows(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars}))
        return pd.Series(model.score(a.astype(np.float32), b.astype(np.float32))[2])

    of = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    return docs.filter(score(F.coalesce("text", F.lit("")), of("lang"), of("source"), of("n_chars")) >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
