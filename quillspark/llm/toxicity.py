"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

From at most SAMPLE labelled rows outside the held-out quarter a lexicon is learned (words and word stems
whose document frequency is much higher among toxic rows; two folds, each counted without the other), then
trees over lexicon densities, nearness to second-person words, capitals, punctuation and obfuscation rates.
Out-of-fold predictions calibrate the trees. Every whole text is then scored while it is read.

Defined results: null text counts as empty and gets the score of a text without any sign; a very long text is read
whole; without labels of both kinds every score is the labelled share of label 1 (0 without labels); of labelled rows
with equal hashes the least doc_id is sampled first; a null doc_id is not held out; repeated rows each get their own,
equal result; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, out_of_fold
from .common import keyed_texts, settled, stored, table

#: Labelled rows to learn from, at most; they are those of least hash.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Lexicon: letters of a stem, least toxic rows with an entry, least log odds.
STEM, LEAST_ROWS, LEAST_ODDS = 5, 4, 2.0
#: Words on either side that are near.
NEAR = 4
MOST_TOKENS = 300_000

SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya thou tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer ti tus usted ustedes vosotros vos".split())
_EDGE = "\"'.,;:!?()[]{}<>«»„“”‘’¡¿*#$%&|-_~`^+=/\\"
_LEET = str.maketrans("013457@$!|", "oieastasii")
_INNER = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|(\w)\1{3,}")
WORD, STEMMED, SECOND, MASKED, ODD, CAPITAL, LOUD = (1 << k for k in range(7))
FEATURES = 24


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Reader:
    """Features of texts under a lexicon {entry: log odds}; stems are entries that end with '*'."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.codes: dict[tuple[int, float], int] = {(0, 0.0): 0}
        self.bits, self.odds = [0], [0.0]
        self.memory: dict[str, int] = {}

    def _code(self, token: str) -> int:
        core = token.strip(_EDGE)
        low = core.lower()
        bits, odds = 0, 0.0
        if low:
            found = self.lexicon.get(low)
            if found:
                bits, odds = WORD, found
            elif len(low) > STEM and (found := self.lexicon.get(low[:STEM] + "*")):
                bits, odds = STEMMED, found
            if low in SECOND_PERSON:
                bits |= SECOND
            if not low.isalpha():
                plain = re.sub(r"[^\w]|_", "", low.translate(_LEET))
                if not bits & WORD and plain != low and (found := self.lexicon.get(plain)):
                    bits, odds = bits | MASKED, max(odds, found)
                if _INNER.search(core):
                    bits |= ODD
            if len(core) > 1 and core.isupper():
                bits |= CAPITAL
        if "!" in token or "?" in token:
            bits |= LOUD
        key = (bits, odds)
        if key not in self.codes:
            self.codes[key] = len(self.bits)
            self.bits.append(bits)
            self.odds.append(odds)
        return self.codes[key]

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([self._row(t) for t in texts], float).reshape(len(texts), FEATURES)

    def _row(self, text: str) -> list[float]:
        words = text.split()
        memory = self.memory
        if len(memory) > MOST_TOKENS:
            memory.clear()
        for w in {w for w in words if w not in memory}:
            memory[w] = self._code(w)
        n = max(1, len(words))
        codes = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
        raw = np.frombuffer(text.encode(), np.uint8)
        size = max(1, len(raw))
        chars = np.bincount(raw, minlength=256)
        rate = lambda s: float(chars[[ord(c) for c in s]].sum()) / size
        at = np.flatnonzero(codes)
        bits, odds = np.array(self.bits)[codes[at]], np.array(self.odds)[codes[at]]
        count = [int((bits & b > 0).sum()) for b in (WORD, STEMMED, SECOND, MASKED, ODD, CAPITAL, LOUD)]
        hit = odds > 0
        places, second = at[hit], at[bits & SECOND > 0]
        if len(places) and len(second):
            k = np.searchsorted(second, places)
            gap = np.minimum(np.abs(places - second[np.minimum(k, len(second) - 1)]), np.abs(places - second[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        else:
            near = 0
        crowd = int((places[2:] - places[:-2] <= 20).sum()) if len(places) > 2 else 0
        strong = float(odds.max(initial=0))
        letters = float(chars[65:91].sum() + chars[97:123].sum()) or 1.0
        # Document frequencies know nothing of how long a text is, so a sum of odds stands beside the densities.
        return [
            *(c / n for c in count), math.log1p(count[0]), math.log1p(count[1] + count[3]), float(odds.sum()) / n, strong, float(odds.sum()), near / n, math.log1p(near), crowd / n,
            len({words[i].lower() for i in places.tolist()}), math.log1p(len(words)), float(chars[65:91].sum()) / letters, rate("!"), rate("?"), rate("*#$%&@"), rate("0123456789"), rate(".,;:"), float(count[0] + count[1] + count[3]) / n,
        ]


def sample(docs: DataFrame, labels: DataFrame, column: str, bound: int, allowed=None) -> DataFrame:
    """doc_id, y and every column of docs for at most `bound` labelled rows, those of least hash; stored."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if allowed is not None:
        labels = labels.filter(allowed(F.col("doc_id")))
    ids = labels.groupBy("doc_id").agg(F.max(column).cast("double").alias("__q_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    ids = F.broadcast(ids.withColumnRenamed("doc_id", "__q_id"))  # bounded by `bound` rows
    return stored(docs.join(ids, docs["doc_id"] == F.col("__q_id")).drop("__q_id"), "sample")


def entries(text):
    """Distinct lower-case words of a text without their edges, and their stems."""
    edge = re.escape(_EDGE)
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, rf"^[{edge}]+|[{edge}]+$", ""))
    words = F.filter(F.array_distinct(words), lambda w: F.length(w) > 0)
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    return F.array_distinct(F.concat(words, stems))


def lexicons(rows: DataFrame) -> tuple[dict, dict, dict]:
    """Lexicons counted over fold 0, over fold 1 and over both; rows: text, __q_y, fold."""
    size = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", F.col("__q_y").alias("y")).count().collect()}
    each = rows.select("fold", "__q_y", F.explode(entries(F.col("text"))).alias("entry"))
    cells = [F.count(F.when((F.col("fold") == f) & (F.col("__q_y") == y), 1)).alias(f"c{f}{y}") for f in (0, 1) for y in (0, 1)]
    counts = each.groupBy("entry").agg(*cells)
    parts = {}
    for name, folds in (("first", (0,)), ("second", (1,)), ("both", (0, 1))):
        n1, n0 = (sum(size.get((f, float(y)), 0) for f in folds) for y in (1, 0))
        c1, c0 = (sum((F.col(f"c{f}{y}") for f in folds), F.lit(0)) for y in (1, 0))
        odds = F.log((c1 + 0.5) / F.lit(n1 + 1.0)) - F.log((c0 + 0.5) / F.lit(n0 + 1.0))
        parts[name] = F.when((c1 >= LEAST_ROWS * len(folds) / 2) & (odds >= LEAST_ODDS), odds).alias(name)
    # Words of a bounded sample that are LEAST_ROWS times in its toxic rows: all of them are taken.
    found = counts.select("entry", *parts.values()).filter("first IS NOT NULL OR second IS NOT NULL OR both IS NOT NULL").collect()
    return tuple({r["entry"]: r[name] for r in found if r[name] is not None} for name in parts)


class Model:
    def __init__(self, lexicon, trees, steps):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps
        self.reader: Reader | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        self.reader = self.reader or Reader(self.lexicon)
        raw = self.trees.predict(self.reader.features(texts))
        # The raw part keeps apart what the steps make equal.
        return np.clip(0.999 * self.steps.predict(raw) + 0.001 * raw, 0, 1) if self.steps else raw


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    rows = sample(keyed_texts(docs), labels, "toxic", bound, lambda i: ~held_out(i))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    first, second, both = lexicons(rows)

    def run(batches):
        readers = {0: Reader(second), 1: Reader(first)}  # each fold under the other's lexicon
        for b in batches:
            fold, texts = b.column("fold").to_pylist(), b.column("text").to_pylist()
            x = [readers[k].features([t])[0].tolist() for k, t in zip(fold, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__q_y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # At most `bound` rows of FEATURES numbers reach the driver, in an order of their own.
    got = sorted(rows.mapInArrow(settled(run), "doc_id bigint, y double, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), FEATURES)
    y = np.array([min(1.0, max(0.0, r["y"])) for r in got])
    trees = Boosted().fit(x, y)
    if len(y) == 0:
        trees.base = -30.0
    if len(np.unique(y)) < 2:
        return Model(both, trees, None)
    held = out_of_fold(x, y, np.arange(len(y)) % 4)
    return Model(both, trees, Isotonic().fit(held, y))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = train(docs, labels, bound)

    def run(batches):
        for b in batches:
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = keyed_texts(docs).mapInArrow(settled(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
