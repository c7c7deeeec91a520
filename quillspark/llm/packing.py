"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

The lengths' histogram has at most `capacity` entries whatever the corpus, so the plan is made on the driver
from it alone: patterns of up to MOST_PARTS lengths (in bins of BIN tokens) that fill a sequence are
enumerated, their repeat counts fitted to the histogram, rounded down and filled with real lengths (the last
place goes to the longest length that still fits); sequences that lack at most GAP tokens stand, and what is left is
packed best fit, longest first, into the gaps and into new sequences. A plan is a few thousand runs (lengths, repeats). Documents find their place in
it by their rank among the pieces of equal length, which is counted in blocks, so a hot length is spread out.

Defined results: null text counts as empty, and an empty text is one token (the end mark); a very long text is many
pieces; pieces of equal length are dealt out in blocks of hashes, then by doc_id and piece; a table without rows gives
no rows; repeated rows each get a place; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import keyed_texts, settled, stored, table

CAPACITY = 2048
END_ID = 0
#: Width of a bin of lengths, and lengths in a pattern at most.
BIN, MOST_PARTS = 32, 4
#: Tokens that a fitted sequence may lack; sequences that lack more are packed anew.
GAP = 4
#: Blocks in which the pieces of one length are counted.
BLOCKS = 1024


# --- pieces ---


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document with its end mark, cut at `capacity` tokens."""
    path = path or bpe.tokenizer_path()
    end = struct.pack("<I", end_id)

    def run(batches):
        for b in batches:
            out, docs = [], iter(b.column("doc_id").to_pylist())
            for group in bpe.memory(path).slices(b.column("text").to_pylist()):
                for ids, doc in zip(group, docs, strict=False):
                    n = len(ids)
                    for k in range(0, n + 1, capacity):
                        crc = zlib.crc32(ids[k : k + capacity].tobytes())
                        out.append((doc, k // capacity, k, min(capacity, n + 1 - k), zlib.crc32(end, crc) if n - k < capacity else crc))
            cols = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_texts(docs).mapInArrow(settled(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- plan ---


def patterns(bins: int, parts: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """Descending tuples of 1 to `parts` bins that sum to `bins`."""
    out = []

    def grow(head, left, most, places):
        if left == 0:
            out.append(head)
        elif places:
            for b in range(min(left, most), (left - 1) // places, -1):
                grow((*head, b), left - b, b, places - 1)

    grow((), bins, bins, parts)
    return out


def nnls(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The x >= 0 of least |a x - h|, by active sets; at most as many x > 0 as a has rows."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    done: set[int] = set()
    for _ in range(6 * a.shape[0]):
        gain = a.T @ (h - a @ x)
        gain[active] = -1
        gain[list(done)] = -1
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * max(1.0, float(h.max(initial=0))):
            break
        active.append(j)
        while active:
            s = np.linalg.lstsq(a[:, active], h, rcond=None)[0]
            if s.min() > 1e-12:
                break
            now = x[active]
            low = s <= 1e-12
            step = float((now[low] / np.maximum(now[low] - s[low], 1e-30)).min())
            moved = now + step * (s - now)
            keep = moved > 1e-12
            x[active] = np.where(keep, moved, 0)
            if active[-1] == j and not keep[-1]:
                done.add(j)  # it can't enter now
            active = [k for k, ok in zip(active, keep, strict=True) if ok]
        else:
            continue
        x[:] = 0
        x[active] = s
        if j in active:
            done.clear()
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY, width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, repeats) that hold every counted length once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = -(-capacity // width)
    runs: list[tuple[tuple[int, ...], int]] = []
    if left.any():
        hist = np.zeros(bins, float)
        np.add.at(hist, (np.flatnonzero(left) - 1) // width, left[left > 0])
        found = [p for p in patterns(bins) if all(hist[b - 1] > 0 for b in p)]
        if found:
            a = np.zeros((bins, len(found)))
            for k, p in enumerate(found):
                for b in p:
                    a[b - 1, k] += 1
            x = np.floor(nnls(a, hist) + 1e-6).astype(np.int64)
            for k in sorted(np.flatnonzero(x).tolist(), key=lambda k: found[k], reverse=True):
                runs += _nearly_full(_fill(found[k], int(x[k]), left, capacity, width), left, capacity)
    return _best_fit(runs, left, capacity)


def _fill(pattern: tuple[int, ...], repeats: int, left: np.ndarray, capacity: int, width: int) -> list[tuple[tuple[int, ...], int]]:
    """Up to `repeats` sequences of the pattern from the lengths left, which it takes away."""
    out = []
    while repeats > 0:
        taken: dict[int, int] = defaultdict(int)
        for place, b in enumerate(pattern):
            room = capacity - sum(length * n for length, n in taken.items())
            top = room if place == len(pattern) - 1 else min(room, b * width)
            low = (b - 1) * width + 1
            free = next((i for i in range(top, low - 1, -1) if left[i] > taken.get(i, 0)), 0)
            if not free:
                return out
            taken[free] += 1
        n = min(repeats, *(int(left[i]) // k for i, k in taken.items()))
        for i, k in taken.items():
            left[i] -= n * k
        out.append((tuple(sorted((i for i, k in taken.items() for _ in range(k)), reverse=True)), n))
        repeats -= n
    return out


def _nearly_full(runs, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The runs with a gap of at most GAP; the lengths of the others are residuals again."""
    for lengths, n in runs:
        if sum(lengths) < capacity - GAP:
            for i in lengths:
                left[i] += n
    return [r for r in runs if sum(r[0]) >= capacity - GAP]


def _best_fit(runs, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The runs with the lengths left put where they fit best, longest first, or into new sequences."""
    by_gap: dict[int, list] = defaultdict(list)
    for lengths, n in runs:
        by_gap[capacity - sum(lengths)].append((lengths, n))
    gaps = np.zeros(capacity + 1, bool)
    gaps[list(by_gap)] = True
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fit = length + int(gaps[length:].argmax()) if gaps[length:].any() else 0
            if fit:
                lengths, r = by_gap[fit].pop()
                m = min(n, r)
                if m < r:
                    by_gap[fit].append((lengths, r - m))
                gaps[fit] = bool(by_gap[fit])
                new, n = ((*lengths, length), m), n - m
            else:
                many = min(n, capacity // length)
                m = n // many
                new, n = ((length,) * many, m), n - m * many
            gap = capacity - sum(new[0])
            by_gap[gap].append(new)
            gaps[gap] = True
    return [r for rs in by_gap.values() for r in rs]


def places(runs) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by rank."""
    out, taken, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, n in runs:
        offset = 0
        for length in lengths:
            out[length].append((taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


# --- documents ---


def ranked(pieces: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """pieces with rank: from 0 among the pieces of equal length."""
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    by_block = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    rows = rows.withColumn("inside", inside - 1).join(base, ["length", "block"])
    return rows.withColumn("rank", F.col("base") + F.col("inside")).drop("base", "inside", "block")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = stored(token_pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    at = places(plan(counts, capacity))

    def put(frames):
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            ranks, lengths = f["rank"].to_numpy(), f["length"].to_numpy()
            for length in np.unique(lengths):
                rows, runs = np.flatnonzero(lengths == length), at[int(length)]
                k = np.searchsorted(runs[:, 0], ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = runs[k, 1] + ranks[rows] - runs[k, 0], runs[k, 2]
            yield pd.DataFrame({c: f[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset})

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked(pieces).mapInPandas(put, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
