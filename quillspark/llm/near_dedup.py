"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the set of its shingles of WORDS lower-case words, all of weight 1, as links are defined by sets
however often a line is repeated. Each shingle is a Poisson process of that rate whose points fall on random
registers; a register keeps the shingle of its first point, and a document's processes stop once their next points
come after the last register's first. Two registers agree with the Jaccard similarity of the sets.

Equal word sequences are collapsed first. BANDS bands of ROWS registers put the rest into buckets. In a bucket
pairs are never all listed: the members meet the bucket's most central member (whose buckets are largest), and
where few pairs between different classes are left (at most FEW times its members) those are listed. Pairs are
verified by the Jaccard similarity of their shingle sets; links merge classes, and buckets whose members are
all of one class are done. Rounds go on with the next central member until no bucket is left, or until two
rounds have found no link in what is left (large buckets of documents that are alike but not near). Then one
exact join ends them all: of similar sets, the rarest shingles of both must share one (prefix filter), and
every pair of different classes that does is verified.

Nodes are word sequences, named by their least doc_id; where one doc_id names several sequences (repeated ids with
different texts), those get numbers of their own, so no row is taken for another.

Defined results: null text counts as empty, and texts without a word are copies of each other; a text of fewer
than WORDS words is one shingle; a very long text is read whole, its processes side by side; of rows that share the
class's least doc_id, those with the least word sequence are its representatives (repeated rows all are); rows with
a null doc_id take the class of an equal text, else null; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, settled, small, stored, table

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
FEW = 4
MOST_WORDS = 50_000
#: Shingles whose processes run side by side.
BATCH = 100_000

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uniform numbers from keys."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


_hashes = WordHashes()


_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case; the white-space parts of a text without any."""
    low = text.lower()
    return _WORD.findall(low) or low.split()


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of all runs of WORDS words, in order; of all words if they are fewer; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(n, WORDS)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(out * _GOLD + h[k : n - size + 1 + k])
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (shingle of the first point, low 32 bits) of documents with at least one shingle each."""
    n = len(sets)
    element = np.concatenate([e for e, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    registers = np.full(n * REGISTERS, none, np.uint64)
    time = np.zeros(len(element), np.float64)
    low = element & np.uint64(0xFFFFFFFF)
    k = 0
    with np.errstate(over="ignore"):
        while len(element):
            k += 1
            u = mix(element + np.uint64(2 * k) * _GOLD)
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            place = (mix(element + np.uint64(2 * k + 1) * _GOLD) >> np.uint64(32)).astype(np.int64) % REGISTERS
            stamp = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
            np.minimum.at(registers, doc * REGISTERS + place, stamp)
            last = registers.reshape(n, REGISTERS).max(axis=1)
            go = stamp < last[doc]  # early end: later points can't be first anywhere
            element, rate, doc, time, low = element[go], rate[go], doc[go], time[go], low[go]
    return (registers & np.uint64(0xFFFFFFFF)).reshape(n, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
        for r in range(ROWS):
            key = mix(key * _GOLD + registers[:, r::ROWS][:, :BANDS])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h, k1, k2 (of the word sequence), bands; docs: doc_id, text and h (of the text)."""

    def flush(rows, out):
        full = [k for k, r in enumerate(rows) if len(r[2])]
        bands = [[] for _ in rows]
        if full:
            keys = band_keys(signatures([(rows[k][2], rows[k][3]) for k in full])).tolist()
            for k, b in zip(full, keys, strict=True):
                bands[k] = b
        out.extend((r[0], r[1], b) for r, b in zip(rows, bands, strict=True))
        rows.clear()

    def run(batches):
        for b in batches:
            rows, out, size = [], [], 0
            for text in b.column("text").to_pylist():
                words = words_of(text)
                d = xxhash.xxh3_128_digest(" ".join(words).encode())
                e = np.unique(shingles(words))
                rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), e, np.ones(len(e))))
                size += len(e)
                if size > BATCH:
                    flush(rows, out)
                    size = 0
            flush(rows, out)
            k1, k2, bands = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "k1", "k2", "bands"])

    return docs.mapInArrow(settled(run), "doc_id bigint, h bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """rep, sh: the distinct shingle hashes of each text; docs: rep, text."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [np.unique(shingles(words_of(t))).view(np.int64) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["rep", "sh"])

    return docs.select("rep", "text").mapInArrow(settled(run), "rep bigint, sh array<bigint>")


def collapsed(sketch: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, h, k1, k2, rep (the node of the row's word sequence), first (the row stands for it), bands of those.

    Stored; and whether some nodes aren't named by a doc_id.
    """
    # Equal word sequences; the third key makes both sides exchanges of the join, which AQE may split.
    sketch = sketch.withColumn("k3", F.col("k1").bitwiseXOR(F.col("k2")))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("least")
    same = sketch.groupBy("k1", "k2").agg(least, F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("k3", F.col("k1").bitwiseXOR(F.col("k2")))
    first = F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("h") == F.col("least.h")), F.col("doc_id").isNotNull() & F.col("least").isNull())
    rows = sketch.join(same, ["k1", "k2", "k3"], "left").select("doc_id", "h", "k1", "k2", F.coalesce("least.doc_id", "doc_id").alias("rep"), first.alias("first"), F.when(first, F.col("bands")).alias("bands"))
    rows, renamed = stored(rows, "members"), 0
    while True:
        # Nodes whose name is another's too.
        key = F.struct("k1", "k2")
        shared = rows.filter("first").groupBy("rep").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo < hi").select(F.col("rep").alias("old"))
        shared = stored(shared, "shared-names")
        if shared.isEmpty():
            return rows, renamed > 0
        renamed += 1
        named = F.when(F.col("old").isNotNull(), F.xxhash64("k1", "k2", F.lit(renamed))).otherwise(F.col("rep"))
        rows = stored(rows.join(small(shared), F.col("rep") == F.col("old"), "left").withColumn("rep", named).drop("old"), "members")


def classes_of(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes of edges (u, v) whose root is another.

    Alternating large and small stars: every node moves its larger neighbours, then itself and its smaller
    ones, to the least neighbour; a fixed point is a star around each least node.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumn("u2", F.col("u") % 1009)
        large = both.filter("v > u").withColumn("u2", F.col("u") % 1009).join(least, ["u", "u2"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumn("u2", F.col("u") % 1009)
        met = large.withColumn("u2", F.col("u") % 1009).join(least, ["u", "u2"])
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = stored(met.select(pairs.alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        # One row of sums to the driver.
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r["n"], r["s"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (r["n"], r["s"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    a, b = sets.select(F.col("rep").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("sh").alias("sb"))
    met = pairs.join(a, "a").join(b, "b")
    # Sizes alone rule out most of what can't be similar.
    short, long = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    met = met.filter(short / long >= similar).withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.filter(F.col("i") / (F.size("sa") + F.size("sb") - F.col("i")) >= similar).select("a", "b")


def prefix_pairs(rest: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of rest (rep, class) of different classes; every pair of similar sets is among them.

    Shingles are ordered by how many sets have them, those of one class first. Similar sets share at least
    need = similar / (1 + similar) of their sizes' sum, so the first shared one stands before the last need - 1
    of each. Only shingles of several classes are ever looked up.
    """
    known = stored(rest.join(sets, "rep").select("rep", "class", "sh", F.size("sh").alias("size")), "rest")
    tokens = known.select("rep", "class", "size", F.explode("sh").alias("token")).withColumn("t2", F.col("token") % 1009)
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("class").alias("c1"), F.max("class").alias("c2")).filter("c1 < c2").select("token", "n", (F.col("token") % 1009).alias("t2"))
    rows = tokens.join(shared, ["token", "t2"]).groupBy("rep", "class", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    # Positions from here count the shingles of one class, which stand first.
    lone = F.col("size") - F.size("t")
    prefix = F.col("size") - F.ceil(similar * F.col("size") - 1e-9) + 1 - lone
    rows = rows.withColumn("lone", lone).withColumn("t", F.slice("t", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")))
    rows = stored(rows.select("rep", "class", "size", "lone", F.posexplode("t").alias("k", "x")).select("rep", "class", "size", (F.col("lone") + F.col("k")).alias("at"), F.col("x.token").alias("token")), "prefixes")
    a, b = (rows.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "class", "size", "at"))) for side in "ab")
    need = similar / (1 + similar) * (F.col("size_a") + F.col("size_b")) - 1e-9
    near = (F.col("rep_a") < F.col("rep_b")) & (F.col("class_a") != F.col("class_b")) & (F.col("size_a") - F.col("at_a") >= need) & (F.col("size_b") - F.col("at_b") >= need)
    near &= F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b") - 1e-9
    return a.join(b, "token").filter(near).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _sets(docs: DataFrame, members: DataFrame, central: DataFrame) -> DataFrame:
    """rep, sh of the nodes in central, stored: each from one row's text."""
    wanted = members.filter("first").select("rep", "doc_id", "h").join(central.select("rep"), "rep", "left_semi").distinct()
    wanted = stored(wanted.select("rep", F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "wanted")
    # Texts meet their nodes; ids that are known to be few are broadcast.
    met = docs.join(small(wanted), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("rep", "text")
    sets = stored(shingle_sets(met), "shingles")
    # Rows that repeat a document whole gave its set again.
    return sets if sets.count() == wanted.count() else stored(sets.dropDuplicates(["rep"]), "shingles")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), is_representative, text_hash: one row per row of docs."""
    docs = keyed_texts(docs).withColumn("h", F.xxhash64("text"))
    members, renamed = collapsed(stored(sketches(docs), "sketches"))
    rows = members.filter("bands IS NOT NULL").select(F.explode("bands").alias("bucket"), "rep").distinct()
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").withColumn("b2", F.col("bucket") % 1009)
    shared = stored(rows.withColumn("b2", F.col("bucket") % 1009).join(sizes, ["bucket", "b2"]).select("bucket", "rep", "size"), "buckets")
    central = stored(shared.groupBy("rep").agg(F.sum("size").alias("score")), "central")
    sets = _sets(docs, members, central)
    alive = stored(shared.join(central, "rep").select("bucket", "rep", "score", F.col("rep").alias("class")), "alive")
    label = central.select("rep", F.col("rep").alias("class"))
    renewed = lambda df, moved: df.join(moved.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")

    def moves(links):
        met = links.join(label.select(F.col("rep").alias("a"), F.col("class").alias("u")), "a").join(label.select(F.col("rep").alias("b"), F.col("class").alias("v")), "b")
        return classes_of(met.select("u", "v"))

    idle = 0
    while idle < 2:
        # What a bucket has: members, pairs between classes, its largest class and its most central member.
        per = alive.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("rep")).alias("least"))).alias("top"))
        lead = F.max(F.struct("top", "class"))
        state = per.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max(F.struct("n", "class"))["class"].alias("most"), lead.alias("lead")).filter("q < s * s")
        state = state.select("bucket", (F.col("bucket") % 1009).alias("b2"), ((F.col("s") * F.col("s") - F.col("q")) <= 2 * FEW * F.col("s")).alias("few"), "most", (-F.col("lead.top.least")).alias("leader"), F.col("lead.class").alias("lead_class"))
        now = stored(alive.withColumn("b2", F.col("bucket") % 1009).join(state, ["bucket", "b2"]).drop("b2"), "round")
        stars = now.filter("NOT few AND class <> lead_class").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
        rest = now.filter("few").select("bucket", F.col("rep").alias("other"), F.col("class").alias("other_class"))
        listed = now.filter("few AND class <> most").join(rest, "bucket").filter("class <> other_class").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        pairs = stars.union(listed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = stored(verified(pairs, sets, similar), "links")
        left = now.filter("NOT few AND rep <> leader").select("bucket", "rep", "score", "class")
        if links.isEmpty():
            idle += 1
        else:
            idle = 0
            moved = moves(links)
            label, left = stored(renewed(label, moved), "classes"), renewed(left, moved)
        alive = stored(left, "alive")
        if alive.isEmpty():
            break
    else:
        # Buckets that still hold several classes: all their pairs that can be links.
        mixed = alive.groupBy("bucket").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).filter("c1 < c2").select("bucket", (F.col("bucket") % 1009).alias("b2"))
        rest = alive.withColumn("b2", F.col("bucket") % 1009).join(mixed, ["bucket", "b2"]).select("rep", "class").distinct()
        links = stored(verified(prefix_pairs(rest, sets, similar), sets, similar), "links")
        if not links.isEmpty():
            label = stored(renewed(label, moves(links)), "classes")
    out = members.join(label, "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"), "k1", "k2", F.col("h").alias("text_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    if renamed:
        key = F.struct("doc_id", "k1", "k2")
        least = stored(out.filter("doc_id IS NOT NULL").groupBy("class_id").agg(F.min(key).alias("least")), "class-names")
        out = out.join(least, "class_id", "left").withColumn("class_id", F.col("least.doc_id"))
        stays = (key == F.col("least")) | (F.col("doc_id").isNull() & F.col("class_id").isNull())
    return out.select("doc_id", "class_id", F.coalesce(stays, F.lit(False)).alias("is_representative"), "text_hash")


def query(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
