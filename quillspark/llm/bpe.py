"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as its bytes. The leaves of a segment tree hold, for each adjacent pair, its merge
rank and place (nothing where the pair has no merge); the root is then the leftmost pair of lowest rank.
Merging it changes at most three leaves, each a logarithmic update, until the root is empty. Encoder.merge
does this for one long piece; short pieces of a batch go through the same trees side by side as numpy rows.

White space never survives between pieces, so texts are cut there by Arrow, the words of a slice of texts are
numbered, and only words that the bounded memory doesn't hold are cut into pieces and merged. Ids of occurrences
are then gathered as numbers.

Defined results: null text counts as empty; an empty text has 0 tokens and two empty strings; any length of
text is encoded whole (a long one is a slice of its own); repeated rows each get their own result; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import keyed_texts, settled, table

TOKENIZER = "word_bpe_49k.json"
#: Words in either half of an encoder's memory; when the younger half is full the older one is forgotten.
MOST_WORDS = 120_000
#: Longer words aren't remembered.
LONGEST_WORD = 64
#: Characters of text that are encoded together.
SLICE_CHARS = 1_000_000
#: Pieces of more bytes have a tree of their own.
SIDE_BY_SIDE = 64
#: The others are characters whose lower case, composition and class are the same in all Unicode versions in use.
KNOWN = regex.compile(r"[^\t-\r\x20-\x7e\x85\xa0-ɏ‐-‧‰-⁞]")
#: A text without these is cut by white space; the ones beside KNOWN have a lower case that isn't known.
NOT_PLAIN = regex.compile(KNOWN.pattern + "|[" + "".join(c for c in map(chr, range(0x250)) if not KNOWN.search(c) and KNOWN.search(c.lower())) + "]")


#: The pre-tokenizer pattern that known_cut() stands for on KNOWN characters.
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def known_cut() -> re.Pattern:
    """WORD_CUT for the standard library: letters first (no other branch starts with one), classes spelt out."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(33, 0x250) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers = of("L"), of("N")
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.path = path
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.by_space = pattern == WORD_CUT
        self.cut = known_cut() if self.by_space else regex.compile(pattern)
        marks = _byte_characters()
        self.inner = np.array([self.vocab[c] for c in marks], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in marks], np.int64)
        self.size = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([self.vocab[a + b] for a, b in pairs] + [0], np.int64)
        keys = left * self.size + right
        self.nothing = len(pairs)
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._spread(keys)

    @cached_property
    def library(self):
        """The tokenizers library's reading of the vocabulary, for characters that Python's tables may see otherwise."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    # --- merging ---

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece, by a segment tree of its own."""
        n = len(piece)
        sym = [int(self.inner[b]) for b in piece[:-1]] + [int(self.final[piece[-1]])]
        width = 1 << max(0, (n - 2)).bit_length()
        none = (self.nothing, 0)
        tree = [none] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i):
            j = after[i]
            r = self.rank.get(sym[i] * self.size + sym[j]) if j < n else None
            return none if r is None else (r, i)

        def put(i, value):
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        for i in range(n - 1):
            tree[width + i] = pair(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        alive = [True] * n
        while tree[1] < none or tree[1][0] < self.nothing:
            rank, i = tree[1]
            j = after[i]
            sym[i], alive[j], after[i] = int(self.merged[rank]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if j < n - 1 or j < width:
                put(min(j, width - 1), none) if j < width else None
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def _spread(self, keys: np.ndarray) -> None:
        """Slots of a hash table with open addressing: every pair within `reach` of its own slot."""
        bits = 2 + max(1, len(keys)).bit_length()
        self.shift, self.reach = np.uint64(64 - bits), 1
        slots = np.full((1 << bits) + 64, -1, np.int64)
        ranks = np.full(len(slots), self.nothing, np.int32)
        todo, step = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(todo):
            at = home[todo] + step
            free = slots[at] < 0
            # Of several pairs for one free slot, the first takes it.
            first = np.zeros(len(todo), bool)
            first[np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            slots[at[first]], ranks[at[first]] = keys[todo[first]], todo[first]
            todo, step = todo[~first], step + 1
        self.slots, self.slot_ranks, self.reach = slots, ranks, step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left, right):
        k = left.astype(np.int64) * self.size + right
        at = self._home(k)
        out = np.where(self.slots[at] == k, self.slot_ranks[at], self.nothing)
        open_ = np.flatnonzero((out == self.nothing) & (self.slots[at] >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            there = self.slots[at[open_] + step]
            hit = there == k[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]] + step]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merge_many(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of short pieces (n bytes of data from starts), one after another, and how many each has.

        One tree a row, updated side by side.
        """
        rows, width = len(n), 1 << max(0, int(n.max()) - 2).bit_length()
        row = np.repeat(np.arange(rows), n)
        col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        flat = data[np.repeat(starts, n) + col]
        sym = np.full((rows, width + 2), -1, np.int32)
        sym[row, col] = self.inner[flat]
        sym[np.arange(rows), n - 1] = self.final[flat[np.cumsum(n) - 1]]
        after = np.tile(np.arange(1, width + 3, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (rows, 1))
        none = self.nothing * width
        tree = np.full((rows, 2 * width), none, np.int32)
        held = (sym[:, :width] >= 0) & (sym[:, 1 : width + 1] >= 0)
        r = np.full(held.shape, self.nothing, np.int64)
        r[held] = self._ranks(sym[:, :width][held], sym[:, 1 : width + 1][held])
        place = np.arange(width)
        tree[:, width:] = np.where(r < self.nothing, r * width + place, none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree_flat, sym_flat, after_flat, before_flat = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()
        tw, sw = 2 * width, width + 2

        def put(rows, leaf, value):
            base, at = rows * tw, leaf + width
            tree_flat[base + at] = value
            while width > 1 and at[0] > 1:
                at = at >> 1
                two = base + 2 * at
                tree_flat[base + at] = np.minimum(tree_flat[two], tree_flat[two + 1])

        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = tree_flat[live * tw + 1]
            i, rank = root % width, root // width
            base = live * sw
            j = after_flat[base + i]
            k = after_flat[base + j]
            sym_flat[base + i] = self.merged[rank]
            sym_flat[base + j] = -1
            after_flat[base + i] = k
            inside = k < sw
            before_flat[(base + k)[inside]] = i[inside]
            gone = j < width
            if gone.all():
                put(live, j, none)
            elif gone.any():
                put(live[gone], j[gone], none)
            right = np.where(inside, sym_flat[base + np.minimum(k, sw - 1)], -1)
            r = np.where(right >= 0, self._ranks(sym_flat[base + i], np.maximum(right, 0)), self.nothing)
            put(live, i, np.where(r < self.nothing, r * width + i, none))
            h = before_flat[base + i]
            has = h >= 0
            if has.any():
                hb, hh = base[has], h[has]
                r = self._ranks(sym_flat[hb + hh], sym_flat[hb + i[has]])
                put(live[has], hh, np.where(r < self.nothing, r * width + hh, none))
            live = live[tree_flat[live * tw + 1] < none]
        kept = sym >= 0
        return sym[kept].astype("<u4"), kept.sum(axis=1)

    # --- texts ---

    def normalised(self, text: str) -> str:
        """As the vocabulary's own normalizer; quick where Python's tables agree with it."""
        if not KNOWN.search(text):
            return unicodedata.normalize("NFC", text).lower()
        return self.library.normalizer.normalize_str(text)

    def pieces(self, text: str) -> list[str]:
        """A normalised text cut as the vocabulary's pre-tokenizer cuts it."""
        if not KNOWN.search(text):
            return self.cut.findall(text)
        back = {c: b for b, c in enumerate(_byte_characters())}
        return [bytes([back[c] for c in p]).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The tokens of each piece, as little-endian 32-bit numbers."""
        out = [b""] * len(pieces)
        _, offsets, data = pa.array(pieces, pa.large_string()).buffers()
        edges = np.frombuffer(offsets, np.int64, len(pieces) + 1) if pieces else np.zeros(1, np.int64)
        flat, sizes, low = np.frombuffer(data or b"", np.uint8), np.diff(edges), 0
        for most in (2, 3, 5, 9, 17, 33, SIDE_BY_SIDE):
            at = np.flatnonzero((sizes > low) & (sizes <= most))
            if len(at):
                ids, counts = self.merge_many(flat, edges[at], sizes[at])
                blob, ends = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                for k, a, z in zip(at.tolist(), ends, ends[1:], strict=False):
                    out[k] = blob[a:z]
            low = most
        for k in np.flatnonzero(sizes > low).tolist():
            ids = self.merge(pieces[k].encode())
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def parts(self, text: str) -> list[list[str] | int]:
        """Parts of a text: lists of pieces, and ids of special tokens between them."""
        if self.special_split and any(s in text for s in self.special):
            cut = self.special_split.split(text)
            return [self.special[p] if p in self.special else self.pieces(self.normalised(p)) for p in cut if p]
        return [self.pieces(self.normalised(text))]

    def plain(self, text: str) -> str | None:
        """The normalised text if white space parts its pieces and nothing in it is special, else None."""
        if not self.by_space or NOT_PLAIN.search(text) or (self.special and any(s in text for s in self.special)):
            return None
        return unicodedata.normalize("NFC", text).lower()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _listed(words: pa.Array) -> list[str]:
    """Words without blanks as Python strings; quicker than to_pylist()."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class Memory:
    """Ids of words already encoded, as little-endian 32-bit numbers, in a younger and an older half."""

    def __init__(self, encoder: Encoder, most: int = MOST_WORDS):
        self.encoder, self.most = encoder, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct normalised words, each a run without white space."""
        out = list(map(self.young.get, words))
        miss = [k for k, v in enumerate(out) if v is None]
        older = list(map(self.old.get, [words[k] for k in miss]))
        fresh = []
        for k, v in zip(miss, older, strict=True):
            if v is None:
                fresh.append(k)
            else:
                out[k] = self.young[words[k]] = v
        # A word of letters is one piece; the others are cut.
        lone = [words[k] for k in fresh if words[k].isalpha()]
        learned = self.encoder.learn(lone)
        self.young.update(zip(lone, learned, strict=True))
        found = iter(learned)
        cut = []
        for k in fresh:
            if words[k].isalpha():
                out[k] = next(found)
            else:
                cut.append((k, self.encoder.cut.findall(words[k])))
        known = self.pieces({p for _, ps in cut for p in ps})
        for k, ps in cut:
            v = out[k] = b"".join([known[p] for p in ps])
            if len(words[k]) <= LONGEST_WORD:
                self.young[words[k]] = v
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out

    def pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, which aren't remembered by this."""
        known = {p: v for p in pieces if (v := self.young.get(p) or self.old.get(p)) is not None}
        fresh = [p for p in pieces if p not in known]
        known.update(zip(fresh, self.encoder.learn(fresh), strict=True))
        return known

    def _parts(self, text: str) -> np.ndarray:
        """Ids of a text that isn't plain."""
        parts = self.encoder.parts(text)
        known = self.pieces({p for part in parts if not isinstance(part, int) for p in part})
        blob = b"".join([struct.pack("<I", part) if isinstance(part, int) else b"".join([known[p] for p in part]) for part in parts])
        return np.frombuffer(blob, "<u4")

    def slices(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The ids of each text, for runs of texts of about SLICE_CHARS characters."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < SLICE_CHARS:
                chars += len(texts[end])
                end += 1
            yield self._slice(texts[at:end])
            at = end

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        lows = list(map(self.encoder.plain, texts))
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in lows], pa.string()))
        numbered = split.flatten().dictionary_encode()
        blobs = self.words(_listed(numbered.dictionary))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        ids, starts = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(sizes) - sizes
        which = numbered.indices.to_numpy()
        many = sizes[which]
        ends = np.cumsum(many)
        flat = ids[np.repeat(starts[which] - (ends - many), many) + np.arange(int(many.sum()))]
        bounds = np.append(0, ends)[split.offsets.to_numpy()].tolist()
        return [flat[a:z] if t is not None else self._parts(text) for t, text, a, z in zip(lows, texts, bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def memory(path: str) -> Memory:
    """The one memory of a worker: encoding and packing share it."""
    return Memory(Encoder(path))


def encoder(path: str) -> Encoder:
    return memory(path).encoder


class Strings:
    """Ids of many texts as text: numbers or tokens, joined by one blank."""

    def __init__(self, encoder: Encoder):
        self.numbers, self.tokens = pa.array(map(str, range(encoder.size)), pa.string()), pa.array(encoder.tokens, pa.string())
        self.longest = 1 + max(map(len, map(str.encode, encoder.tokens)))

    def joined(self, ids: list[np.ndarray], names: pa.Array) -> list[memoryview]:
        """UTF-8 of each text's ids under their names."""
        ends = np.cumsum([0, *map(len, ids)])
        if ends[-1] * self.longest >= 2**31:  # beyond what one Arrow string array holds: in pieces
            half = len(ids) // 2
            if half:
                return self.joined(ids[:half], names) + self.joined(ids[half:], names)
            step = 2**30 // self.longest
            whole = b" ".join(bytes(self.joined([ids[0][k : k + step]], names)[0]) for k in range(0, len(ids[0]), step))
            return [memoryview(whole)]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.concatenate(ids))))
        out = pc.binary_join(listed, " ")
        _, offsets, data = out.buffers()
        at, view = np.frombuffer(offsets, np.int32, len(ids) + 1).tolist(), memoryview(data or b"")
        return [view[a:z] for a, z in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def strings(path: str) -> Strings:
    return Strings(encoder(path))


def encoded(texts: list[str], path: str) -> Iterator[tuple[int, memoryview, memoryview]]:
    """The number of ids, the ids joined by one blank, and the decoded text, in UTF-8, of each text."""
    names = strings(path)
    for ids in memory(path).slices(texts):
        yield from zip(map(len, ids), names.joined(ids, names.numbers), names.joined(ids, names.tokens), strict=True)


def encode_documents(docs: DataFrame, path: str | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if texts, ids and decoded themselves."""
    path = path or tokenizer_path()
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.string(), "decoded": pa.string()} if texts else {})

    def run(batches):
        for b in batches:
            rows = [(n, sha(i), sha(d), *((str(i, "utf-8"), str(d, "utf-8")) if texts else ())) for n, i, d in encoded(b.column("text").to_pylist(), path)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns, kinds.values())], names=["doc_id", *kinds])

    return keyed_texts(docs).mapInArrow(settled(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), texts=False)
