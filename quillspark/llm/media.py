"""Media columns: texts stored as AVI motion-JPEG and read back as timed clips.

A payload (UTF-8, filled with bytes 255 up to a positive multiple of a frame) becomes a greyscale video whose
8-bit samples are the payload's bytes: each frame a lossless JPEG (SOF3, first predictor, Huffman), each file a
RIFF AVI with an idx1 index. Reading goes by the index: frames are entropy decoded independently of each other
(many frames side by side, as rows of numpy arrays), predictions are undone, and shots are found where the
histogram difference of neighbouring frames stands out from the ones before it. Frames are coded and decoded in
groups of BATCH_BYTES samples, whatever the length of a text, so a long one takes no more memory at a time.

Defined results: null text counts as empty (one frame of filling); a very long text is a longer file; equal texts give
equal values wherever they stand; repeated rows each get their own result; an empty table gives an empty result;
columns other than doc_id and text are ignored. A file without an index is read by walking its chunks. A file that
can't be read (truncated, of another kind) gives a row whose payload columns are null, whose feature says `broken` and
which has no clips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, table

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
FILL = b"\xff"
#: Payload bytes that are coded together.
BATCH_BYTES = 1_500_000
#: Shots: bins of the histogram, differences looked back on, times their mean, least difference.
BINS, BACK, TIMES, LEAST = 16, 8, 2, 160

#: Huffman code: how many codes of 1, 2, 3 ... bits, and the categories (bits of a difference) in code order.
CODE_COUNTS = (0, 3, 1, 1, 1, 1, 1, 1)
CODE_SYMBOLS = (6, 5, 4, 7, 3, 2, 1, 0, 8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head() -> bytes:
    """Everything of a frame up to its entropy-coded data."""
    counts = bytes(CODE_COUNTS) + bytes(16 - len(CODE_COUNTS))
    frame = struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = struct.pack(">BBBBBB", 1, 1, 0x00, 1, 0, 0)  # one component, first predictor
    return b"\xff\xd8" + _segment(0xC3, frame) + _segment(0xC4, b"\x00" + counts + bytes(CODE_SYMBOLS)) + _segment(0xDA, scan)


HEAD, TAIL = jpeg_head(), b"\xff\xd9"


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Category -> (code, its bits), in canonical order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=1)
def encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: its code with its extra bits, and how many bits they are."""
    codes = huffman_codes(CODE_COUNTS, CODE_SYMBOLS)
    value, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = codes[category]
        value[d + 255], bits[d + 255] = (code << category) | (d if d >= 0 else d + (1 << category) - 1), n + category
    return value, bits


@lru_cache(maxsize=8)
def decode_tables(counts: tuple, symbols: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits to come: the difference at their start, and how many bits it takes (0: none)."""
    diff, used = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    for category, (code, n) in huffman_codes(counts, symbols).items():
        if n + category > 16:
            continue
        extra = np.arange(1 << category)
        d = np.where(extra >= (1 << category) >> 1, extra, extra - (1 << category) + 1) if category else extra
        rest = 16 - n - category
        at = (code << (16 - n)) + np.arange(1 << (16 - n))
        diff[at], used[at] = np.repeat(d, 1 << rest), n + category
    return diff, used


# --- frames ---


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of (n, FRAME) samples: all bytes, and where each frame ends in them."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    value, bits = (t[d.reshape(len(x), FRAME) + 255] for t in encode_tables())
    ends = np.cumsum(bits, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(sizes) - sizes
    at = (starts[:, None] * 8 + ends - bits).ravel()
    byte, shift = at >> 3, at & 7
    word = value.ravel() << (24 - shift - bits.ravel())
    total = int(sizes.sum())
    out = np.bincount(byte, word >> 16, total + 2) + np.bincount(byte + 1, (word >> 8) & 255, total + 2) + np.bincount(byte + 2, word & 255, total + 2)
    out = out[:total].astype(np.uint8)
    last = starts + sizes - 1
    out[last] |= ((1 << (sizes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # filled with ones
    marks = np.flatnonzero(out == 255)
    stuffed = np.insert(out, marks + 1, 0)
    return stuffed, starts + sizes + np.searchsorted(marks, starts + sizes)


def decode_frames(scans: list[bytes], counts=CODE_COUNTS, symbols=CODE_SYMBOLS) -> np.ndarray:
    """The (n, FRAME) samples of entropy-coded scans."""
    samples, whole = decoded(scans, counts, symbols)
    if not whole.all():
        raise ValueError("a frame's data ends too early")
    return samples


def decoded(scans: list[bytes], counts=CODE_COUNTS, symbols=CODE_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """The (n, FRAME) samples of entropy-coded scans, and which of them had data enough."""
    n = len(scans)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, scans), np.int64, n))
    stuffing = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 255)) + 1
    data = np.append(np.delete(raw, stuffing), np.full(FRAME * 2 + 4, 255, np.uint8)).astype(np.uint32)
    ends = ends - np.searchsorted(stuffing, ends)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    diff, used = decode_tables(tuple(counts), tuple(symbols))
    pos = np.concatenate(([0], ends[:-1])) * 8
    d = np.empty((FRAME, n), np.int16)
    stopped = np.zeros(n, bool)
    for k in range(FRAME):
        bits = ((window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(np.uint32)) >> 8) & 0xFFFF
        d[k] = diff[bits]
        stopped |= used[bits] == 0  # no code begins so
        pos += used[bits]
    d = d.T.reshape(n, SIDE, SIDE).astype(np.int64)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).reshape(n, FRAME).astype(np.uint8), (pos <= ends * 8) & ~stopped


# --- files ---


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(scans: list[bytes]) -> bytes:
    """An AVI file of frames with these scans."""
    n = len(scans)
    frames = [HEAD + s + TAIL for s in scans]
    sizes = np.fromiter(map(len, frames), np.int64, n)
    most = int(sizes.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi = _chunk(b"LIST", b"movi" + b"".join([b"00dc" + struct.pack("<I", len(f)) + f + b"\x00" * (len(f) & 1) for f in frames]))
    index = np.zeros(n, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    padded = 8 + sizes + sizes % 2
    index["name"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(padded) - padded, sizes
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames of the first stream in the order of the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index, at = 0.0, None, None, 12
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    todo = [(12, end)]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                rate = 1e6 / struct.unpack_from("<I", data, at + 8)[0]
            elif name == b"idx1":
                index = np.frombuffer(data, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
            at += 8 + size + size % 2
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is not None:
        index = index[index["name"] == b"00dc"]
        base = movi[0] + 8
        places = list(zip((index["at"].astype(np.int64) + base).tolist(), index["size"].tolist(), strict=True))
    else:
        places, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == b"00dc":
                places.append((at + 8, size))
            at += 8 + size + size % 2
    return rate, [data[a : a + s] for a, s in places]


@lru_cache(maxsize=64)
def head_of(head: bytes) -> tuple[tuple, tuple]:
    """The Huffman code (counts, symbols) that the segments of a lossless frame's head give; they are all parsed."""
    at, shape, code, scan = 2, None, None, None
    while at + 4 <= len(head):
        mark, kind, size = struct.unpack_from(">BBH", head, at)
        body = head[at + 4 : at + 2 + size]
        if mark != 0xFF or len(body) != size - 2:
            raise ValueError("a broken segment")
        if kind == 0xC3:
            bits, high, wide, parts = struct.unpack_from(">BHHB", body)
            shape = (bits, high, wide, parts)
        elif kind == 0xC4:
            counts = tuple(body[1:17])
            code = (counts, tuple(body[17 : 17 + sum(counts)]))
        elif kind == 0xDA:
            scan = tuple(body)
        at += 2 + size
    if shape != (8, SIDE, SIDE, 1) or code is None or scan != (1, 1, 0, 1, 0, 0):
        raise ValueError("a frame of another kind")
    return code


def scan_of(frame: bytes) -> tuple[bytes, tuple[tuple, tuple]]:
    """The entropy-coded data of a frame, and the code it is in."""
    at = 2
    if frame[:2] != b"\xff\xd8" or not frame.endswith(TAIL):
        raise ValueError("a frame of another kind")
    while at + 4 <= len(frame):
        last = frame[at + 1] == 0xDA
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if last:
            return frame[at : -len(TAIL)], head_of(frame[:at])
    raise ValueError("a frame without a scan")


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot, by adaptive histogram differences; whole numbers only."""
    n = len(frames)
    where = (np.arange(n)[:, None] * BINS + (frames >> 4)).ravel()
    hist = np.bincount(where, minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    total = np.concatenate(([0], np.cumsum(diff)))
    k = np.arange(len(diff))
    low = np.maximum(k - BACK, 0)
    cut = (diff >= LEAST) & (diff * np.maximum(k - low, 1) > TIMES * (total[k] - total[low]))
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


# --- tables ---


def payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and the text filled up to whole frames."""
    data = text.encode()
    return len(data), data + FILL * (-len(data) % FRAME if data else FRAME)


def _grouped(items: list, size) -> Iterator[list]:
    """Runs of items of about BATCH_BYTES together; a larger one is alone with what came before it."""
    group, total = [], 0
    for x in items:
        group.append(x)
        total += size(x)
        if total > BATCH_BYTES:
            yield group
            group, total = [], 0
    if group:
        yield group


#: Frames that are coded together.
TOGETHER = BATCH_BYTES // FRAME


def store(texts: list[str]) -> list[tuple[int, bytes]]:
    """(bytes of the text, AVI file) of each text."""
    plain = [payload(t) for t in texts]
    samples = np.frombuffer(b"".join(p for _, p in plain), np.uint8).reshape(-1, FRAME)
    scans: list[bytes] = []
    for k in range(0, len(samples), TOGETHER):
        data, ends = encode_frames(samples[k : k + TOGETHER])
        blob, edges = data.tobytes(), [0, *ends.tolist()]
        scans += [blob[a:z] for a, z in zip(edges, edges[1:], strict=False)]
    out, at = [], 0
    for size, p in plain:
        n = len(p) // FRAME
        out.append((size, write_avi(scans[at : at + n])))
        at += n
    return out


def load(files: list[bytes]) -> list[tuple[float, np.ndarray] | None]:
    """(frames a second, samples) of each file, from its stored bytes alone; None for one that can't be read."""
    read: list[tuple[float, list] | None] = []
    for f in files:
        try:
            rate, frames = read_avi(f)
            read.append((rate, [scan_of(x) for x in frames]) if frames and rate else None)
        except (ValueError, struct.error, IndexError):
            read.append(None)
    scans = [x for r in read if r for x in r[1]]
    samples, whole = np.empty((len(scans), FRAME), np.uint8), np.zeros(len(scans), bool)
    for code in {c for _, c in scans}:
        mine = [k for k, (_, c) in enumerate(scans) if c == code]
        for k in range(0, len(mine), TOGETHER):
            part = mine[k : k + TOGETHER]
            samples[part], whole[part] = decoded([scans[i][0] for i in part], *code)
    out, at = [], 0
    for r in read:
        n = len(r[1]) if r else 0
        out.append((r[0], samples[at : at + n]) if r and whole[at : at + n].all() else None)
        at += n
    return out


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the AVI file of each document."""

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id"), 0
            for group in _grouped(b.column("text").to_pylist(), lambda t: len(t) + FRAME):
                rows = store(group)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(group)

    return keyed_texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>"
_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _read_back(ids, sizes, files):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = []
    for size, f, got in zip(sizes, files, load(files), strict=True):
        if got is None:
            rows.append((size, None, None, None, len(f), sha(f), "broken", []))
            continue
        rate, frames = got
        data = frames.tobytes()
        cuts = shots(frames)
        clips = [{"clip": k, "first_frame": a, "frames": z - a, "start_s": a / rate, "end_s": z / rate} for k, (a, z) in enumerate(cuts)]
        feature = f"{len(frames)}@{rate:g}:" + ",".join(f"{a}-{z}" for a, z in cuts)
        rows.append((size, len(data), sha(data), zlib.crc32(data[-32:]), len(f), sha(f), feature, clips))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CLIPS)
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=[c.split(" ")[0] for c in READ.split(", ")])


def read_back(media: DataFrame) -> DataFrame:
    """Digests, feature and timed clips of each stored file; media as media_files() gives it."""

    def run(batches):
        for b in batches:
            at = 0
            for group in _grouped(b.column("media").to_pylist(), lambda f: len(f or b"")):
                part = b.slice(at, len(group))
                yield _read_back(part.column("doc_id"), part.column("n_bytes").to_pylist(), [f or b"" for f in group])
                at += len(group)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, frames, start_s, end_s: one row per shot."""
    return read.select("doc_id", F.inline("clips"))


def query(spark, sf_dir: str) -> DataFrame:
    return read_back(media_files(table(spark, sf_dir, "documents")))
