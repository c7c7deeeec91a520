"""Tokens, packing, media, pages and URLs, against the library, brute force or an exact round trip."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe, html_text, media, packing, url_rules

TEXTS = [None, "", " \n", "Hello, it's 12 o'clock!", "<|endoftext|> a<|startoftext|>b", "é́ ΑΣ İ 漢字 🙂 x\x1cy\x85z", "a" * 3000, "!?" * 2000, "word " * 5000, "the quick brown fox " * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def test_bpe_is_the_librarys(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, None, 1), (None, "a b", 1)]
    got = {(r.doc_id, r.ids): r for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()}
    assert len(got) == len(rows) - 1  # one repeated row
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[(i, " ".join(map(str, ids)))]
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    # The query's own form: digests alone.
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encode_documents(df, texts=False).collect()) == sorted(want)
    assert bpe.encode_documents(df.limit(0), texts=False).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé'tsS \tß漢\x1c.,!12<|>", max_size=60))
def test_bpe_on_any_text(text):
    from tokenizers import Tokenizer

    lib = test_bpe_on_any_text.lib = getattr(test_bpe_on_any_text, "lib", None) or Tokenizer.from_file(bpe.tokenizer_path())
    ((n, ids, decoded),) = bpe.encoded([text], bpe.tokenizer_path())
    want = lib.encode(text, add_special_tokens=False).ids
    assert n == len(want) and str(ids, "utf-8") == " ".join(map(str, want)) and str(decoded, "utf-8") == lib.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_agree():
    e, rng = bpe.encoder(bpe.tokenizer_path()), random.Random(1)
    pieces = ["".join(rng.choices("abcdehiornst", k=rng.randint(1, 40))) for _ in range(300)]
    pieces += ["x", "ab", "q" * 64]
    assert [list(np.frombuffer(b, "<u4")) for b in e.learn(pieces)] == [e.merge(p.encode()) for p in pieces]


def test_pair_ranks_are_found_by_hash():
    e = bpe.encoder(bpe.tokenizer_path())
    keys = np.array([*e.rank, *(k + 1 for k in e.rank)], np.int64)
    assert e._ranks(keys // e.size, keys % e.size).tolist() == [e.rank.get(k, e.nothing) for k in keys.tolist()]


def test_a_forgetful_memory_gives_the_same_ids():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcé',.1", k=rng.randint(1, 9))) for _ in range(300)) for _ in range(40)]
    e = bpe.encoder(bpe.tokenizer_path())
    small, large = bpe.Memory(e, 50), bpe.Memory(e)
    for k in range(0, 40, 5):
        for a, b in zip(small.slices(texts[k : k + 5]), large.slices(texts[k : k + 5])):
            assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert len(small.young) <= 50 + 1500


def test_joined_in_pieces(monkeypatch):
    names = bpe.strings(bpe.tokenizer_path())
    ids = [np.arange(n, dtype="<u4") for n in (0, 5, 70000 % names.tokens.__len__(), 3)]
    whole = [bytes(x) for x in names.joined(ids, names.numbers)]
    monkeypatch.setattr(names, "longest", 2**31 // 1000)
    assert [bytes(x) for x in names.joined(ids, names.numbers)] == whole

def test_packing(spark, library):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "a", "river", "town"], k=rng.randint(0, 900)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 5000), (202, "word " * 5000), (None, "x")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].drop_duplicates(["piece"]).sort_values("piece")
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert list(mine.length) == [len(p) for p in parts] and list(mine.start) == [2048 * k for k in range(len(parts))]
        assert list(mine.ids_crc32) == [zlib.crc32(struct.pack(f"<{len(p)}I", *p)) for p in parts]
    ordered = got.sort_values(["sequence_id", "offset"])
    groups = ordered.groupby("sequence_id").length
    assert (ordered.offset == groups.cumsum() - ordered.length).all() and groups.sum().max() <= 2048
    assert groups.ngroups <= 1.02 * -(-got.length.sum() // 2048) + 1


def test_packing_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 400), max_size=60))
def test_plans_hold_every_length_once(counts):
    runs = packing.plan(counts, 256)
    held = Counter()
    for lengths, n in runs:
        assert sum(lengths) <= 256 and n > 0
        held.update({k: v * n for k, v in Counter(lengths).items()})
    assert held == Counter(counts)


def test_plans_are_close_to_the_bound():
    rng = np.random.default_rng(3)
    counts = dict(Counter(np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 2048).tolist()))
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in packing.plan(counts)) <= 1.01 * -(-total // 2048)


def test_nnls_is_no_worse_than_zero_and_fits():
    a = np.array([[2.0, 1, 0], [0, 1, 1]])
    x = packing.nnls(a, np.array([10.0, 4.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [10, 4])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=1500), min_size=1, max_size=6))
def test_media_round_trip(texts):
    files = media.store([t.encode("utf-8", "replace").decode() for t in texts])
    for t, (size, f), (rate, frames) in zip(texts, files, media.load([f for _, f in files])):
        data = t.encode("utf-8", "replace").decode().encode()
        assert size == len(data) and rate == media.RATE
        assert frames.tobytes() == data + b"\xff" * (-len(data) % 576 if data else 576)


def test_media_of_any_bytes():
    x = np.random.default_rng(4).integers(0, 256, (50, media.FRAME), dtype=np.uint8)
    data, ends = media.encode_frames(x)
    edges, blob = [0, *ends.tolist()], data.tobytes()
    assert (media.decode_frames([blob[a:b] for a, b in zip(edges, edges[1:])]) == x).all()


def test_avi_without_index_and_broken_files():
    f = media.store(["some text " * 200])[0][1]
    plain = f.replace(b"idx1", b"JUNK")
    assert media.read_avi(plain)[1] == media.read_avi(f)[1]
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF1234WAVE")


def test_broken_files_are_told_and_end_nothing(spark):
    good = media.store(["some text " * 200, "other"])
    whole = good[0][1]
    files = [whole, whole[: len(whole) // 2], b"", b"RIFF", whole.replace(media.TAIL, b"\xff\xd7"), whole.replace(media.HEAD[:20], b"\xff\xd8" + bytes(18)), good[1][1]]
    df = spark.createDataFrame([(k, 5, bytearray(f)) for k, f in enumerate(files)] + [(9, 5, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.read_back(df).collect()}
    assert [k for k, r in got.items() if r.feature != "broken"] == [0, 6] and got[1].payload_sha256 is None and got[9].media_bytes == 0 and got[2].clips == []


def test_frames_of_another_code_are_read_by_their_own_tables():
    counts, symbols = (0, 1, 5, 1, 1, 1), (0, 1, 2, 3, 4, 5, 6, 7, 8)
    x = np.random.default_rng(5).integers(100, 140, (3, media.FRAME), dtype=np.uint8)
    codes = media.huffman_codes(counts, symbols)
    scans = []
    for frame in x.reshape(-1, media.SIDE, media.SIDE).astype(int):
        bits = ""
        for r in range(media.SIDE):
            for c in range(media.SIDE):
                d = int(frame[r, c] - (frame[r, c - 1] if c else frame[r - 1, 0] if r else 128))
                n = abs(d).bit_length()
                code, size = codes[n]
                bits += format(code, f"0{size}b") + (format(d if d >= 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
        bits += "1" * (-len(bits) % 8)
        scans.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
    table = b"\x00" + bytes(counts) + bytes(16 - len(counts)) + bytes(symbols)
    own = b"\x00" + bytes(media.CODE_COUNTS) + bytes(16 - len(media.CODE_COUNTS)) + bytes(media.CODE_SYMBOLS)
    file = media.write_avi(scans).replace(own, table)
    ((rate, got),) = media.load([file])
    assert rate == media.RATE and (got == x).all()


def test_long_texts_are_coded_in_parts(monkeypatch):
    text = "a long text " * 3000
    want = media.store([text, "b"])
    monkeypatch.setattr(media, "TOGETHER", 7)
    assert media.store([text, "b"]) == want and media.load([f for _, f in want])[0][1].tobytes() == media.payload(text)[1]


def test_media_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, media string, n_bytes int")
    assert media.read_back(media.media_files(none)).count() == 0


def test_shots_stand_where_pictures_change():
    x = np.zeros((30, media.FRAME), np.uint8)
    x[12:] = 200
    assert media.shots(x) == [(0, 12), (12, 30)]


def test_media_query_depends_on_the_text_alone(spark):
    rows = [(1, "same"), (2, "other " * 500), (3, "same"), (4, None), (5, ""), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read = media.read_back(media.media_files(df))
    got = {r.doc_id: tuple(r)[1:8] for r in read.collect()}
    assert got[1] == got[3] == got[None] and got[4] == got[5] and got[4][:2] == (0, 576)
    clips = media.clip_rows(read).filter("doc_id = 2").collect()
    assert clips[0].start_s == 0 and sum(c.frames for c in clips) == 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="ad">Buy now.</div>{open}<h1>Head &amp; line</h1><p>First   <b>bold</b>
text that is long enough to be told from the rest of the page by its length.<p>Short.<script>var x = "</p>";</script></p>
<p>Last one&nbsp;here, which is also long enough to be told from the rest.</p><div class="comments"><p>A reader says that this is nonsense, at some length.</p></div>{close}<footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div class='post'>", "</div>"), ("<main>", "")])
def test_main_text(open_, close):
    text = html_text.main_text(PAGE.replace("{open}", open_).replace("{close}", close))
    assert text == "Head & line\n\nFirst bold text that is long enough to be told from the rest of the page by its length.\n\nShort.\n\nLast one here, which is also long enough to be told from the rest."


def test_main_text_of_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("a < b and just text") == "a < b and just text"
    assert html_text.main_text("<article><p>cut off <b>he") == "cut off he"
    assert html_text.main_text("<p>" + "x " * 200000).startswith("x x")


def blocks(*sizes):
    return [f"{k} " + "x" * (n - len(str(k))) for k, n in enumerate(sizes)]


@pytest.mark.parametrize("sizes", [(500, 5, 6, 7, 400), (500, 20), (500, 5, 6, 7, 8, 400, 9, 3, 3, 3), (9, 8, 7, 6, 500)])
@pytest.mark.parametrize("wrap", ["<p>{}</p>", "<div>{}</div>", "<div class='par'><p>{}</p></div>", "<ul><li>{}</li></ul>"])
def test_short_blocks_of_the_main_container_are_kept(sizes, wrap):
    texts = blocks(*sizes)
    page = f"<body><div class='post'>{''.join(map(wrap.format, texts))}</div><div class='x'>a</div><div class='x'>b</div><div class='end'>Bye.</div></body>"
    assert html_text.main_text(page) == "\n\n".join(texts)


def test_short_blocks_without_a_container_are_kept():
    for sizes in ((500, 5, 6, 7, 400), (500, 20)):
        assert html_text.main_text("".join(f"<p>{t}</p>" for t in blocks(*sizes))) == "\n\n".join(blocks(*sizes))


def test_a_small_article_beside_the_text(monkeypatch):
    body, end = blocks(500, 5, 6, 7, 400), "<div class='end'>Bye.</div>"
    text = "".join(f"<p>{t}</p>" for t in body)
    teaser = "<article><h2>More</h2><p>A teaser that is short.</p></article>"
    for page in (f"<div class='post'>{text}</div>{teaser}{end}", f"<div class='post'>{text}{teaser}</div>{end}"):
        # The teaser's windows hold no surge; with a lower one, it would be kept.
        assert html_text.main_text(page) == "\n\n".join(body)
        with monkeypatch.context() as m:
            m.setattr(html_text, "SURGE_CHARS", 1)
            assert html_text.main_text(page) == "\n\n".join([*body, "More", "A teaser that is short."])
    # An article that outweighs the rest is kept alone and whole, a stretch or not.
    assert html_text.main_text(f"<article><p>a</p><p>b</p><p>c</p><p>d</p>{text}</article><div class='x'><p>{'y ' * 400}</p></div>") == "\n\n".join(["a", "b", "c", "d", *body])


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, "<p>Text</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(tuple(r) for r in html_text.main_texts(df).fillna("none", "url").collect()) == [(1, "u", "", 0, 0, 0, 0), (1, "u", "", 0, 0, 0, 0), (2, "none", "Text", 4, 1, 1, 1)]
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_windows_decide_on_every_page():
    """Without a surge nothing is kept of any page, and blocks that lie between no surge and dive are counted."""
    page = PAGE.replace("{open}", "<article>").replace("{close}", "</article>")
    text, blocks, between, kept = html_text.extracted(page)
    assert (blocks, between, kept) == (8, 4, 4) and text.count("\n\n") == 3
    rows = html_text.lines_of(page)
    assert [bool(t) for t, _, _ in rows] == [False, False, True, True, True, True, False, False]
    assert [(a, z) for _, a, z in html_text.stretches_of(rows)[0]] == [(2, 6)]


URLS = [None, "", "no scheme", "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://net/frx", "http://com", "x://", "http://notcom/", "http://m.example.com/fr/a", "http://a..com/b", "ftp://" + "a." * 3000 + "com/x"]


def brute(url, rules):
    import re

    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")], "page_id long, url string, host string")
    got = sorted(tuple(r) for r in url_rules.judged(df).fillna("none", "rule").collect())
    assert got == sorted((i, *(x or "none" if k == 2 else x for k, x in enumerate(brute(u, url_rules.RULES)))) for i, u in [*enumerate(URLS), (0, None)])
    assert url_rules.judged(df.limit(0)).count() == 0


def test_url_rules_nested_and_in_blocks(monkeypatch):
    rng = random.Random(5)
    name = lambda k: ".".join(rng.choice("abc") for _ in range(rng.randint(1, k)))
    path = lambda: "/" + "".join(rng.choice(["x", "y", "/"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): url_rules.Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((name(3), path()) for _ in range(200))}.values())
    urls = [f"http://{name(4)}{path()}" for _ in range(500)]
    ordered = url_rules.sorted_rules(rules)
    for size in (7, 1000):
        blocks = [ordered[k : k + size] for k in range(0, len(ordered), size)]
        found = url_rules.judge([url_rules.host_and_path(u) for u in urls], blocks)
        assert [r and r.host + r.path for r in found] == [brute(u, rules)[2] for u in urls]
