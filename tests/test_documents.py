"""Structure, reference lists, citations, edits, annotation, the ledger and Word files."""

import datetime as dt
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import annotate, citations, edits, ledger, paragraphs, references, structure
from quillspark.plans.templates import ENTRIES
from quillspark.sources import docx


def rows(spark, items):
    """items: (level, is_list, is_ref, text)."""
    df = spark.createDataFrame([(1, n, *i) for n, i in enumerate(items)], "doc_id long, idx int, level int, is_list boolean, is_ref boolean, r string")
    return df.withColumns({"m": F.col("r"), "has_format": F.lit(True), "indent": F.lit(720), "italic_ok": F.lit(None).cast("boolean"), "italic_excerpt": F.lit("")})


def places(df):
    return sorted((r.rule_id, r.idx) for r in df.collect())


def test_headings(spark):
    p = rows(spark, [(1, False, False, "A"), (3, False, False, "B"), (0, False, False, "Table 1"), (3, False, False, "C"), (None, False, False, "Body."), (2, False, False, "D"), (None, False, True, "Ref"), (2, False, False, "E")])
    assert places(structure.skipped_levels(p)) == [("HED001", 1)]
    assert places(structure.headings_without_body(p)) == [("HED002", 1)]


def test_lists(spark):
    item = lambda t: (None, True, False, t)
    p = rows(spark, [item("one"), item("two"), (None, False, False, "Body."), item("alone"), (None, False, True, "Ref"), item("First."), item("second;")])
    assert places(structure.list_findings(p)) == [("MEC029", 0), ("MEC030", 5)]


def test_abstract(spark):
    long = "word " * 130
    p = rows(spark, [(1, False, False, "Abstract"), (None, False, False, long), (None, False, False, long), (1, False, False, "Next"), (None, False, False, long)])
    assert places(structure.long_abstracts(p)) == [("MEC016", 0)]
    assert structure.long_abstracts(p.filter("idx <> 2")).count() == 0


def test_indent(spark):
    body = (None, False, False, "One sentence. Another sentence.")
    p = rows(spark, [body, body, body, (None, False, False, "Short.")]).withColumn("indent", F.expr("CASE idx WHEN 0 THEN 720 WHEN 1 THEN 0 END"))
    assert places(structure.missing_indents(p)) == [("MEC023", 1), ("MEC023", 2)]


def test_entries(spark):
    p = rows(spark, [(None, False, True, t) for _, t in ENTRIES])
    got = places(references.entry_findings(p))
    assert [(r, n) for n, (r, _) in enumerate(ENTRIES) if r and (r, n) not in got] == []
    assert ("REF018", 23) in got and ("REF018", 1) not in got and ("REF024", 0) not in got


def parse(spark, text):
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, idx int, text string")
    return [(r.raw, r.authors, r.year, r.form, r["at"]) for r in citations.parsed(df).orderBy("nth").collect()]


def test_citations(spark):
    got = parse(spark, "It grew (Smith & Lee, 2020a) as Kotter’s plan (Adams et al., 2018, p. 3; Brown, 2019). However Al Abri (2001) and pwc (2024), not data (2020).")
    assert got == [
        ("(Smith & Lee, 2020a)", ["smith", "lee"], "2020a", "parenthetical", 8),
        ("Adams et al., 2018, p. 3", ["adams"], "2018", "parenthetical", 46),
        ("Brown, 2019", ["brown"], "2019", "parenthetical", 46),
        ("However Al Abri (2001)", ["al abri"], "2001", "narrative", 87),
        ("pwc (2024)", ["pwc"], "2024", "narrative", 114),
    ]


def test_names_are_split_at_and_without_boundaries(spark):
    assert parse(spark, "so, Anderson (2001) wrote.")[0][1] == ["erson"]


def test_issues(spark):
    body = spark.createDataFrame([(1, 0, "It grew (Smith, 2020) and (Jones, 2019) and (Brown, 2018) and (Lee, 2000) and (Stanford HAI, 2023) and (Nobody, 1999) and (Smyth, 2020).")], "doc_id long, idx int, text string")
    refs = spark.createDataFrame([(1, "References\nSmith, J. (2020). T.\nJones, A. (2017). T.\nJones, B. (2016, May). T.\nZed, Q., & Brown, C. (2018). T.\nLeeson, P. (1990). T.\nStanford Institute for AI. (2023). T.\nOther, A. (2000). T.")], "doc_id long, refs string")
    got = {(r.bucket, r.citation or r.reference, r.severity, ",".join(r.reference_years or [])) for r in citations.issues(citations.parsed(body), citations.entries(refs)).collect()}
    assert got == {
        ("year_mismatch", "(Jones, 2019)", "warning", "2017,2016"), ("co_author_only", "(Brown, 2018)", "warning", ""), ("missing_reference", "(Lee, 2000)", "warning", ""),
        ("missing_reference", "(Nobody, 1999)", "error", ""), ("missing_reference", "(Smyth, 2020)", "error", ""), ("spelling_mismatch", "(Smyth, 2020)", "warning", ""),
        ("uncited_reference", "Zed, Q., & Brown, C. (2018). T.", "warning", ""), ("uncited_reference", "Leeson, P. (1990). T.", "warning", ""), ("uncited_reference", "Other, A. (2000). T.", "warning", ""),
    }


def brute_chunks(text, cap):
    """Greedy packing of paragraphs, written as a plain loop."""
    count = lambda t: len(t.split())
    if count(text) <= cap:
        return [text]
    out, cur = [], ""
    for unit in re.findall(r"(?:[^\n]|\n(?!\n))+(?:\n\n+)?", text):
        if count(unit) > cap:
            out.append(cur)
            cur, rest = "", unit.strip()
            while count(rest) > cap:
                cut = next((m.start() for m in re.finditer(r"(?<=[.!?])\s+", rest) if count(rest[: m.start()]) >= cap), None)
                if cut is None:
                    break
                out.append(rest[:cut])
                rest = rest[cut:]
            out.append(rest)
        elif count(cur) + count(unit) > cap and cur:
            out.append(cur)
            cur = unit
        else:
            cur += unit
    return [c.strip() for c in [*out, cur] if c.strip()]


def test_chunks(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        texts.append("\n\n".join(" ".join("word" + rng.choice([".", "", "", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for cap in (20, 55):
        got = {r.i: r.c for r in df.selectExpr("i", f"{edits.chunks('t', cap)} AS c").collect()}
        assert got == {i: brute_chunks(t, cap) for i, t in enumerate(texts)}


def test_screening(spark):
    text = "It grew (Smith, 2020) at last. The parts were late."
    answer = '```json\n[{"original": "The parts were late.", "revised": "Parts came late.", "reason": "x"}, {"original": "Gone.", "revised": "Here."}, {"original": "It grew (Smith, 2020) at last.", "revised": "It grew (Jones, 2020) at last."}, {"original": "", "revised": "x"}]\n```'
    df = spark.createDataFrame([(1, text, answer), (2, text, "no json"), (3, text, 'Sure: [{"original": "The  parts were late.", "revised": "They were."}] ok')], "doc_id long, text string, answer string")
    got = edits.screened(df).orderBy("doc_id", "item").collect()
    assert [(r.doc_id, r.status, r.reason) for r in got] == [(1, "kept", "x"), (1, "not_found", "unspecified"), (1, "citation_lock", "unspecified"), (1, "skipped", "unspecified"), (3, "kept", "unspecified")]
    for r in got:
        ratio = distance(r.original, r.revised) / max(len(r.original), len(r.revised))
        assert r.change_ratio == pytest.approx(ratio, abs=0.0006) and r.edit_type == ("heavy" if ratio > 0.4 else "light")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_annotation_rows_without_repeats(spark):
    cols = "doc_id long, kind string, label string, severity string, idx int, message string, fix string, target string, seq int"
    df = spark.createDataFrame([(1, "Rule", "A", "WARNING", 0, "m", "f", " X  y", 1), (1, "rule", "a", "warning", 0, "longer", "f", "x y", 2), (1, "Rule", "B", "INFO", None, "m", "", "t", 3), (1, "Rule", "C", "INFO", 4, "m", "", "t", 4)], cols)
    got = annotate.in_order(annotate.without_repeats(df)).collect()
    assert [(r.idx, r.message, r.seq) for r in got] == [(4, "m", 4), (0, "longer", 1), (None, "m", 3)]


@pytest.mark.parametrize("text, target, want", [("One here. Two there.", "Two", (10, 13)), ("One here. Two there.", "two THERE", (10, 19)), ("One here. Two there.", "something there", (9, 20)), ("One here. Two.", "zzz", (0, 9)), ("...", "zzz", (0, 3))])
def test_target_span(spark, text, target, want):
    r = spark.createDataFrame([(text, target)], "text string, target string").selectExpr(f"{annotate.target_span()} AS x").first().x
    assert (r.s, r.e) == want


def test_balances_floor_at_zero_in_order(spark):
    rng, events, want = random.Random(4), [], {}
    for user in range(20):
        b = 0
        for n in range(30):
            d = rng.choice([-1, -1, 2])
            b = max(0, b + d) if d < 0 else b + d
            events.append((user, n, d))
        want[user] = b
    df = spark.createDataFrame(events, "user_id int, seq int, delta int")
    assert {r.user_id: r.balance for r in ledger.balances(df).collect()} == want


def test_passes_and_fulfilment(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    passes = spark.createDataFrame([(1, "active", t(1), t(9)), (2, "active", t(6), t(9)), (3, "revoked", t(1), t(9)), (4, "active", t(1), t(5))], "user_id int, status string, starts_at timestamp, expires_at timestamp")
    assert [r.user_id for r in ledger.active(passes, "2024-01-05").collect()] == [1]
    old = spark.createDataFrame([("e1",)], "event_id string")
    new = spark.createDataFrame([("e1", 1, t(1)), ("e2", 2, t(2)), ("e2", 2, t(2))], "event_id string, user_id int, paid_at timestamp")
    events, made = ledger.fulfilled(old, passes, new)
    assert [r.event_id for r in events.collect()] == ["e2"] and made.first().expires_at == dt.datetime(2024, 2, 1)


def test_feedback(spark):
    df = spark.createDataFrame([("n", " ", "long enough text", ""), ("n", "c", "short", ""), ("n", "c", "long enough text", "spam"), ("n" * 121, "c", "long enough text", None)], "name string, contact string, message string, website string")
    assert [tuple(r) for r in ledger.valid_feedback(df).collect()] == [("n", None, "long enough text")]


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(paragraphs_):
    """A file of (style, text, bold, italic, paragraph properties)."""
    body = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}{extra}</w:pPr><w:r><w:rPr>{"<w:b/>" * b}{"<w:i/>" * i}</w:rPr><w:t>{t}</w:t></w:r></w:p>' for s, t, b, i, extra in paragraphs_)
    styles = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/styles.xml", styles)
        z.writestr("[Content_Types].xml", "<Types></Types>")
    return out.getvalue()


def test_word_files(spark, tmp_path):
    indent, quote, number = '<w:ind w:firstLine="720"/>', '<w:ind w:left="720"/>', "<w:numPr/>"
    data = word_file([
        ("", "Ann Author", 0, 0, ""), ("H1", "Methods", 0, 0, ""), ("", "Body text is here. It goes on.", 0, 0, indent), ("", "Sub head", 1, 0, ""), ("", "Lower head", 1, 1, ""), ("", "A quotation that stands apart. It is long.", 0, 0, quote),
        ("", "an item", 0, 0, number), ("", "Table 1", 0, 0, ""), ("", "Means of all the groups in the study by year", 0, 0, ""), ("H1", "References", 0, 0, ""), ("", "Lee, A. (2020). On rivers. Journal of Rivers, 30, 1-9.", 0, 0, ""),
    ])
    (tmp_path / "a.docx").write_bytes(data)
    p = structure.classified(docx.read(spark, str(tmp_path))).orderBy("idx").collect()
    assert [(r.idx, r.level, r.is_ref, r.is_list) for r in p] == [(0, 0, False, False), (1, 1, False, False), (2, None, False, False), (3, 2, False, False), (4, 3, False, False), (6, 0, False, True), (7, 0, False, False), (8, 0, False, False), (9, 1, False, False), (10, None, True, False)]
    assert p[2].indent == 720 and p[-1].italic_ok is False and p[-1].italic_excerpt == "Journal of Rivers, 30"
    out = docx.annotate(data, [(2, 5, 9, "WARNING", "look\nhere")])
    assert [r[2] for r in docx.read_paragraphs(out)] == [r[2] for r in docx.read_paragraphs(data)]
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        doc, notes = z.read("word/document.xml").decode(), z.read("word/comments.xml").decode()
    assert "commentRangeStart" in doc and '"yellow"' in doc and "look" in notes


def test_annotated_files(spark):
    data = word_file([("", "Body text is here.", 0, 0, "")])
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data))], "path string, content binary")
    notes = spark.createDataFrame([("a", 0, 5, 9, "ERROR", "look")], "path string, idx int, s int, e int, severity string, comment string")
    got = {r.path: bytes(r.content) for r in docx.annotated(files, notes).collect()}
    with zipfile.ZipFile(io.BytesIO(got["a"])) as z:
        assert '"red"' in z.read("word/document.xml").decode() and "look" in z.read("word/comments.xml").decode()
    assert docx.read_paragraphs(got["b"]) == docx.read_paragraphs(data)


def test_reference_text(spark):
    p = rows(spark, [(None, False, True, "B"), (None, False, False, "x"), (None, False, True, "A")])
    assert paragraphs.reference_text(p).first().refs == "B\nA"


@pytest.mark.parametrize(
    "answer, want",
    [
        ('["x", {"original": "a", "revised": "b"}, 5, null]', [None, ("a", "b", None), None, None]),
        ('```json\n[{"original": "a", "revised": "b", "reason": "c"}]\n```', [("a", "b", "c")]),
        ('so: [{"original": 5, "revised": "b"}] it is', [(None, "b", None)]),
        ("nothing", []),
        ("[broken", []),
        ("", []),
        ('{"original": "a"}', []),
    ],
)
def test_items_that_are_no_objects_cost_nothing_else(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "answer string").selectExpr(f"{edits.payload('answer')} AS x")
    assert [tuple(x) if x else None for x in df.first().x] == want


def test_control_characters_stay_where_they_are(spark):
    from quillspark.operators import findings
    from quillspark.operators.rules import RULES, Config

    text = "\x01\x02\x03a The end result came."
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, idx int, r string").selectExpr("*", "r AS m", "cast(null AS int) AS level", "false AS is_ref")
    (row,) = findings.paragraph_findings(df, Config(), tuple(r for r in RULES if r.rule_id == "STY002")).collect()
    assert (row.s, row.e, row.replacement) == (text.index("end"), text.index("end") + 10, "result")
    assert parse(spark, "\x01\x02It grew (Smith, 2020).")[0][-1] == 10


def test_running_sums_of_long_arrays(spark):
    from quillspark.functions.regex import running

    rng = random.Random(4)
    for n in (0, 1, 255, 256, 257, 3000):
        xs = [rng.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "x array<int>").selectExpr(f"{running('x')} AS s").first().s
        assert got == [sum(xs[:k]) for k in range(n)]


def test_issues_meet_groups_co_authors_lists_and_lower_case(spark):
    body = "It grew (Jones, 2019; Institute, 2020) and (Second, 2018), as pwc (2024) and Ministry (2021) and Ann (2020) say."
    refs = "First, A., & Second, B. (2018). T.\nInstitute of Rivers. (2020). T.\nPwC. (2024). T.\nMinistry of Towns. (2021). T.\nAnna, B. (2020). T.\nSolo, B. (2000). T."
    texts = spark.createDataFrame([(1, 0, body)], "doc_id long, idx int, text string")
    c, r = citations.parsed(texts), citations.entries(spark.createDataFrame([(1, refs), (2, "Alone, A. (1999). T.")], "doc_id long, refs string"))
    assert {(x.author, x.branch) for x in citations.matched(c, r).collect()} == {("jones", "missing"), ("institute", "co_author_only"), ("second", "co_author_only"), ("pwc", "exact"), ("ministry", "co_author_only"), ("ann", "substring")}
    assert sorted((x.doc_id, x.first_author) for x in citations.uncited(c, r).collect()) == [(1, "anna"), (1, "first"), (1, "institute of rivers"), (1, "ministry of towns"), (1, "solo"), (2, "alone")]
    assert [(x.author, x.first_author, x.distance) for x in citations.misspelt(c, r).collect()] == [("ann", "anna", 1)]


def test_invites_go_once(spark):
    at = dt.datetime(2024, 1, 1)
    invites = spark.createDataFrame([(1, "a@b.org", 5, "active", None), (2, "c@b.org", 5, "active", at), (3, "d@b.org", 5, "revoked", None)], "id int, email string, duration_days int, status string, invite_expires_at timestamp")
    asked = spark.createDataFrame([(7, " A@B.org", at + dt.timedelta(1)), (8, "a@b.org", at), (9, "c@b.org", at), (9, "d@b.org", at)], "user_id int, email string, at timestamp")
    after, passes = ledger.redeemed(invites, asked)
    assert {r.id: (r.status, r.redeemed_by) for r in after.collect()} == {1: ("redeemed", 8), 2: ("active", None), 3: ("revoked", None)}
    assert [(r.user_id, r.source, r.expires_at) for r in passes.collect()] == [(8, "invite:1", at + dt.timedelta(5))]
    again, none = ledger.redeemed(after, asked)
    assert none.count() == 0 and {r.id: r.status for r in again.collect()}[1] == "redeemed"


def test_links_keep_a_hash_alone(spark, tmp_path):
    token, row = ledger.new_link(spark, dt.datetime(2024, 1, 1), "tester")
    held = row.first()
    assert len(token) == 43 and token not in str(held) and held.expires_at == dt.datetime(2024, 1, 31)
    ledger.appended(row, str(tmp_path / "links"))
    ledger.appended(ledger.new_link(spark, dt.datetime(2024, 1, 2))[1], str(tmp_path / "links"))
    back = spark.read.parquet(str(tmp_path / "links"))
    assert back.count() == 2 and ledger.active_link(back, F.lit(token), "2024-01-05").first().label == "tester"
    assert (tmp_path / "links" / "status=active").is_dir()
    with pytest.raises(ValueError):
        ledger.new_link(spark, dt.datetime(2024, 1, 1), "a@b.org")
    assert ledger.labels_allowed(spark.createDataFrame([("a@b",), (None,), ("x",)], "label string")).count() == 2


def test_test_mode_and_added_credits(spark):
    r = spark.createDataFrame([(1, "r", 9999, False)], "user_id int, request_id string, words int, is_trial boolean")
    e = ledger.added(spark.createDataFrame([(1, 1, 3)], "user_id int, seq int, amount int"))
    seen, trials = spark.createDataFrame([], "request_id string"), spark.createDataFrame([], "user_id int")
    assert tuple(ledger.decided(r, e, seen, trials, test_mode=True).first())[2:] == (True, "test_mode", 999)
    assert tuple(ledger.decided(r, e, seen, trials).first())[2:] == (False, "word_cap_exceeded", 3)


def test_styles_of_a_file(spark):
    row = {"style": "Quote", "text": "x" * 100, "all_bold": False, "all_italic": False, "centered": False, "page_break": False, "numbered": False, "left_indent": None, "in_table": False}
    files = spark.createDataFrame([("f", docx.write_paragraphs([row, row | {"in_table": True}, row | {"text": "<&>"}]))], "path string, content binary")
    assert [tuple(r) for r in docx.styles_of(docx.read_files(files)).orderBy("idx").collect()] == [("f", 0, "Quote", "x" * 80), ("f", 1, "Quote", "<&>")]


@pytest.mark.parametrize("name, want", [("a b.docx", "a_b_reviewed.docx"), ("é.docx", "document_reviewed.docx"), ("x/y.tar.docx", "y.tar_reviewed.docx"), ("..", "document_reviewed.docx"), ("plain", "plain_reviewed.docx")])
def test_download_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").selectExpr(docx.download_name("n")).first()[0] == want


def test_small_word_files_share_batches_and_are_sound_zip_files():
    import pyarrow as pa

    row = {"style": "Quote", "text": "A & é", "all_bold": True, "all_italic": False, "centered": False, "page_break": True, "numbered": False, "left_indent": None, "in_table": False}
    listed = [[row | {"idx": i, "text": f"{k} {i}"} for i in range(k % 7)] for k in range(900)]
    written = list(docx._write_batches([pa.RecordBatch.from_pylist([{"path": str(k), "rows": rs} for k, rs in enumerate(listed)])]))
    contents = [c for b in written for c in b.column("content").to_pylist()]
    assert len(written) == 1 and all(zipfile.ZipFile(io.BytesIO(c)).testzip() is None for c in contents[:20])
    read = list(docx._read_batches([*written, pa.RecordBatch.from_pylist([{"path": "x", "content": b"no"}])]))
    rows = [r for b in read for r in b.to_pylist()]
    assert len(read) == 2 and [(r["doc_id"], r["idx"], r["text"]) for r in rows[:-1]] == [(str(k), i, r["text"]) for k, rs in enumerate(listed) for i, r in enumerate(rs)]
    assert all(r["all_bold"] and r["page_break"] and r["style"] == "Quote" and r["error"] is None for r in rows[:-1]) and rows[-1]["error"].startswith("BadZipFile")


def test_tasks_follow_the_size_of_files(spark, tmp_path, monkeypatch):
    from quillspark.functions import partitions

    spark.range(20000).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS idx", "'Rule' AS kind", "'l' AS label", "'ERROR' AS severity", "sha2(string(id), 256) AS target", "'m' AS message", "'f' AS fix", "named_struct('part', 0, 'a', id) AS seq").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    size = partitions.file_bytes(t)
    assert partitions.file_bytes(t.union(t)) == 2 * size > 100_000 and partitions.file_bytes(spark.range(9)) == 0
    assert partitions.spread(t, "doc_id", task_bytes=-(-size // 40)).rdd.getNumPartitions() == 40
    assert partitions.spread(t, "doc_id", task_bytes=size).rdd.getNumPartitions() == t.rdd.getNumPartitions()
    monkeypatch.setattr(partitions, "TASK_BYTES", -(-size // 40))
    rows = annotate.without_repeats(t)
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 20000


def test_long_units_are_cut_in_time_that_follows_their_length(spark):
    import time

    text = " ".join(f"Word {i} stands here (Lee, 2020) and goes on to its end{'.?!'[i % 3]}" for i in range(6000))
    start = time.time()
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{edits.chunks('t', 300)} AS c").first().c
    assert time.time() - start < 60 and got == brute_chunks(text, 300)
