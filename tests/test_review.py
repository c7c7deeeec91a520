"""The services as whole plans."""

import json

from pyspark.sql import functions as F

from quillspark.operators import ledger, titles
from quillspark.operators.references import ENTRY_RULES
from quillspark.operators.rules import BY_ID, Config
from quillspark.plans import review

BODY = "Intro\n\nThe end result was given (Smith, 2020). They don't know it (Nobody, 1999).\n\nMore of it follows here. It ends."


def test_every_rule_has_a_title():
    assert set(titles.TITLES) >= set(BY_ID) | {r[0] for r in ENTRY_RULES} and len(titles.TITLES) == 133


def test_every_rule_says_what_to_do():
    from quillspark.operators.rules import REPLACEMENTS

    assert set(titles.ADVICE) | set(REPLACEMENTS) == set(titles.TITLES) and set(titles.SECTIONS) == set(titles.TITLES)


def test_fixes_and_messages(spark):
    found, _, _ = review.check_texts(spark.createDataFrame([(1, "The end result was 45 percent. He's 6 of 9 there.")], "doc_id long, text string"))
    got = {r.rule_id: (r.message, r.fix) for r in found.collect()}
    assert got["STY002"] == ("APA §4.5: Redundant phrase. Found: 'end result'.", "Replace 'end result' with 'result'")
    assert got["MEC006"][1] == "Replace '45 percent' with '45%'" and got["STY009"][1] == "Replace 'He's' with 'expand this contraction'"
    assert got["PRF001"][1].startswith("Add") if "PRF001" in got else True


def test_a_review_stops_at_a_documents_first_error(spark):
    def model(text):
        if "bad" in text:
            raise RuntimeError("no answer")
        return json.dumps([{"original": text, "revised": text + " Yes."}])

    chunks = spark.createDataFrame([(1, 0, "one"), (1, 1, "bad"), (1, 2, "three"), (2, 0, "four")], "doc_id long, chunk int, text string")
    said = review.answered(chunks, model)
    assert sorted((r.doc_id, r.chunk, r.error) for r in said.collect()) == [(1, 0, None), (1, 1, "no answer"), (2, 0, None)]
    asked = spark.createDataFrame([(1, 5, "a", False), (2, 6, "b", True)], "doc_id long, user_id int, request_id string, is_trial boolean")
    responses, kept, done = review.review_run(asked, said)
    assert {r.doc_id: (r.status, r.completed, r.error) for r in responses.collect()} == {1: ("error", 1, "no answer"), 2: ("ok", 1, None)}
    assert kept.count() == 2
    charged, seen, trials = ledger.committed(done)
    assert [(r.user_id, r.delta) for r in charged.collect()] == [(5, -1)] and {r.request_id for r in seen.collect()} == {"a_chunk0", "b_chunk0"} and [r.user_id for r in trials.collect()] == [6]


def test_orders(spark):
    rows = spark.createDataFrame([(1, "b", None, None, None, 2, None, "x"), (1, "a", 1, 1, 0, None, "c", None), (1, "b", 1, 1, 0, None, "a", None)], "doc_id int, bucket string, page int, para_on_page int, idx int, line int, citation string, reference string")
    assert [(r.bucket, r.citation, r.line) for r in review.issues_for_reader(rows).collect()] == [("a", "c", None), ("b", "a", None), ("b", None, 2)]


def test_check_texts(spark):
    texts = spark.createDataFrame([(1, BODY + "\nReferences\nSmith, J. (2020). T.\nOther, B. (2001). T."), (2, "No list here. It ends.")], "doc_id long, text string")
    found, issues, stats = review.check_texts(texts)
    rules = [r.rule_id for r in found.filter("doc_id = 1").orderBy("rule_id").collect()]
    assert rules == ["STY001", "STY002", "STY009"]
    assert sorted((r.bucket, r.page) for r in issues.collect()) == [("missing_reference", 1), ("uncited_reference", None)]
    got = {r.doc_id: r for r in stats.collect()}
    assert (got[1].paragraphs, got[1].findings, got[1].citations, got[1].references, got[1].scope_warning) == (3, 3, 2, 2, None)
    assert got[2].scope_warning == review.NO_LIST
    out = {r.doc_id: json.loads(r.result) for r in review.as_json(found, issues, stats).collect()}
    assert [f["rule_id"] for f in out[1]["findings"]] == rules and out[1]["missing_reference"][0]["citation"] == "(Nobody, 1999)"
    notes = review.annotations(found, issues).collect()
    assert [n.label for n in notes if n.idx == 1] == ["Missing reference", "Contraction", "Passive voice", "Redundant phrase"]
    assert notes[-1].idx is None and notes[0].comment.startswith("Citation: Missing reference\nSeverity: ERROR")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("prose_rules:\n  min_sentences_per_paragraph: 3\n  numeral_threshold: 5\n  personal_pronouns: [I]\nheading_rules:\n  flag_skipped_heading_levels: false\n")
    assert review.config(str(tmp_path / "c.yaml")) == Config(min_sentences=3, numeral_threshold=5, flag_skipped_levels=False)


def test_gate(spark):
    r = spark.createDataFrame([(1, 1, "w " * 10, False, False), (2, 1, "w " * 30, False, False), (3, 1, "w " * 30, False, True), (4, 2, "w", False, False), (5, 2, "w", True, False)], "doc_id int, user_id int, text string, is_trial boolean, confirmed boolean")
    b = spark.createDataFrame([(1, 2)], "user_id int, balance int")
    got = {x.doc_id: (x.chunks, x.state) for x in review.gate(r, b, 20, 10).collect()}
    assert got == {1: (1, "go"), 2: (2, "oversized_confirmation"), 3: (2, "go"), 4: (1, "no_credits"), 5: (1, "go")}


def test_reviewed(spark):
    texts = spark.createDataFrame([(1, "The door was open.\n\nThe gate was shut.")], "doc_id long, text string")
    got = [(r.chunk, r.original, r.revised, r.status) for r in review.reviewed(texts, 4).orderBy("chunk").collect()]
    assert got == [(0, "The door was open.", "The door is open.", "kept"), (1, "The gate was shut.", "The gate is shut.", "kept")]
    model = lambda t: json.dumps([{"original": t, "revised": t + " Yes."}])
    assert review.reviewed(texts, 4, model).filter(F.col("status") == "kept").count() == 2
