"""Paragraph rules on their own sentences, and against plain regular expressions on mixed text."""

import random
import re

import pytest

from quillspark.functions.regex import QUOTE_MASK, spans
from quillspark.operators import findings, paragraphs
from quillspark.operators.paragraphs import mask
from quillspark.operators.rules import RULES, Config
from quillspark.plans.templates import TEMPLATES

SETTINGS = Config(max_sentences=4, flag_first_person=True)


def table(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, r string")
    return rows.selectExpr("doc_id", "0 AS idx", "r", f"{mask('r')} AS m", "cast(null AS int) AS level", "false AS is_ref")


@pytest.fixture(scope="module")
def found(spark):
    texts = [t.replace("[[", "").replace("]]", "") for _, t in TEMPLATES]
    out = {}
    for family in ("MEC", "STY", "BFL", "CIT", "TBL", "PRF"):
        for r in findings.paragraph_findings(table(spark, texts), SETTINGS, tuple(r for r in RULES if r.family == family)).collect():
            out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("n", range(len(TEMPLATES)), ids=[f"{r}-{n}" for n, (r, _) in enumerate(TEMPLATES)])
def test_template(found, n):
    rule, text = TEMPLATES[n]
    mine = [r for r in found.get(n, []) if r.rule_id == rule]
    if "[[" not in text:
        assert not mine
        return
    start, hit = text.index("[["), text.split("[[")[1].split("]]")[0]
    assert len(mine) == 1
    if hit:
        assert (mine[0].s, mine[0].e, mine[0].match) == (start, start + len(hit), hit)


def test_every_paragraph_rule_has_a_sentence():
    assert {r.rule_id for r in RULES} == {r for r, t in TEMPLATES if "[[" in t}


def test_number_of_rules():
    from quillspark.operators.references import ENTRY_RULES

    structure = {"HED001", "HED002", "MEC016", "MEC023", "MEC029", "MEC030", "REF021", "REF026"}
    assert len({r.rule_id for r in RULES} | {r[0] for r in ENTRY_RULES} | structure) == 133


@pytest.mark.parametrize("pattern, flags", [(r"\b\w+ly\b", "i"), (r"(?<!,)\s+which\b", ""), (r"\.\s{2,}", ""), (r"[^.!?]+[.!?]?", ""), (r"(?:^|(?<=[.!?])\s+)(This|That)\b", "im"), (r"\b(\d+)\s+(\d+)[-–]", "")])
def test_spans_are_finditers(spark, pattern, flags):
    rng = random.Random(1)
    bits = ["Naïvely ", "which ", ", which", ".  ", "\n", "This ", "that ", "12 3-", "🙂", " ", "é", "ly ", "! ", "Ünly", "5–"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(x.s, x.e, x.m) for x in r.f] for r in df.selectExpr("i", f"{spans('t', pattern, flags)} AS f").collect()}
    py = re.compile(pattern, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))
    assert got == {i: [(m.start(), m.end(), m[0]) for m in py.finditer(t)] for i, t in enumerate(texts)}


def test_masked_quotations_hide_findings(spark):
    text = 'He wrote "the end result was given" in it. The end result was not theirs at all, they said.'
    rows = findings.paragraph_findings(table(spark, [text]), SETTINGS, tuple(r for r in RULES if r.rule_id == "STY002")).collect()
    assert [(r.match, QUOTE_MASK in r.excerpt) for r in rows] == [("end result", True)]


def test_title_guard_keeps_raw_offsets(spark):
    # The guard reads the masked text at the raw text's offsets, so a long quotation shifts it.
    texts = ["The Director spoke.", "The Director Ann spoke."]
    rows = findings.paragraph_findings(table(spark, texts), SETTINGS, tuple(r for r in RULES if r.rule_id == "MEC026")).collect()
    assert [(r.doc_id, r.match) for r in rows] == [(0, "Director")]


def test_pasted_text(spark):
    text = "INTRODUCTION\n\n  Body text here. It goes on.  \n\n\n\nTable 1\n\nMeans by group\n\nOne more heading\n\n1. a list item\n\nSmith (2020) said so"
    got = paragraphs.from_text(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("idx").collect()
    assert [(r.idx, r.level, r.para_on_page, r.style) for r in got] == [(0, 1, 0, "Heading 1"), (1, None, 1, "Normal"), (3, 0, 1, "Normal"), (4, 0, 1, "Normal"), (5, 1, 1, "Heading 1"), (6, None, 2, "Normal"), (7, None, 3, "Normal")]


def test_split_pasted(spark):
    df = spark.createDataFrame([(1, " Body.\nMore.\n References \nA, B. (2020)."), (2, "No list")], "doc_id long, text string")
    assert {tuple(r) for r in paragraphs.split_pasted(df).collect()} == {(1, "Body.\nMore.", "A, B. (2020)."), (2, "No list", "")}


def test_findings_are_sorted_and_placed(spark):
    p = paragraphs.from_text(spark.createDataFrame([(1, "HEAD\n\nThe end result was given. It ended.\n\nThey don't know. They left.")], "doc_id long, text string"))
    rows = findings.in_order(findings.findings(p)).collect()
    assert [r.rule_id for r in rows] == ["STY001", "STY002", "STY009"] and rows[0].location.startswith('Page 1, Para 1 - "The end') and rows[0].category == "style"


def test_a_literal_of_each_rule_stands_where_it_matches(spark):
    from quillspark.functions import regex

    assert regex.literals(r"\b(?:which|that)\s+(?:was)?") == ("that", "which") and regex.literals(r"\(1\)\s*x+") == ("(1)",)
    assert regex.literals(r"a|bcd") == regex.literals(r"(?:bcd)?\d") == regex.literals(r"\p{L}bcd") == ()
    known = [r for r in RULES if r.pattern and regex.literals(r.pattern)]
    assert len(known) > 50
    texts = [t.replace("[[", "").replace("]]", "") for _, t in TEMPLATES] + ["The ſeniorſ came.", "Manİ ſpouse manKınd.", "WHEELCHAIR-BOUND"]
    df = spark.createDataFrame([(t,) for t in texts], "m string").selectExpr("m AS low_m", "m", "m AS r").selectExpr("m", "r", f"{regex.folded('m')} AS low_m", f"{regex.folded('r')} AS low_r")
    tests = [(regex.has("m", r.pattern, r.flags), regex.gated(regex.has("m", r.pattern, r.flags), r.pattern, "low_m")) for r in known]
    got = df.selectExpr(*[f"count_if({a}) AS a{n}" for n, (a, _) in enumerate(tests)], *[f"count_if(({a}) <> ({b})) AS b{n}" for n, (a, b) in enumerate(tests)]).first().asDict()
    assert sum(v for k, v in got.items() if k[0] == "a") > 50 and not any(v for k, v in got.items() if k[0] == "b")
    assert df.filter(tests[[r.rule_id for r in known].index("BFL001")][1]).filter("m LIKE '%ſ%'").count() == 1
