"""Six Word files with known rules each, read from files; the last has none at all."""

import pytest

from quillspark.operators import findings
from quillspark.operators.rules import Config
from quillspark.plans import review
from quillspark.sources import docx

PLAIN = {"style": "Normal", "all_bold": False, "all_italic": False, "centered": False, "page_break": False, "numbered": False, "left_indent": None, "in_table": False}


def head(text, level=1):
    return PLAIN | {"style": f"Heading {level}", "text": text}


def body(text, **more):
    return PLAIN | {"text": text} | more


FILES = {
    "1-mechanics": (
        [
            head("Numbers and marks"),
            body("14 people came to the meeting. We kept 6 notebooks, and nearly fifteen were lost. They stayed for three weeks with 2 4-point scales."),
            body("Music of the 1980's reached 48200 listeners. One thing \u2014 the last one \u2014 counted. The sea - deep and cold - stayed."),
            body("It came in the 4th year. The effect held, p = 0.03, p < .05, and r = 0.42."),
            body('She said, "...it came late," and wrote "first...then it ended" at noon.'),
        ],
        "MEC002 MEC003 MEC004 MEC007 MEC008 MEC009 MEC010 MEC011 MEC012 MEC021 MEC022 MEC024 MEC025 MEC028 MEC031",
    ),
    "2-citations": (
        [
            head("Sources"),
            body("It grew (Zane, 2020; Adams, 2019). One team cited (Smith and Jones, 2020), while Hill & Moss (2021) said less."),
            body('It grew (Smith, Jones, Brown, 2020), (Miller et al, 2021) and (Davis, nd). One said "it grows" (Brown, 2018). He knew (A. Lee, personal communication).'),
            body("It grew (Adams, 2019). It fell (Adams, 2019). It rose (Adams, 2019)."),
            head("References"),
            body("Adams, A. (2019). On rivers. Press."),
            body("Brown, B. (2016). On lakes. Press."),
            body("Never, N. (2001). On seas. Press."),
            body("Zane, Z. (2020). On towns. Press."),
        ],
        "CIT001 CIT002 CIT003 CIT004 CIT005 CIT006 CIT007 CIT014 CIT019 CIT020 year_mismatch missing_reference uncited_reference",
    ),
    "3-style": (
        [
            head("Style"),
            body("The door was painted in the spring. The reason is because it rained, and in order to see it, the researcher left."),
            body("Students that completed it left a plan which nobody read. Based on the poll, the study argues for more. This shows a lot of rain."),
            body("It would appear that it rains. While the coast got rain, they stayed. Ibid. is old, and they didn't know."),
            body("Each student may read his book. They asked what he or she read. They wrote of manpower."),
            body("They wrote of seniors, wheelchair-bound people, the disabled, a chairman, Caucasian, African-American and Asian-American names."),
        ],
        "STY001 STY002 STY003 STY004 STY005 STY006 STY007 STY008 STY009 STY010 STY012 STY013 STY014 STY015 BFL001 BFL006 BFL011 BFL018 BFL018A BFL026 BFL026A BFL031 BFL032 BFL033",
    ),
    "4-structure": (
        [
            head("Lists and headings"),
            body("A low head", all_bold=True, all_italic=True),
            body("This text follows it. It goes on for a while."),
            head("Nothing here", 2),
            head("Nor here", 2),
            body("There were three parts: (1) one part of it, (2) another part, and (3) the rest."),
            body("Learning how it came about.", style="List Bullet", numbered=True),
            body("people draw their own maps", style="List Bullet", numbered=True),
            body("To tell how it ends;", style="List Bullet", numbered=True),
            body("The means stand in the table below and in Table IV."),
            body("Short."),
        ],
        "HED001 HED002 MEC030 MEC032 TBL001 TBL002 PRF001",
    ),
    "5-references": (
        [
            head("Entries"),
            body("Here Smith (2020) spoke. There Park (2024) spoke."),
            head("References"),
            body("Aa, B. (2020). On Rivers And Their Towns. River Studies, 30 (5), 1-9. DOI: 10.1234/abc"),
            body("Ab, B. and Lee, C. (no date). On rivers. River Studies, 3(2), 1-9. Retrieved from https://a.org/x."),
            body("Ac, B., et al. (2021). On lakes (2nd edition). Lake Press Inc. York"),
            body("Ad, B. (2021). On seas. Sea Studies, 3(2), 9-15. http://doi.org/10.1234/old"),
            body("Ae, B. (2022) On towns. Town Studies, 5(1), 1-4."),
            body("Af, B. (In Press). On hills. Hill Studies, 5(1), 1-4."),
            body("Ag, B. (2021). On fields (Trans.). Press."),
            body("Ah, B. (2021). On woods. (originally published 1990). Press."),
            body("Ai, B. (2025, March 4). Personal communication."),
            body("Aj, B. (2020). On roads. Press. ISBN 12345"),
        ],
        "REF001 REF002 REF003 REF005 REF006 REF007 REF008 REF009 REF010 REF011 REF012 REF013 REF015 REF016 REF023 REF024 REF025 REF026",
    ),
    "6-nothing": (
        [
            head("Nothing to find"),
            body("Thirty percent of the groups finished over a period of 4 weeks. The president spoke, and President Lee signed it. Gray (2018) puts the means in Table 3.", indent=720),
            body("Table 1"),
            body("Means of All Groups by Year of Study"),
            head("References"),
            body("Gray, A. (2018). Growth in small firms. Organization Studies, 40(7), 989-1010.", italic="Organization Studies, 40"),
        ],
        "",
    ),
}


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, (rows, _) in FILES.items():
        (folder / f"{name}.docx").write_bytes(docx.write_paragraphs(rows))
    (folder / "7-broken.docx").write_bytes(b"PK not a file")
    raw = docx.read(spark, f"file://{folder}").withColumn("doc_id", findings.F.regexp_extract("doc_id", "([^/]+)[.]docx$", 1))
    raw.cache()
    found, issues, _ = review.check_word_files(raw, Config(min_sentences=3))
    wanted = spark.createDataFrame([(n, [r for r in w.split()]) for n, (_, w) in FILES.items()], "doc_id string, rules array<string>")
    return {r.doc_id: r for r in findings.missing_rules(wanted, findings.rule_sets(found, issues)).collect()}, docx.broken(raw).collect()


@pytest.mark.parametrize("name", FILES)
def test_every_wanted_rule_is_found(sets, name):
    assert sets[0][name].missing == []


def test_a_clean_file_has_no_finding(sets):
    assert sets[0]["6-nothing"].unexpected == []


def test_a_broken_file_is_told_and_ends_nothing(sets):
    assert [r.doc_id for r in sets[1]] == ["7-broken"] and "BadZipFile" in sets[1][0].error
