"""Sentences with known findings, from which manuscripts are made.

Each is (rule, text); [[ ]] stands round what the rule finds, once, at that place. A text without marks is one
in which the rule finds nothing. OTHERS lists what other rules of the same family find in a text; nothing else is
found in it by that family. REPLACED has what findings put in the place of their match; SEVERITIES how severe they are.
"""

from __future__ import annotations

LONG_QUOTE = " ".join(["word"] * 41)

TEMPLATES = (
    ("MEC001", "The trial ended early[[.  ]]Nobody knew why it did."),
    ("MEC001", "The trial ended early. Nobody knew why it did."),
    ("MEC002", "[[14]] people came to the first meeting of the year."),
    ("MEC002", "People came to the first meeting, all 14 of them."),
    ("MEC003", "We kept [[6]] notebooks on the shelf."),
    ("MEC003", "It follows from Table 6 that it grew."),
    ("MEC003", "They waited for 6 weeks before the test."),
    ("MEC003", "Adults aged 6 or more could join in."),
    ("MEC004", "There were [[fifteen]] notebooks on the shelf."),
    ("MEC004", "They left. Fifteen notebooks were on the shelf."),
    ("MEC004", "They met the twelve Apostles there."),
    ("MEC006", "Nearly [[45 percent]] agreed with it."),
    ("MEC006", "Nearly half agreed with it."),
    ("MEC007", "The effect held, [[p = 0.03]] in all."),
    ("MEC007", "The effect held, p = .03 in all."),
    ("MEC008", "The link was close, [[r = 0.42]] in all."),
    ("MEC008", "The link was close, r = .42 in all."),
    ("MEC009", "The effect held, [[p < .05]] in all."),
    ("MEC009", "The effect held, p < .001 in all."),
    ("MEC010", "The town has [[48200]] inhabitants now."),
    ("MEC010", "The town grew in 1998 most of all."),
    ("MEC010", "The serial number was Model 48200 then."),
    ("MEC011", "Music of the [[1980's]] came back."),
    ("MEC011", "Music of the 1980s came back."),
    ("MEC012", "One thing[[ — ]]the last one counted."),
    ("MEC012", "One thing—the last one counted."),
    ("MEC013", "A [[highly-skilled]] crew came."),
    ("MEC013", "A friendly-looking crew came."),
    ("MEC014", "It took [[45 minutes]] to read."),
    ("MEC014", "It took 45 min to read."),
    ("MEC015", "It held [[12 kgs]] of rice."),
    ("MEC015", "It held 12 kg of rice."),
    ("MEC017", "Here is [[a study of]] rivers and towns."),
    ("MEC018", "It is shown in [[figure 12]] of the book."),
    ("MEC018", "It is shown in Figure 12 of the book."),
    ("MEC019", "It is told on [[Page 12]] of the book."),
    ("MEC019", "It is told on page 12 of the book."),
    ("MEC020", f'He said [["{LONG_QUOTE} {LONG_QUOTE}"]] and left.'),
    ("MEC021", 'He said [["first...then"]] and left.'),
    ("MEC021", 'He said "first... then" and left.'),
    ("MEC022", "They used [[12 15-]]point scales in it."),
    ("MEC022", "They used twelve 15-point scales in it."),
    ("MEC024", "The sea[[ - ]]deep and cold, it seems."),
    ("MEC024", "The sea-deep cold, it seems."),
    ("MEC025", "It came in the [[4th]] year."),
    ("MEC025", "It came in the 14th year."),
    ("MEC026", "The new [[Director]] spoke at noon."),
    ("MEC026", "The new director spoke at noon."),
    ("MEC027", "Then [[dean Ann Lee]] spoke at noon."),
    ("MEC027", "Then the dean spoke at noon."),
    ("MEC028", 'He said [["...]]later" and left.'),
    ("MEC031", "They stayed for [[three weeks]] in all."),
    ("MEC031", "Three weeks went by."),
    ("MEC032", "There were parts[[: (1) one part, (2) another part]]."),
    ("STY001", "The door [[was painted]] in the spring."),
    ("STY001", "The sample was selected in the spring."),
    ("STY002", "The [[end result]] pleased them."),
    ("STY002", "The result pleased them."),
    ("STY003", "They met [[in order to]] talk."),
    ("STY003", "They met to talk."),
    ("STY004", "The [[students that completed]] it left."),
    ("STY004", "The students who completed it left."),
    ("STY005", "A plan[[ which]] nobody read lay there."),
    ("STY005", "A plan, which nobody read, lay there."),
    ("STY006", "[[Based on the poll, the study]] moved on."),
    ("STY006", "Based on the poll, we moved on."),
    ("STY007", "There is [[a lot of]] rain here."),
    ("STY007", "There is much rain here."),
    ("STY008", "Then [[the present author]] went home."),
    ("STY008", "Then we went home."),
    ("STY009", "They [[don't]] know it."),
    ("STY009", "They do not know it."),
    ("STY010", "[[This shows]] a change."),
    ("STY010", "This finding shows a change."),
    ("STY011", "Some tools, [[e.g.]] saws, are old."),
    ("STY011", "Some tools (e.g., saws) are old."),
    ("STY012", "See [[ibid]]. for more."),
    ("STY013", "Here [[it would appear]] that it rains."),
    ("STY013", "Here it appears that it rains."),
    ("STY014", "It was dry[[, while]] the coast got rain."),
    ("STY014", "They read while the coast got rain."),
    ("STY015", "Here [[the study argues]] for more."),
    ("STY015", "Here the study found more."),
    ("STY016", "People with [[Bipolar Disorder]] came."),
    ("STY016", "People came. Bipolar Disorder was named."),
    ("BFL001", "They wrote of [[seniors]] in it."),
    ("BFL001", "They wrote of older adults in it."),
    ("BFL002", "They wrote of [[the elderly]] in it."),
    ("BFL003", "They wrote of [[elderly people]] in it."),
    ("BFL004", "They wrote of [[the aged]] in it."),
    ("BFL005", "They wrote of [[aging dependents]] in it."),
    ("BFL006", "They wrote of a [[wheelchair-bound]] man."),
    ("BFL007", "They wrote of one [[confined to a wheelchair]] then."),
    ("BFL008", "They wrote of an [[AIDS victim]] then."),
    ("BFL009", "They wrote of a [[brain-damaged]] man."),
    ("BFL010", "They wrote of [[handicapped]] people."),
    ("BFL011", "They wrote of [[the disabled]] in it."),
    ("BFL012", "They wrote of [[the blind]] in it."),
    ("BFL013", "They wrote of [[the deaf]] in it."),
    ("BFL014", "They wrote of [[the mentally ill]] in it."),
    ("BFL015", "They wrote of a [[cripple]] in it."),
    ("BFL016", "They wrote of a [[schizophrenic]] man."),
    ("BFL016", "They wrote of a schizophrenic disorder."),
    ("BFL017", "They asked if [[(s)he]] knew."),
    ("BFL018", "They asked if [[he or she]] knew."),
    ("BFL018A", "Then [[the student read his]] book."),
    ("BFL018A", "Then the student left. He read his book."),
    ("BFL019", "They asked for [[birth sex]] too."),
    ("BFL020", "They asked for [[preferred pronouns]] too."),
    ("BFL021", "They asked a [[policeman]] too."),
    ("BFL022", "They asked a [[fireman]] too."),
    ("BFL023", "They asked a [[stewardess]] too."),
    ("BFL024", "They asked a [[mailman]] too."),
    ("BFL025", "They wrote of [[mankind]] too."),
    ("BFL026", "They asked the [[chairman]] too."),
    ("BFL026A", "They wrote of [[manpower]] too."),
    ("BFL027", "An old form had the term [[Negro]] on it."),
    ("BFL028", "An old form had the term [[Afro-American]] on it."),
    ("BFL029", "An old form had the term [[Oriental]] on it."),
    ("BFL030", "An old form had the term [[Eskimo]] on it."),
    ("BFL031", "An old form had the term [[Asian-American]] on it."),
    ("BFL032", "An old form had the term [[African-American]] on it."),
    ("BFL033", "An old form had the term [[Caucasian]] on it."),
    ("BFL033", "An old form had the term caucasian on it."),
    ("BFL034", "They asked for [[natal sex]] too."),
    ("BFL035", "They wrote of the [[opposite sex]] too."),
    ("BFL_SO1", "They wrote of [[sexual preference]] too."),
    ("BFL_SO2", "An old form had the term [[homosexual]] on it."),
    ("CIT001", "It grew [[(Smith and Jones, 2020]]) at last."),
    ("CIT001", "It grew (Research Institute and Office, 2020) at last."),
    ("CIT002", "Then, [[Smith & Jones (2020]]) agreed."),
    ("CIT002", "In it Smith and Jones (2020) agreed."),
    ("CIT003", "It grew [[(Smith, Jones, & Brown, 2020)]] at last."),
    ("CIT003", "It grew (Smith et al., 2020) at last."),
    ("CIT004", "It grew [[(Smith, 2020; Adams, 2019)]] at last."),
    ("CIT004", "It grew (Adams, 2019; Smith, 2020) at last."),
    ("CIT005", "It grew (Smith [[et al]], 2020) at last."),
    ("CIT005", "It grew (Smith et al., 2020) at last."),
    ("CIT006", "It grew [[(Smith, no date)]] at last."),
    ("CIT006", "It grew (Smith, n.d.) at last."),
    ("CIT007", 'He said [["it grows" (Smith, 2020)]] at last.'),
    ("CIT007", 'He said "it grows" (Smith, 2020, p. 4) at last.'),
    ("CIT011", "[[]]Here Smith (2020) spoke. Here Smith (2020) left."),
    ("CIT011", "Here Smith (2020) spoke. There Jones (2020) left."),
    ("CIT012", "It grew [[(Ann Smith, 2020]]) at last."),
    ("CIT014", "[[]]He knew (A. Lee, personal communication, May 4, 2020)."),
    ("CIT019", "[[]]It grew (Smith, 2020), fell (Smith, 2021) and rose (Smith, 2022)."),
    ("CIT019", "It grew (Smith, 2020), fell (Jones, 2021) and rose (Smith, 2022)."),
    ("CIT020", "[[]]He knew (A. Lee, personal communication)."),
    ("CIT020", "He knew (A. Lee, personal communication, May 4, 2020)."),
    ("TBL001", "It is in the [[table above]] too."),
    ("TBL001", "It is in Table 12 too."),
    ("TBL002", "It is in [[Table IV]] too."),
    ("TBL003", "It is in [[Table 12A]] too."),
    ("TBL003", "It is in Figure 12A too."),
    ("TBL006", "[[See Table 12 for]] more."),
    ("PRF001", "[[]]Only one sentence stands here."),
    ("PRF001", "One sentence stands here. Another one follows."),
    ("PRF002", "[[]]One. Two. Three. Four. Five."),
    ("PRF002", "One. Two. Three. Four."),
    ("PRF003", "Then [[we]] left. Nobody came."),
    ("PRF003", "Then they left. Nobody came."),
)

#: Text (without marks) -> (rule, start, match) that other rules of its family find.
OTHERS = {
    "They used twelve 15-point scales in it.": (("MEC004", 10, "twelve"),),
    'He said "...later" and left.': (("MEC021", 8, '"...later"'),),
    "There were parts: (1) one part, (2) another part.": (("MEC003", 19, "1"), ("MEC003", 33, "2")),
    "People came. Bipolar Disorder was named.": (("STY001", 30, "was named"),),
    "They asked for birth sex too.": (("BFL034", 15, "birth sex"),),
    "They asked for natal sex too.": (("BFL019", 15, "natal sex"),),
    "He knew (A. Lee, personal communication).": (("CIT014", 0, ""),),
    "He knew (A. Lee, personal communication, May 4, 2020).": (("CIT014", 0, ""),),
}
REPLACED = {
    ("MEC001", ".  "): ". ", ("MEC003", "6"): "six", ("MEC003", "1"): "one", ("MEC003", "2"): "two", ("MEC006", "45 percent"): "45%", ("MEC007", "p = 0.03"): "p = .03", ("MEC008", "r = 0.42"): "r = .42",
    ("MEC010", "48200"): "48,200", ("MEC011", "1980's"): "1980s", ("MEC012", " — "): "—", ("MEC013", "highly-skilled"): "highly skilled", ("MEC014", "45 minutes"): "45 min", ("MEC018", "figure 12"): "Figure 12",
    ("MEC019", "Page 12"): "page 12", ("MEC024", " - "): "—", ("MEC025", "4th"): "fourth", ("MEC026", "Director"): "director", ("MEC027", "dean Ann Lee"): "Dean Ann Lee", ("MEC028", '"...'): '"', ("MEC031", "three weeks"): "3 weeks",
    ("STY002", "end result"): "result", ("STY003", "in order to"): "to", ("STY004", "students that completed"): "students who completed", ("STY009", "don't"): "do not", ("STY011", "e.g."): "for example", ("CIT005", "et al"): "et al.",
    ("BFL001", "seniors"): "older adults", ("BFL002", "the elderly"): "older adults", ("BFL003", "elderly people"): "older adults", ("BFL004", "the aged"): "older adults", ("BFL005", "aging dependents"): "adults who require care",
    ("BFL006", "wheelchair-bound"): "wheelchair user", ("BFL007", "confined to a wheelchair"): "uses a wheelchair", ("BFL008", "AIDS victim"): "person with AIDS", ("BFL009", "brain-damaged"): "person with a traumatic brain injury",
    ("BFL010", "handicapped"): "person with a disability", ("BFL011", "the disabled"): "people with disabilities", ("BFL012", "the blind"): "people who are blind", ("BFL013", "the deaf"): "people who are deaf",
    ("BFL014", "the mentally ill"): "people with mental illness", ("BFL015", "cripple"): "person with a physical disability", ("BFL016", "schizophrenic"): "person with schizophrenia", ("BFL017", "(s)he"): "they", ("BFL018", "he or she"): "they",
    ("BFL018A", "the student read his"): "their", ("BFL019", "birth sex"): "sex assigned at birth", ("BFL019", "natal sex"): "sex assigned at birth", ("BFL020", "preferred pronouns"): "pronouns", ("BFL021", "policeman"): "police officer",
    ("BFL022", "fireman"): "firefighter", ("BFL023", "stewardess"): "flight attendant", ("BFL024", "mailman"): "mail carrier", ("BFL025", "mankind"): "humankind", ("BFL026", "chairman"): "chair", ("BFL026A", "manpower"): "workforce / staffing / personnel",
    ("BFL027", "Negro"): "Black or African American", ("BFL028", "Afro-American"): "African American", ("BFL029", "Oriental"): "Asian (or specify national/ethnic group)", ("BFL030", "Eskimo"): "Inuit or Yupik (specify group)",
    ("BFL031", "Asian-American"): "Asian American", ("BFL032", "African-American"): "African American", ("BFL033", "Caucasian"): "White or European American (or specify origin)", ("BFL034", "birth sex"): "sex assigned at birth",
    ("BFL034", "natal sex"): "sex assigned at birth", ("BFL035", "opposite sex"): "another sex / another gender", ("BFL_SO1", "sexual preference"): "sexual orientation", ("BFL_SO2", "homosexual"): "gay, lesbian, or bisexual (as appropriate)",
}
#: Rules that aren't warnings; all BFL rules are suggestions.
SEVERITIES = {
    **dict.fromkeys(("MEC011", "STY012", "CIT001", "CIT002", "CIT003", "CIT005"), "error"),
    **dict.fromkeys(("CIT011", "CIT014", "CIT019", "TBL006", "PRF001", "PRF002", "PRF003"), "info"),
    **dict.fromkeys(("MEC017", "STY001", "STY002", "STY003", "STY005", "STY007", "STY010", "STY013", "STY014", "STY015"), "suggestion"),
}
#: Rules that show the paragraph's opening, their match, their quotation, or so many characters after it.
SHOWN = {
    **dict.fromkeys(("MEC017", "CIT011", "CIT014", "CIT019", "CIT020", "PRF001", "PRF002"), "opening"),
    **dict.fromkeys(("CIT003", "CIT004"), "match"),
    **dict.fromkeys(("MEC020", "MEC021"), "quotation"),
    **dict.fromkeys(("CIT001", "CIT002", "CIT007"), 5),
    "MEC002": 40,
}


def expected(rule: str, text: str, start: int, hit: str) -> tuple[str, int, int, str, str]:
    """(severity, start, end, excerpt, replacement) of a finding."""
    end, how = start + len(hit), SHOWN.get(rule)
    if how == "opening":
        excerpt = text[:80]
    elif how == "match":
        excerpt = hit[:80]
    elif how == "quotation":
        excerpt = hit.strip('"')[:80]
    elif how:
        excerpt = text[start : end + how].strip()[:80]
    else:
        excerpt = text[max(0, start - 20) : end + 20].strip()[:80]
    severity = "suggestion" if rule.startswith("BFL") else SEVERITIES.get(rule, "warning")
    return severity, start, end, excerpt, REPLACED.get((rule, hit), "")


#: One reference list: rule or none for each entry, in list order. Keys ascend except where REF018 is meant.
ENTRIES = (
    ("REF001", "Aa, B. (2020). On rivers. http://doi.org/10.1234/abc"),
    ("REF002", "Ab, B. (2020). On rivers. DOI: 10.1234/abc"),
    ("REF003", "Ac, B. (2020). On rivers. Retrieved from https://a.org/x"),
    ("REF004", "Ad, B. (2020). On rivers. Accessed from https://a.org/x"),
    ("REF005", "Ae, B. (2020). On rivers. https://a.org/x."),
    ("REF006", "Af, B. (nd). On rivers. Press."),
    ("REF007", "Ag, B. and Lee, C. (2020). On rivers. Press."),
    ("REF008", "Ah, B., et al. (2020). On rivers. Press."),
    ("REF009", "Ai, B. (2020). On rivers (2nd edition). Press."),
    ("REF022", "Aj, B., Editors. (2020). On rivers. Press."),
    ("REF010", "Ak, B. (2020). On rivers. Press Inc. of York"),
    ("REF011", "Al, B. (2020) On rivers. Press."),
    ("REF012", "Am, B. (in-press). On rivers. Press."),
    ("REF013", "An, B. (2020). On rivers. Journal, 30 (5), 1-9."),
    ("REF014", "Ao, B. (2020). On rivers. Journal, 30, article e12."),
    ("REF015", "Ap, B. (2020). On rivers (C. Lee, Trans.). Press."),
    ("REF016", "Aq, B. (2020). On rivers. Press. First published 1990."),
    ("REF017", "Ar, B. (2020). On 12 kgs of rice. Press."),
    ("REF023", "As, B. (2020). On rivers. Press. ISBN 12345."),
    ("REF024", "At, B. (2020). On Rivers And Their Towns. Press."),
    ("REF025", "Au, B. (2020). On rivers, personal communication. Press."),
    ("REF021", "Av, B. (2020). On rivers. Press."),
    ("REF021", "Av, B. (2020). On lakes. Press."),
    ("REF018", "Aa, C. (2021). On seas. Press."),
    ("", "Aw, B. (2020). On rivers. Press."),
    ("REF019", "Bibliography"),
    ("REF020", "Reference"),
)
