"""A short title for every rule, and findings with label, message and fix made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .references import ENTRY_RULES
from .rules import BY_ID

TITLES = {
    "MEC001": "More than one space after a full stop", "MEC002": "Sentence begins with a numeral", "MEC003": "Digit for a number below ten", "MEC004": "Word for a number of ten or more",
    "MEC006": "Word percent after a numeral", "MEC007": "Leading zero in a p value", "MEC008": "Leading zero in a correlation", "MEC009": "Threshold in place of an exact p value",
    "MEC010": "Large number without commas", "MEC011": "Apostrophe in the plural of a number", "MEC012": "Spaces round an em dash", "MEC013": "Hyphen after an adverb", "MEC014": "Form of a time unit",
    "MEC015": "Plural of a unit symbol", "MEC016": "Abstract over its limit of words", "MEC017": "Wordy title", "MEC018": "Small letter before a number in a series", "MEC019": "Capital in page or paragraph",
    "MEC020": "Long quotation within a paragraph", "MEC021": "Form of an ellipsis in a quotation", "MEC022": "Two numerals next to each other", "MEC023": "First line without its indent", "MEC024": "Spaced hyphen for a dash",
    "MEC025": "Numeral for a small ordinal", "MEC026": "Capital in a job title", "MEC027": "Small letter in a title before a name", "MEC028": "Ellipsis opens a quotation", "MEC029": "Short list items as steps",
    "MEC030": "List items of mixed form", "MEC031": "Word for a number with a unit of time", "MEC032": "Numbered list within a sentence",
    "STY001": "Passive voice", "STY002": "Redundant phrase", "STY003": "Wordy phrase", "STY004": "That for people", "STY005": "Which without a comma", "STY006": "Dangling modifier", "STY007": "Colloquial phrase",
    "STY008": "Author in the third person", "STY009": "Contraction", "STY010": "Bare demonstrative", "STY011": "Latin abbreviation in running text", "STY012": "Use of ibid.", "STY013": "Hedging", "STY014": "While for a contrast",
    "STY015": "Thing that acts like a person", "STY016": "Capitals in the name of a condition",
    "BFL001": "Vague term for age", "BFL002": "Adjective for a group of age", "BFL003": "Term for older people", "BFL004": "Adjective for a group of age", "BFL005": "Term for older people", "BFL006": "Term for a wheelchair user",
    "BFL007": "Term for a wheelchair user", "BFL008": "Term that makes a victim", "BFL009": "Term for an injury", "BFL010": "Term for disability", "BFL011": "Adjective for people with a disability", "BFL012": "Adjective for blind people",
    "BFL013": "Adjective for deaf people", "BFL014": "Adjective for people with an illness", "BFL015": "Slur for disability", "BFL016": "Diagnosis for a person", "BFL017": "Combined pronoun", "BFL018": "Pair of pronouns",
    "BFL018A": "Generic his", "BFL019": "Term for assigned sex", "BFL020": "Term for pronouns", "BFL021": "Gendered occupation", "BFL022": "Gendered occupation", "BFL023": "Gendered occupation", "BFL024": "Gendered occupation",
    "BFL025": "Gendered collective", "BFL026": "Gendered office", "BFL026A": "Gendered collective", "BFL027": "Outdated term for a group", "BFL028": "Outdated term for a group", "BFL029": "Outdated term for a group",
    "BFL030": "Outdated term for a group", "BFL031": "Hyphen in the name of a group", "BFL032": "Hyphen in the name of a group", "BFL033": "Outdated term for a group", "BFL034": "Term for assigned sex", "BFL035": "Binary term for sex or gender",
    "BFL_SO1": "Term for orientation", "BFL_SO2": "Outdated term for orientation",
    "HED001": "Heading level left out", "HED002": "Heading without text",
    "CIT001": "Word and within parentheses", "CIT002": "Ampersand in running text", "CIT003": "Three or more authors in full", "CIT004": "Order of citations", "CIT005": "Form of et al.", "CIT006": "Form of n.d.",
    "CIT007": "Quotation without a page", "CIT011": "Citation repeated in a paragraph", "CIT012": "First name in a citation", "CIT014": "Personal communication", "CIT019": "Source cited too often", "CIT020": "Personal communication without a date",
    "REF001": "Old form of a DOI", "REF002": "Label before a DOI", "REF003": "Words before a URL", "REF004": "Words before a URL", "REF005": "Full stop after a URL", "REF006": "Form of n.d.", "REF007": "Word and between authors",
    "REF008": "Et al. in an entry", "REF009": "Edition in full", "REF010": "Business form in a publisher", "REF011": "Date without a full stop", "REF012": "Form of in press", "REF013": "Space before an issue",
    "REF014": "Small letter in Article", "REF015": "Translation without its original", "REF016": "Form of an original date", "REF017": "Plural of a unit symbol", "REF018": "Order of entries", "REF019": "Heading Bibliography",
    "REF020": "Heading Reference", "REF021": "Same author and year", "REF022": "Editors in full", "REF023": "ISBN or ISSN", "REF024": "Capitals in a title", "REF025": "Personal communication listed", "REF026": "Periodical without italics",
    "TBL001": "Place of a table or figure", "TBL002": "Roman numeral", "TBL003": "Letter after a number", "TBL006": "See for a table or figure",
    "PRF001": "Short paragraph", "PRF002": "Long paragraph", "PRF003": "First-person pronoun",
}


#: What to do about findings that put nothing in the place of their match.
ADVICE = {
    "MEC002": "Let a word begin the sentence, or spell the number out.", "MEC004": "Write the number in numerals.", "MEC009": "Give the exact p value; only below .001 give p < .001.",
    "MEC014": "Write days, weeks and months out in full.", "MEC015": "Take the s off the unit symbol.", "MEC016": "Shorten the abstract to 250 words at most.", "MEC017": "Leave the phrase out and begin with the subject itself.",
    "MEC020": "Set the quotation as a block: indented by 0.5 in. and without quotation marks.", "MEC021": "Put three spaced points (. . .) in place of the ellipsis.", "MEC022": "Spell one of the two numbers out.",
    "MEC023": "Indent the first line by 0.5 in. (1.27 cm).", "MEC029": "Set short items as bullets or letters, not as numbered steps.", "MEC030": "Give all items the same form, case and end mark.", "MEC032": "Set the items as a list of their own, or recast them as a sentence.",
    "STY001": "Recast it in the active voice.", "STY005": "Use that, or put a comma before which if the clause only adds something.", "STY006": "Name who based it on that: Based on it, we found ...", "STY007": "Choose a more formal word.",
    "STY008": "Use I, or we if there are more authors.", "STY010": "Add a noun: This finding shows ...", "STY012": "Repeat the citation in its full or short form.", "STY013": "State it: it appears, it seems, the data suggest.",
    "STY014": "Use although, whereas or but, unless both happen at once.", "STY015": "Name the people who do it, or let findings show or suggest it.", "STY016": "Use small letters unless it is an official title.",
    "HED001": "Use the next level down, without leaving one out.", "HED002": "Write at least one paragraph under the heading.",
    "CIT001": "Join the names by an ampersand.", "CIT002": "Join the names by the word and.", "CIT003": "Shorten it to the first name and et al.", "CIT004": "Sort the citations by first author, then by year.", "CIT006": "Write n.d. with both full stops.",
    "CIT007": "Add the page (p. 3) or the paragraph (para. 3).", "CIT011": "Leave the year out when the name comes again in the paragraph.", "CIT012": "Give the surname alone.", "CIT014": "Keep it out of the reference list.",
    "CIT019": "Cite the source once where it is clear that you go on with it.", "CIT020": "Add the exact date.",
    "REF001": "Begin the DOI with https://doi.org/.", "REF002": "Write the DOI as a link, without a label.", "REF003": "Leave the words before the link out.", "REF004": "Leave the words before the link out.", "REF005": "Take the full stop off the link.",
    "REF006": "Write (n.d.).", "REF007": "Join the last two authors by an ampersand.", "REF008": "List the authors (up to 20) instead of et al.", "REF009": "Shorten it to ed.", "REF010": "Leave the business form out of the publisher's name.",
    "REF011": "Put a full stop after the date.", "REF012": "Write (in press).", "REF013": "Close up the volume and the issue: 30(5).", "REF014": "Write Article with a capital.", "REF015": "Add (Original work published ...).",
    "REF016": "Write (Original work published ...).", "REF017": "Take the s off the unit symbol.", "REF018": "Sort the entries by author.", "REF019": "Name the list References.", "REF020": "Name the list References.",
    "REF021": "Add a, b and so on to the years.", "REF022": "Shorten it to (Ed.) or (Eds.).", "REF023": "Leave the ISBN or ISSN out.", "REF024": "Use capitals only for the first word and for names.", "REF025": "Cite it in the text alone.",
    "REF026": "Set the periodical's title and volume in italics.",
    "TBL001": "Name the table or figure by its number.", "TBL002": "Use Arabic numerals.", "TBL003": "Give it a number of its own.", "TBL006": "Work the reference into a sentence.",
    "PRF001": "Add to the paragraph, or join it to the next one.", "PRF002": "Make two paragraphs of it.", "PRF003": "See whether your programme allows the first person.",
}
SECTIONS = {r.rule_id: r.section for r in BY_ID.values()} | {r[0]: r[2] for r in ENTRY_RULES} | {"HED001": "2.27", "HED002": "2.27", "MEC016": "2.9", "MEC023": "2.24", "MEC029": "6.50-6.51", "MEC030": "6.49", "REF021": "9.47", "REF026": "9.25"}


def labelled(found: DataFrame) -> DataFrame:
    """found with label, message (its section, label and match), fix (the replacement or what to do) and fixable."""
    of = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[F.col("rule_id")]
    title, section = of(TITLES), of({k: v for k, v in SECTIONS.items() if v})
    fixable = F.col("rule_id").isin([r.rule_id for r in BY_ID.values() if r.fixable])
    said = F.concat(F.coalesce(F.concat(F.lit("APA §"), section, F.lit(": ")), F.lit("")), title, F.when(F.col("match") != "", F.concat(F.lit(". Found: '"), F.col("match"), F.lit("'"))).otherwise(""), F.lit("."))
    replaced = F.concat(F.lit("Replace '"), F.col("match"), F.lit("' with '"), F.col("replacement"), F.lit("'"))
    return found.withColumns({"label": title, "message": said, "fix": F.coalesce(replaced, of(ADVICE), F.lit("")), "fixable": fixable})
