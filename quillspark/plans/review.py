"""The services as whole plans over a corpus: checking texts, checking Word files, reviewing with a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import words
from ..operators import annotate, citations, edits, findings, paragraphs, structure, titles
from ..operators.rules import Config

NO_LIST = "No reference list was given, so citations were not compared with one."


def config(path: str) -> Config:
    """Settings from a YAML file with prose_rules, heading_rules and citation_rules; what rules don't read is left."""
    import yaml

    with open(path, encoding="utf-8") as f:
        read = yaml.safe_load(f) or {}
    prose, heads, cites = (read.get(k) or {} for k in ("prose_rules", "heading_rules", "citation_rules"))
    names = {
        "min_sentences": prose.get("min_sentences_per_paragraph"), "max_sentences": prose.get("max_sentences_per_paragraph"), "numeral_threshold": prose.get("numeral_threshold"),
        "flag_repeated_narrative": prose.get("flag_repeated_narrative_citations"), "flag_first_person": prose.get("flag_first_person_pronouns"), "flag_skipped_levels": heads.get("flag_skipped_heading_levels"),
        "flag_heading_without_body": heads.get("flag_heading_without_body"), "spelling_threshold": cites.get("levenshtein_threshold"),
    }
    return Config(**{f.name: names[f.name] for f in fields(Config) if names.get(f.name) is not None})


def placed_issues(issues: DataFrame, table: DataFrame) -> DataFrame:
    """issues with page, para_on_page and location of the citing paragraph."""
    anchor = "concat(trim(substring(r, 1, 60)), IF(length(r) > 60, '...', ''))"
    place = table.selectExpr("doc_id", "idx", "page", "para_on_page", f"concat('Page ', page, ', Para ', para_on_page, ' - \"', {anchor}, '\"') AS location")
    return issues.join(place, ["doc_id", "idx"], "left")


def issues_in_order(issues: DataFrame) -> DataFrame:
    last = F.lit(10**9)
    return issues.orderBy("doc_id", "bucket", F.coalesce("page", last), F.coalesce("para_on_page", last), F.coalesce("idx", "line", last), F.coalesce("line", last), "nth")


def issues_for_reader(issues: DataFrame) -> DataFrame:
    """All issues in one list, by place alone; equal places by what they say."""
    last = F.lit(2**53)
    said = F.concat_ws(": ", "bucket", F.coalesce("citation", "reference"))
    return issues.orderBy("doc_id", F.coalesce("page", last), F.coalesce("para_on_page", last), F.coalesce("idx", last), F.coalesce("line", last), said)


def checked(table: DataFrame, refs: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, issues, one row of counts per document) of a paragraph table; refs: doc_id, refs."""
    found = titles.labelled(findings.findings(table, cfg))
    given = refs.filter("trim(coalesce(refs, '')) <> ''")
    listed = citations.entries(given)
    # Documents without a list are not compared with one.
    cites = citations.parsed(table.filter("NOT is_ref").join(given.select("doc_id"), "doc_id", "left_semi"), "r")
    issues = placed_issues(citations.issues(cites, listed, cfg.spelling_threshold), table)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    stats = count(table, "paragraphs")
    for df, name in ((found, "findings"), (cites, "citations"), (listed, "references")):
        stats = stats.join(count(df, name), "doc_id", "left")
    stats = stats.join(given.select("doc_id", F.lit(True).alias("has_list")), "doc_id", "left").fillna(0, ["findings", "citations", "references"])
    return found, issues, stats.withColumn("scope_warning", F.when(F.col("has_list").isNull(), NO_LIST)).drop("has_list")


def check_texts(texts: DataFrame, cfg: Config = Config(), separator: str = "\n\n") -> tuple[DataFrame, DataFrame, DataFrame]:
    """checked() for pasted texts (doc_id, text): a list after a line References is the bibliography."""
    cut = paragraphs.split_pasted(texts)
    return checked(paragraphs.from_text(cut.select("doc_id", F.col("body").alias("text")), separator), cut.select("doc_id", "refs"), cfg)


def check_word_files(raw: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """checked() for the rows of sources.docx."""
    table = structure.classified(raw)
    return checked(table, paragraphs.reference_text(table), cfg)


def as_json(found: DataFrame, issues: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, result: one JSON object per document with findings, a list per bucket, counts and the warning."""
    shown = found.select("doc_id", F.struct("page", "para_on_page", "idx", "rule_id", "stage", "rank", "nth", "severity", "label", "message", "fix", "fixable", "excerpt", "location").alias("x"))
    out = stats.select("doc_id", F.struct("paragraphs", "findings", "citations", "references").alias("stats"), "scope_warning")
    out = out.join(shown.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("findings")), "doc_id", "left")
    issue = F.struct("page", "para_on_page", "idx", "line", "nth", "citation", "reference", "distance", "cited_year", "reference_years", "severity", "location")
    lists = issues.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("bucket") == b, issue))).alias(b) for b in citations.BUCKETS])
    out = out.join(lists, "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("findings", *citations.BUCKETS, "stats", "scope_warning")).alias("result"))


def annotations(found: DataFrame, issues: DataFrame) -> DataFrame:
    """Annotation rows without repeats, in order, with the text of their comments."""
    rows = annotate.without_repeats(annotate.annotation_rows(found, issues))
    return annotate.in_order(rows.withColumn("comment", F.expr(annotate.comment())))


def gate(requests: DataFrame, balances: DataFrame, paid: int = edits.WORDS_PAID, trial: int = edits.WORDS_TRIAL) -> DataFrame:
    """requests with n_words, chunks and state: oversized_confirmation, no_credits or go.

    requests: doc_id, user_id, text, is_trial, confirmed; balances: user_id, balance.
    """
    cap = f"IF(is_trial, {trial}, {paid})"
    r = requests.join(balances, "user_id", "left").withColumn("n_words", F.expr(words("text")))
    r = r.withColumn("chunks", F.expr(f"greatest(1, cast(ceil(n_words / cast({cap} AS double)) AS int))"))
    state = "CASE WHEN chunks > 1 AND NOT confirmed THEN 'oversized_confirmation' WHEN NOT is_trial AND coalesce(balance, 0) < chunks THEN 'no_credits' ELSE 'go' END"
    return r.withColumn("state", F.expr(state))


def answers(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """chunks (doc_id, chunk, text) with the model's answer; the model is called on executors, one text at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(answer=[model(t) for t in f["text"]])

    return chunks.select("doc_id", "chunk", "text").mapInPandas(run, "doc_id long, chunk int, text string, answer string")


def answered(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """chunks (doc_id, chunk, text) with answer and error, each document's in order up to its first error.

    A document's chunks are asked for one after another on one executor; documents run side by side.
    """
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, parts in zip(f["doc_id"], f["parts"], strict=True):
                for part in parts:
                    try:
                        out.append((doc, part["chunk"], part["text"], model(part["text"]), None))
                    except Exception as e:  # whatever a provider raises ends this document's review
                        out.append((doc, part["chunk"], part["text"], None, str(e)))
                        break
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "text", "answer", "error"])

    return listed.mapInPandas(run, "doc_id long, chunk int, text string, answer string, error string")


def review_run(requests: DataFrame, said: DataFrame, cap: int = edits.WORDS_PAID) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, suggestions, answered requests to commit) of reviews.

    requests: doc_id, user_id, request_id, is_trial; said: answered chunks of them, stored, so that no model is asked
    twice. A response is ok, or error with what went wrong and how many chunks were done; each done chunk is charged.
    """
    done = said.filter("error IS NULL")
    key = F.struct("doc_id", "chunk")
    rows = edits.screened(done.select(key.alias("doc_id"), "text", "answer"))
    rows = rows.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.chunk").alias("chunk"), *[c for c in rows.columns if c != "doc_id"])
    counts = edits.screen_counts(rows)
    state = said.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).cast("int").alias("completed"), F.min("error").alias("error"))
    out = requests.select("doc_id", "user_id", "request_id").join(state, "doc_id").join(counts, "doc_id", "left").fillna(0, ["n_kept", "n_not_found", "n_citation_lock"])
    out = out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    made = done.select("doc_id", "chunk").join(requests.select("doc_id", "user_id", "request_id", "is_trial"), "doc_id")
    made = made.select("user_id", F.concat("request_id", F.lit("_chunk"), F.col("chunk").cast("string")).alias("request_id"), "is_trial", F.concat_ws("#", "request_id", F.lpad(F.col("chunk").cast("string"), 9, "0")).alias("seq"))
    return out, rows.filter("status = 'kept'"), made


def reviewed(texts: DataFrame, cap: int = edits.WORDS_PAID, model: Callable[[str], str] | None = None) -> DataFrame:
    """Screened suggestions for texts (doc_id, text), chunk by chunk; without a model the offline stand-in answers."""
    parts = texts.selectExpr("doc_id", f"posexplode({edits.chunks('text', cap)}) AS (chunk, text)")
    said = answers(parts, model) if model else parts.withColumn("answer", F.expr(edits.mock_answer("text")))
    key = F.struct("doc_id", "chunk")
    rows = edits.screened(said.select(key.alias("doc_id"), "text", "answer"))
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.chunk").alias("chunk"), *[c for c in rows.columns if c != "doc_id"])
