"""All findings of a paragraph table, in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import folded
from . import references, structure
from .rules import CATEGORIES, RULES, Config
from .structure import FINDING

STAGE = 6


def paragraph_findings(paragraphs: DataFrame, cfg: Config = Config(), rules=RULES) -> DataFrame:
    """Findings of the rules that look at one body paragraph, in one scan: flags first, then places where a flag is up."""
    prose = paragraphs.filter("NOT is_ref AND level IS NULL").selectExpr("doc_id", "idx", "r", "m", f"{folded('r')} AS low_r", f"{folded('m')} AS low_m")
    flags = ", ".join(f"IF({r.flag(cfg)}, {n}, null)" for n, r in enumerate(rules))
    hit = prose.selectExpr("doc_id", "idx", "r", "m", f"explode(array_compact(array({flags}))) AS n")
    places = " ".join(f"WHEN {n} THEN {r.sql(cfg, n)}" for n, r in enumerate(rules))
    found = hit.selectExpr("doc_id", "idx", f"inline(CASE n {places} END)")
    severity = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.severity)])
    return found.withColumns({"stage": F.lit(STAGE), "severity": severity[F.col("rule_id")]}).select(*FINDING)


def document_findings(paragraphs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Findings of the rules over the order of paragraphs and over reference entries."""
    parts = [
        structure.long_abstracts(paragraphs),
        structure.skipped_levels(paragraphs, cfg),
        structure.headings_without_body(paragraphs, cfg),
        structure.list_findings(paragraphs),
        references.entry_findings(paragraphs),
        structure.missing_indents(paragraphs),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("replacement", F.lit(None).cast("string")).select(*FINDING) for p in parts])


def findings(paragraphs: DataFrame, cfg: Config = Config(), rules=RULES) -> DataFrame:
    """Every finding with category and place: page, para_on_page and location of its paragraph."""
    found = paragraph_findings(paragraphs, cfg, rules).unionByName(document_findings(paragraphs, cfg))
    anchor = "concat(trim(substring(r, 1, 60)), IF(length(r) > 60, '...', ''))"
    place = paragraphs.selectExpr("doc_id", "idx", "page", "para_on_page", f"concat('Page ', page, ', Para ', para_on_page, ' - \"', {anchor}, '\"') AS location")
    category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return found.join(place, ["doc_id", "idx"], "left").withColumn("category", category[F.substring("rule_id", 1, 3)])


def in_order(found: DataFrame, whole: bool = True) -> DataFrame:
    """Sorted by document, page, paragraph on it, index and rule, then as the rules emit.

    Without `whole` the documents are dealt out by hash and only each one's findings are in order.
    """
    last = F.lit(10**9)
    sort = found.orderBy if whole else found.repartition("doc_id").sortWithinPartitions
    return sort("doc_id", F.coalesce("page", last), F.coalesce("para_on_page", last), "idx", "rule_id", "stage", "rank", "nth")


def rule_sets(found: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, rules: the sorted distinct rule ids of a document's findings and buckets of its citation issues."""
    ids = found.select("doc_id", F.col("rule_id").alias("id")).union(issues.select("doc_id", F.col("bucket").alias("id")))
    return ids.groupBy("doc_id").agg(F.sort_array(F.collect_set("id")).alias("rules"))


def missing_rules(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, missing, unexpected: rules that should have been found but weren't, and the other way round.

    wanted: doc_id, rules; sets as rule_sets() gives them.
    """
    both = wanted.withColumnRenamed("rules", "want").join(sets.withColumnRenamed("rules", "got"), "doc_id", "full_outer")
    return both.select("doc_id", *differences(F.col("want"), F.col("got")))


def differences(want: Column, got: Column) -> tuple[Column, Column]:
    """missing, unexpected: what only one of two sets of rules has, for rows that hold both; null counts as empty."""
    none = F.array().cast("array<string>")
    want, got = F.coalesce(want, none), F.coalesce(got, none)
    return F.array_except(want, got).alias("missing"), F.array_except(got, want).alias("unexpected")
