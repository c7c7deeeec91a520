"""URL filters as a sort-merge range join of prefix rules.

A rule's key is its host with the labels reversed, then its path, so the keys that a rule covers are one
interval of the sorted keys. A URL has one key for each suffix of its host that is no deeper than the deepest
rule. Both sides are sorted and swept once: a stack holds the nested rules that are open at the current key,
and its top is the longest of them. The rules are configuration and travel with the tasks in blocks of
MOST_RULES; more rules mean more sweeps over the same batch, never a dropped rule. Pages are not shuffled.

Defined results: a null url, or one without `://`, has an empty host and path and the default verdict; a very long url
is read whole, with keys for no more labels of its host than the deepest rule has; of two rules with the same length
the one with the longer host wins, of two that are equal the blocking one; repeated rows each get their own result; an
empty table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

DEFAULT = "allow"
MOST_RULES = 200_000
BATCH = 20_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The contract's rules.
RULES = tuple(Rule(v, *re.fullmatch(r"([^/]*)(/.*)", r).groups()) for v, r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def key(host: str, path: str) -> str:
    """Reversed labels, then the path; the line end sorts before every label and never is part of one."""
    return ",".join(reversed(host.split("."))) + "\n" + path


def sorted_rules(rules) -> list[tuple[str, Rule]]:
    """Rules by key, one per key: a blocking rule goes before an allowing one with the same key."""
    kept: dict[str, Rule] = {}
    for r in rules:
        k = key(r.host, r.path)
        if k not in kept or r.verdict == "block":
            kept[k] = r
    return sorted(kept.items())


def sweep(keys: list[str], rules: list[tuple[str, Rule]]) -> list[Rule | None]:
    """For each of the ascending keys, the longest rule whose interval holds it."""
    out, open_rules, at = [], [], 0
    for k in keys:
        while at < len(rules) and rules[at][0] <= k:
            while open_rules and not rules[at][0].startswith(open_rules[-1][0]):
                open_rules.pop()
            open_rules.append(rules[at])
            at += 1
        while open_rules and not k.startswith(open_rules[-1][0]):
            open_rules.pop()
        out.append(open_rules[-1][1] if open_rules else None)
    return out


def judge(places: list[tuple[str, str]], blocks: list[list[tuple[str, Rule]]]) -> list[Rule | None]:
    """The winning rule of each (host, path)."""
    deepest = max((r.host.count(".") + 1 for b in blocks for _, r in b), default=0)
    points = []
    for n, (host, path) in enumerate(places):
        labels = host.rsplit(".", deepest) if host else []
        whole = labels if host.count(".") < deepest else labels[1:]
        suffix = ""
        for label in reversed(whole):
            suffix = f"{label}.{suffix}" if suffix else label
            points.append((key(suffix, path), n))
    points.sort()
    best: list[Rule | None] = [None] * len(places)
    rank = lambda r: (len(r.host) + len(r.path), len(r.host))
    for block in blocks:
        for (_, n), r in zip(points, sweep([k for k, _ in points], block), strict=True):
            if r and (best[n] is None or rank(r) > rank(best[n])):
                best[n] = r
    return best


def judged(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    ordered = sorted_rules(rules)
    blocks = [ordered[k : k + MOST_RULES] for k in range(0, len(ordered), MOST_RULES)]

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                places = [host_and_path(u) for u in b.column("url").to_pylist()]
                found = judge(places, blocks)
                rule = pa.array([r and r.host + r.path for r in found], pa.string())
                verdict = pa.array([r.verdict if r else default for r in found], pa.string())
                hosts, paths = (pa.array([p[i] for p in places], pa.string()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), hosts, paths, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS v
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
