"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, media, near_dedup, packing, quality, secret_scan, toxicity, url_rules

MODULES = {
    "op1_bpe": bpe,
    "op2_html_text": html_text,
    "op3_url_rules": url_rules,
    "op4_media": media,
    "op5_packing": packing,
    "op6_quality": quality,
    "op7_exact_dedup": exact_dedup,
    "op8_near_dedup": near_dedup,
    "op9_toxicity": toxicity,
    "op10_secret_scan": secret_scan,
}


def pipeline(spark, sf_dir: str):
    """The corpus pipeline at the top of the repository, which is part of this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {name: m.query for name, m in MODULES.items()} | {"pipeline": pipeline}
ORACLES = {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
