"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

import pathlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, langid, mixing, neardup, oracles, quality_classifier, quality_rules, secrets, substring_dedup, token_count, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(query, *tables: str) -> Query:
    return lambda spark, sf_dir: query(*(table(spark, sf_dir, t) for t in tables))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(pathlib.Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": _over(langid.query, "documents"),
        "op2_secret_scan": _over(secrets.query, "documents"),
        "op3_near_duplicates": _over(neardup.query, "documents"),
        "op4_toxicity": _over(toxicity.query, "documents", "labels"),
        "op5_mixing": _over(mixing.query, "documents"),
        "op6_quality_classifier": _over(quality_classifier.query, "documents", "labels"),
        "op7_token_counts": _over(token_count.query, "documents"),
        "op8_quality_rules": _over(quality_rules.query, "documents"),
        "op9_substring_dedup": _over(substring_dedup.query, "documents"),
        "op10_decontamination": _over(decontamination.query, "documents", "benchmark"),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": oracles.NEAR_DUPLICATES, "op10_decontamination": oracles.DECONTAMINATION}
