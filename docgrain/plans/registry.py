"""Queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, evaluate, extra, ingest, retrieval, review

MODULES = (retrieval, ingest, evaluate, review, extra, answers)


#: Queries over rows of their own, which read no table: for the tests, each of them has a twin over tables or none is possible.
FIXED = (
    "markdown_sections carry_forward_heading ocr_gate citation_extract citation_metrics answerability outcome_classes token_f1 faithfulness evidence_coverage cer wer risk_rollup judge_ratios"
).split()


def _every() -> dict[str, tuple]:
    return {name: pair for m in MODULES for name, pair in m.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk_corpus(spark, sf_dir)


def queries(fixed: bool = False) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that read tables; with fixed, those over rows of their own too."""
    return {name: q for name, (q, _) in _every().items() if fixed or name not in FIXED}


def oracle_sql(fixed: bool = False) -> dict[str, str]:
    return {name: sql for name, (_, sql) in _every().items() if sql and (fixed or name not in FIXED)}
