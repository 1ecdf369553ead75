"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, jaccard, langid, licenses, lm, mixing, quality, repeats, runs, simhash, token_file, topk, tput


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_ball_tree": topk.op1_ball_tree,
        "op2_repeats": repeats.op2_repeats,
        "op3_language": langid.op3_language,
        "op4_context_mixing": lm.op4_context_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_mix": mixing.op6_mix,
        "op7_quality": quality.op7_quality,
        "op8_token_file": token_file.op8_token_file,
        "op9_bpe_replay": bpe.op9_bpe_replay,
        "op10_licenses": licenses.op10_licenses,
        "op11_tput": tput.op11_tput,
        "op12_signature_trees": jaccard.op12_signature_trees,
        "op13_tandem_runs": runs.op13_tandem_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ball_tree": topk.OP1_SQL,
        "op6_mix": mixing.OP6_SQL,
        "op10_licenses": licenses.OP10_SQL,
        "op11_tput": tput.OP11_SQL,
        "op12_signature_trees": jaccard.OP12_SQL,
        "op13_tandem_runs": runs.OP13_SQL,
    }
