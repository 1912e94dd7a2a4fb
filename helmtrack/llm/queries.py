"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, curriculum, decontaminate, divergence, minhash, pii, quality, runs, substring, suffix, suffix_tree_lm, toxicity, warc
from .sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": substring.substring,
        "op2_warc": warc.warc,
        "op3_pii": pii.pii,
        "op4_near_dedup": minhash.near_dedup,
        "op5_lm": suffix_tree_lm.lm,
        "op6_suffix": suffix.suffix,
        "op7_quality": quality.quality,
        "op8_toxicity": toxicity.toxicity,
        "op9_decontaminate": decontaminate.contamination,
        "op10_bpe": bpe.bpe,
        "op11_divergence": divergence.divergence,
        "op12_mix": curriculum.curriculum,
        "op13_runs": runs.runs,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
