"""The corpus pipeline: toxic documents leave, near copies leave, benchmark passages leave, personal data is replaced, and texts are encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helmtrack.llm import bpe, decontaminate, minhash, pii, toxicity
from helmtrack.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: Learned scores, Feistel pseudonyms and BPE cannot be said in SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
