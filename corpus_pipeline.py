"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the stages
run one after the other, each over the written result of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keymere.llm import stages
from keymere.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.language_id_stage),
    ("quality_rules", stages.quality_stage),
    ("jaccard_join", stages.jaccard_stage),
    ("decontamination", stages.decontamination_stage),
    ("packing", stages.packing_stage),
]

#: Tokenizers and trained models have no SQL form; the tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    stages.finish()
    return docs
