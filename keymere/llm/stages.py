"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> what is kept of docs.

All but the last return the columns of ``docs``, whatever their names; what
an operator adds has names that none of them has. A stage first removes the
scratch tables of the stage before it in the same thread, whose result is
written by then.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language_id, packing, quality
from .queries import QUALITY_ERROR, QUALITY_RISK, language_model, table, vocabulary
from .scratch import Scratch
from .text import free_prefix

_of_thread = threading.local()


def _scratch(spark: SparkSession, name: str) -> Scratch:
    if (before := getattr(_of_thread, "scratch", None)) is not None:
        before.drop()
    _of_thread.scratch = Scratch(spark, name)
    return _of_thread.scratch


def finish() -> None:
    """Remove the scratch tables of the last stage of this thread, whose result is written."""
    if (before := getattr(_of_thread, "scratch", None)) is not None:
        before.drop()
        _of_thread.scratch = None


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model is that of the query: fitted on ``documents``; without labels in it only texts without a letter go."""
    _scratch(spark, "stage-language")
    prefix = free_prefix(docs.columns, "lid_")
    found = language_id.identify(docs, language_model(spark, sf_dir), prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*_own(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs are chosen on the labelled ones among them."""
    prefix = free_prefix(docs.columns, "rule_")
    measured = _scratch(spark, "stage-quality").table(quality.measure(docs, prefix=prefix), "measured")
    steps = quality.calibrate(measured, table(spark, sf_dir, "labels"), QUALITY_RISK, QUALITY_ERROR, prefix=prefix)
    return quality.judge(measured, steps, prefix=prefix).where(F.col(f"{prefix}kept")).select(*_own(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id (see :func:`jaccard.first_of_similar`)."""
    return jaccard.first_of_similar(docs, _scratch(spark, "stage-jaccard"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, told by their texts: of two with one id only the one with a passage goes."""
    scratch, prefix = _scratch(spark, "stage-decontamination"), free_prefix(docs.columns, "hash_")
    keyed = docs.withColumn(f"{prefix}text", F.xxhash64("text"))
    found = decontaminate.contaminated(keyed.select(F.col(f"{prefix}text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = scratch.table(found.select(F.col("doc_id").alias(f"{prefix}text")).distinct(), "found")
    return keyed.join(found, f"{prefix}text", "left_anti").select(*_own(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0, _scratch(spark, "stage-packing"), 1024)
