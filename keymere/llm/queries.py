"""Queries that apply the operators to whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, host_ranks, jaccard, language_id, packing, quality, sharding, token_ids, toxicity, warc
from .scratch import Scratch, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    manifest = token_ids.token_corpus(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, scratch)
    return token_ids.read_token_shards(spark, manifest)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, Scratch(spark, "op4"), 1024)


SHARD_BYTES = 1 << 20


@query
def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    return sharding.names_of(sharding.write_shards(table(spark, sf_dir, "documents"), SHARD_BYTES, scratch.path("shards"), scratch))


SQL["op2_extendible_sharding"] = sharding.SQL.format(limit=SHARD_BYTES)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    index, captures = warc.archive(spark, table(spark, sf_dir, "pages"), scratch, min_bytes=0)
    found = index.lookup(captures.select("key", "page_id").distinct())
    return index.read(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Rejected good documents per stratum, and the error over all strata.
QUALITY_RISK, QUALITY_ERROR = 0.02, 0.05


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text")
    measured = Scratch(spark, "op7").table(measured, "measured")
    steps = quality.calibrate(measured, table(spark, sf_dir, "labels"), QUALITY_RISK, QUALITY_ERROR)
    return quality.judge(measured, steps).drop("lang", "level", "text_hash")


URL_RULES = [host_ranks.Rule(*x) for x in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))]


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_ranks.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op8"))
    return judged.drop("trust", "distrust")


SQL["op8_url_filters"] = host_ranks.sql(URL_RULES)


def _held_out() -> Column:
    return language_id.fold_of(F.col("doc_id")) == 2


def language_model(spark: SparkSession, sf_dir: str) -> language_id.LanguageModel:
    return language_id.train(table(spark, sf_dir, "documents"), ~_held_out())


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language_id.identify(docs, language_model(spark, sf_dir))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "cosine", "rejected")


TOXIC_CUT = 0.3


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~_held_out())
    return toxicity.score(docs, model).select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
