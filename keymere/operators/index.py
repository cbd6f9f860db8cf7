"""Secondary indices as tables: inverted lists, packed bitmaps, id sets, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Indexer


class EntityIndex:
    """The index of one key over an entity frame; derived, so always up to date."""

    def __init__(self, df: DataFrame, indexer: Indexer, id_col: str):
        self.indexer = indexer
        self.rows = df.select(indexer.compared(df).alias("key"), F.col(id_col).alias("entity_id")).where("key is not null")

    def keys(self) -> DataFrame:
        return self.rows.select("key").distinct()

    def ids(self) -> DataFrame:
        return self.rows.select("entity_id")

    def lookup(self, key: object) -> DataFrame:
        return self.rows.where(F.col("key") == self.indexer.literal(key)).select("entity_id")

    def search(self, predicate) -> DataFrame:
        return self.rows.where(predicate(F.col("key"))).select("entity_id")

    def size(self) -> DataFrame:
        return self.rows.agg(F.count_distinct("key").alias("size"))

    def inverted(self) -> DataFrame:
        """A row per (key, segment of ids) with the ids in order; segments bound the lists of common keys."""
        segment = F.shiftright("entity_id", 16).alias("segment")
        return self.rows.groupBy("key", segment).agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))

    def summary(self) -> DataFrame:
        """Distinct ids, smallest and largest id of each key."""
        return self.rows.groupBy("key").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))

    def bitmaps(self) -> DataFrame:
        """Packed bitmaps by key and bucket. Ids are shifted by one, as bucket 0 holds only number 0."""
        shifted = F.col("entity_id") + 1
        return self.rows.groupBy("key", F.bitmap_bucket_number(shifted).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(shifted)).alias("bits"))

    def cardinalities(self) -> DataFrame:
        return self.bitmaps().groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("cnt"))

    def statistics(self) -> DataFrame:
        """Entities per key and the memory estimate: 2 bytes a character of the key, a bit an entity, and 33."""
        n = F.count(F.lit(1))
        return self.rows.groupBy("key").agg(n.alias("entity_count"), (F.length(F.col("key").cast("string")) * 2 + F.floor(n / 8) + 33).cast("long").alias("mem_bytes"))

    def totals(self) -> DataFrame:
        return self.statistics().agg(F.count(F.lit(1)).alias("unique_keys"), F.sum("entity_count").alias("total_entities"), F.sum("mem_bytes").alias("mem_bytes"))

    def equal_key_pairs(self) -> DataFrame:
        """Pairs of entities with the same key, the smaller id first. As many rows as there are such pairs."""
        a, b = self.rows.withColumnRenamed("entity_id", "id1"), self.rows.withColumnRenamed("entity_id", "id2")
        return a.join(b, "key").where("id1 < id2").select("id1", "id2")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def complement(a: DataFrame, live: DataFrame) -> DataFrame:
    """The ids that live but aren't in ``a``."""
    return live.join(a, live.columns[0], "left_anti")


def same_key(df: DataFrame, indexer: Indexer, key: object) -> Column:
    return indexer.compared(df).eqNullSafe(indexer.literal(key))
