"""Extendible hashing: shards are leaves of a directory over hash-prefix bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch, wide

#: Bits of the hash: the first 15 hex digits of an MD5 sum.
BITS = 60
#: Bits looked at in the first round, and in each later one.
FIRST, STEP = 12, 4
#: Up to so many shards (17 bytes each) the directory is sent to all tasks; a larger one is joined.
SENT_SHARDS = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 sum as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


DIRECTORY = "depth long, prefix long, overflow boolean"


def build_directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """The leaves that have rows, as a table (depth, prefix, overflow); ``overflow`` marks those that no bit can split.

    ``rows`` has columns h and n_bytes. Only buckets over ``limit`` bytes are
    split: each round sums up the next few bits of the buckets that are still
    too large, and settles those of their parts that fit while the part they
    come from doesn't. The driver sees whether a round left large buckets, and
    nothing else; rounds are as many as the deepest leaf needs.
    """
    leaves, above, depth, large = None, 0, FIRST, None
    while True:
        prefix = lambda d: F.shiftright("h", BITS - d)
        part = rows if large is None else rows.withColumn("up", prefix(above)).join(large.withColumnRenamed("prefix", "up"), "up", "left_semi")
        deep = part.groupBy(prefix(depth).alias("prefix")).agg(F.sum("n_bytes").alias("n"))
        levels = F.sequence(F.lit(above), F.lit(depth))
        sums = deep.withColumn("depth", F.explode(levels)).groupBy("depth", F.expr(f"shiftright(prefix, {depth} - depth)").alias("prefix")).agg(F.sum("n").cast("long").alias("n"))
        sums = scratch.table(sums.withColumn("depth", F.col("depth").cast("long")), f"sums-{depth}")
        fits = sums.where(F.col("n") <= limit)
        if large is not None:
            fits = fits.where(F.col("depth") > above)
        parents = sums.where(F.col("n") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
        split = split.unionByName(fits.where("depth = 0").withColumn("parent", F.lit(0).cast("long"))).select("depth", "prefix", F.lit(False).alias("overflow"))
        leaves = split if leaves is None else leaves.unionByName(split)
        large = scratch.table(sums.where((F.col("n") > limit) & (F.col("depth") == depth)).select("prefix"), f"large-{depth}")
        if depth == BITS or large.isEmpty():
            break
        above, depth = depth, min(BITS, depth + STEP)
    over = large.select(F.lit(BITS).cast("long").alias("depth"), "prefix", F.lit(True).alias("overflow"))
    return scratch.table(leaves.unionByName(over), "directory")


def shard_rows(docs: DataFrame, limit: int, scratch: Scratch, key_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, page; with ``carry`` also the document itself, as the struct ``row``.

    (depth, prefix, page) names the shard; a shard holds at most ``limit``
    bytes of text, unless it is one larger document. ``page`` is 0 but in
    buckets whose rows agree in all hash bits (one key repeated, or one large
    document): these are filled page by page along their rows. A null text has
    no bytes, a null key hashes like an empty one. An empty table has no rows.
    """
    own = [F.col(key_col).alias("doc_id"), hash_bits(F.col(key_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")]
    keys = scratch.table(docs.select(*own), "keys")
    directory = build_directory(keys, limit, scratch)
    rows = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else keys
    placed = _place(rows, directory)
    names = ["doc_id", "n_bytes", "depth", "prefix"]
    kept = ["row"] if carry else []
    plain = placed.where(~F.col("overflow")).select(*names, F.lit(0).cast("long").alias("page"), *kept)
    if directory.where("overflow").isEmpty():
        return plain
    return plain.unionByName(_pages(placed.where("overflow").select(*names, *kept), limit, scratch))


def _place(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Add the leaf of each row: the last one that begins at or before the row's hash."""
    n = directory.count()
    if n <= SENT_SHARDS:
        found = directory.toPandas()
        firsts = found["prefix"].to_numpy(np.int64) << (BITS - found["depth"].to_numpy(np.int64))
        order = np.argsort(firsts)
        sent = rows.sparkSession.sparkContext.broadcast((firsts[order], found["depth"].to_numpy(np.int64)[order], found["overflow"].to_numpy(bool)[order]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, depth, over = sent.value
            for batch in batches:
                at = np.searchsorted(firsts, batch.column(1).to_numpy(), "right") - 1
                own = [pa.array(depth[at]), pa.array(firsts[at] >> (BITS - depth[at])), pa.array(over[at])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "depth", "prefix", "overflow"])

        return rows.mapInArrow(find, StructType([*rows.schema, *StructType.fromDDL(DIRECTORY)]))
    # an equi-join on the first bits, of which there are about as many values as leaves: a leaf that isn't so deep is in all of its values
    bits = max(1, n.bit_length() - 4)
    first = F.expr(f"shiftleft(prefix, cast({BITS} - depth as int))")
    ends = [F.shiftright(first, BITS - bits), F.shiftright(first + F.expr(f"shiftleft(1L, cast({BITS} - depth as int))") - 1, BITS - bits)]
    cells = directory.withColumn("first", first).withColumn("cell", F.explode(F.sequence(*ends)))
    cells = cells.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("first", "depth", "prefix", "overflow"))).alias("leaves"))
    joined = rows.withColumn("cell", F.shiftright("h", BITS - bits)).join(cells, "cell")
    leaf = F.element_at(F.filter("leaves", lambda x: x["first"] <= F.col("h")), -1)
    return joined.withColumn("leaf", leaf).select(*[F.col(f"`{c}`") for c in rows.columns], "leaf.depth", "leaf.prefix", "leaf.overflow")


def _pages(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Fill pages along each partition; pages of a bucket are numbered over the partitions."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bucket, page, room = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            pages = []
            for p, n in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist()):
                if p != bucket:
                    bucket, page, room = p, 0, limit
                elif n > room:
                    page, room = page + 1, limit
                room -= n
                pages.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int64()), pa.array([part] * len(pages), pa.int64())], [*batch.schema.names, "page", "part"])

    salted = rows.withColumn("_s", F.rand(17)).repartitionByRange(*wide(rows), "prefix", "_s").sortWithinPartitions("prefix", "_s").drop("_s")
    filled = scratch.table(salted.mapInArrow(fill, StructType([*rows.schema, *StructType.fromDDL("page long, part long")])), "pages")
    used = filled.groupBy("prefix", "part").agg((F.max("page") + 1).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = used.select("prefix", "part", before.alias("first"))
    return filled.join(firsts, ["prefix", "part"]).select("doc_id", "n_bytes", "depth", "prefix", (F.col("page") + F.col("first")).alias("page"), *[c for c in ["row"] if c in rows.columns])


def write_shards(docs: DataFrame, limit: int, folder: str, scratch: Scratch, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each shard's documents as a folder of its own, named depth-prefix-page, and return them as read back, with that name as ``shard``.

    Each row of ``docs`` is in one shard, once, also those with a null or a
    repeated key. ``docs`` has no column of the name ``shard``.
    """
    rows = shard_rows(docs, limit, scratch, key_col, text_col, carry=True)
    named = rows.select("row.*", F.concat_ws("-", "depth", "prefix", "page").alias("shard"))
    named.repartition(*wide(docs), "shard").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(StructType([*docs.schema, *StructType.fromDDL("shard string")])).parquet(folder)


def names_of(shards: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, prefix, page of the documents in written shards."""
    name = F.split("shard", "-")
    parts = [name[k].cast("long").alias(c) for k, c in enumerate(("depth", "prefix", "page"))]
    return shards.select(F.col(key_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *parts)


SQL = f"""
with keys as (
  select doc_id, cast(coalesce(octet_length(encode(text)), 0) as bigint) as n_bytes,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
sums as (
  select d, h >> ({BITS} - d) as prefix, sum(n_bytes) as n from keys, (select cast(range as bigint) as d from range(0, {BITS} + 1)) group by 1, 2),
fits as (select d, prefix from sums where n <= {{limit}})
select doc_id, n_bytes, cast(min(d) as bigint) as depth, cast(h >> ({BITS} - min(d)) as bigint) as prefix, cast(0 as bigint) as page
from keys join fits on prefix = h >> ({BITS} - d) group by doc_id, n_bytes, h
"""
