"""Streams around the store: change feeds, periodic work, replay of a growing log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import committed
from ..sources.store import Engine


def store_stream(changes: DataFrame, engine: Engine, name: str, checkpoint: str, every: str | None = None):
    """Append each micro-batch of a change feed to a root. A batch and its number are one commit, so a repeated batch is skipped."""

    def write(batch: DataFrame, epoch: int) -> None:
        meta = (engine.manifest(name) or {}).get("meta", {})
        if epoch > meta.get("epoch", -1) and not batch.isEmpty():
            engine.append(name, batch, {"epoch": epoch})

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def from_earliest(spark, path: str, schema: str, format: str = "parquet", **options: str) -> DataFrame:
    """A growing log read from its first entry on, as a stream: files of a folder, or a topic with ``format="kafka"``."""
    if format == "kafka":
        options = {"subscribe": path, "startingOffsets": "earliest"} | options
        return spark.readStream.format("kafka").options(**options).load()
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def latest_by_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The state that a log makes when it is replayed: the last entry of each key, without those that are null."""
    values = [c for c in log.columns if c not in (key, order)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"))
    return last.where("v is not null").select(key, "v.*")


def committed_stream(log: DataFrame, tx: str, ts: str, commit: Column) -> DataFrame:
    """Transactions of a streamed log that have a commit entry (update mode): the batch form, with ``ts`` as sequence.

    State is kept for every transaction, however long it lasts and however
    late its entries come, so it grows with the number of transactions: a few
    numbers each, which the RocksDB state store holds on disk.
    """
    return committed(log, F.col(tx), F.col(ts), commit).withColumnRenamed("tx_id", tx)


def metric_stream(events: DataFrame, ts: str, operation: str, value: str, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Counts and latencies of operations by time window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), operation).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("avg_v"))


def periodic(spark, work: Callable[[int], None], every: str, checkpoint: str):
    """Run ``work`` at each tick of a rate stream (housekeeping)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, epoch: work(epoch)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
