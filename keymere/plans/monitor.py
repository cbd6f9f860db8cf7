"""Metrics of operations, and what they recommend."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from time import perf_counter_ns

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import guarded_ratio
from ..sources.store import Engine

#: What is recorded of an operation.
EVENT = "op string, ts timestamp, nanos long, ok boolean, entity_id long, bytes long, cache_hit boolean, entities int"


class Recorder:
    """Operations that are appended to an event table of an engine, ``at_once`` rows a commit."""

    def __init__(self, engine: Engine, root: str = "events", at_once: int = 1000):
        self.engine, self.root, self.at_once, self.rows = engine, root, at_once, []

    def record(self, op: str, nanos: int, ok: bool = True, entity_id: int | None = None, bytes_: int | None = None, cache_hit: bool | None = None, entities: int | None = None) -> None:
        if not op:
            raise ValueError("an operation has a name")
        from datetime import datetime, timezone

        self.rows.append((op, datetime.now(timezone.utc), nanos, ok, entity_id, bytes_, cache_hit, entities))
        if len(self.rows) >= self.at_once:
            self.flush()

    def read(self, entity_id: int, bytes_: int, nanos: int, cache_hit: bool = False) -> None:
        self.record("Read", nanos, True, entity_id, bytes_, cache_hit)

    def write(self, entity_id: int, bytes_: int, nanos: int, ok: bool = True) -> None:
        self.record("Write", nanos, ok, entity_id, bytes_)

    def commit(self, entities: int, nanos: int, ok: bool = True) -> None:
        self.record("Commit", nanos, ok, entities=entities)

    @contextmanager
    def timed(self, op: str) -> Iterator[None]:
        """Record what happens inside, and whether it raised."""
        began, ok = perf_counter_ns(), False
        try:
            yield
            ok = True
        finally:
            self.record(op, perf_counter_ns() - began, ok)

    def flush(self) -> None:
        if self.rows:
            self.engine.append(self.root, self.engine.spark.createDataFrame(self.rows, EVENT))
            self.rows = []

    def events(self, kept: int | None = None) -> DataFrame:
        """What was recorded, or the latest of it."""
        self.flush()
        out = self.engine.root(self.root)
        out = self.engine.spark.createDataFrame([], EVENT) if out is None else out
        return out if kept is None else out.orderBy(F.desc("ts")).limit(kept)


class Monitors:
    """Named summary frames of some kinds: found by name or by kind."""

    def __init__(self) -> None:
        self._all: dict[str, tuple[str, Callable[[], DataFrame]]] = {}

    def add(self, name: str, kind: str, frame: Callable[[], DataFrame]) -> None:
        if name in self._all:
            raise ValueError(f"monitor {name} exists")
        self._all[name] = (kind, frame)

    def get(self, name: str) -> DataFrame | None:
        return self._all[name][1]() if name in self._all else None

    def of_kind(self, kind: str) -> dict[str, DataFrame]:
        return {n: f() for n, (k, f) in self._all.items() if k == kind}

    def listed(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, k) for n, (k, _) in self._all.items()], "name string, kind string")


def by_operation(events: DataFrame, operation: Column, latency: Column, ok: Column) -> DataFrame:
    keyed = events.select(operation.alias("op"), latency.alias("v"), ok.alias("ok"))
    n, good = F.count(F.lit(1)), F.count_if("ok")
    return keyed.groupBy("op").agg(n.alias("total"), good.alias("ok"), (n - good).alias("failed"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("avg_v"), F.round(good.cast("double") / n, 6).alias("success_rate"), F.round((n - good).cast("double") / n, 6).alias("failure_rate"))


def totals(metrics: DataFrame, seconds: float) -> DataFrame:
    """All operations: number, error rate, operations a second."""
    sums = metrics.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.count(F.lit(1)).alias("operations"))
    return sums.withColumn("error_rate", guarded_ratio(F.col("failed"), F.col("total"))).withColumn("per_second", F.col("total") / F.lit(seconds))


#: Fixed limits of the recommendations: milliseconds, shares, operations a second, kinds of operations.
SLOW_MS, LEAST_SUCCESS, SPREAD_MS, MOST_ERRORS, LEAST_RATE, MOST_KINDS = 100, 0.95, 1000, 0.05, 10, 10


def recommendations(metrics: DataFrame, slow: float = SLOW_MS, success: float = LEAST_SUCCESS, spread: float = SPREAD_MS) -> DataFrame:
    """Flags of each operation, and their names as an array."""
    flags = {"high_latency": F.col("avg_v") > slow, "low_success": F.col("success_rate") < success, "high_variance": F.col("max_v") - F.col("min_v") > spread}
    out = metrics.select("op", *[c.alias(n) for n, c in flags.items()])
    return out.withColumn("advice", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in flags])))


def overall_advice(all_: DataFrame) -> DataFrame:
    tests = {"error rate": F.col("error_rate") > MOST_ERRORS, "few operations": F.col("per_second") < LEAST_RATE, "many kinds": F.col("operations") > MOST_KINDS}
    return all_.select(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])).alias("advice"))


def recent(events: DataFrame, ts: str, id_col: str, n: int) -> DataFrame:
    return events.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def average_rate(results: DataFrame, rate: str, by: str | None = None) -> DataFrame:
    """The mean rate of measured results, over all or by a column."""
    mean = F.avg(rate).alias("avg_rate")
    return results.groupBy(by).agg(mean) if by else results.agg(mean)


def memory(stats: DataFrame) -> DataFrame:
    """From allocations, evictions, used, capacity, entries: hit ratio, mean size, utilisation, pressure."""
    out = stats.withColumn("hit_ratio", F.when(F.col("allocations") == 0, 0.0).otherwise(1 - F.col("evictions") / F.col("allocations")))
    out = out.withColumn("avg_entry", guarded_ratio(F.col("used"), F.col("entries"))).withColumn("utilisation", 100 * guarded_ratio(F.col("used"), F.col("capacity")))
    return out.withColumn("pressure", F.col("utilisation") > 90)


def cache_summary(caches: DataFrame, columns: list[str]) -> DataFrame:
    return caches.agg(*[F.sum(c).alias(c) for c in columns])
