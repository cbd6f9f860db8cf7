"""Periodic work on a store: what to remove, merge or evict, and how to share a time budget."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Engine, StorageError

#: Fixed patterns of files that no version refers to.
ORPHANS = r"(\.tmp|\.bak|\.corrupted\.[^/]*)$"


def orphan_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.where(F.col(path_col).rlike(ORPHANS))


#: Fixed values of the evaluation: the hit ratio wanted, the utilisation (percent) allowed, the factors that still are
#: good and fair, allocations from which the hit ratio counts, the share of evictions and the entry size that are remarked.
TARGET_HITS, MOST_USED = 0.85, 85.0
GOOD_HITS, GOOD_USED, FAIR_HITS, FAIR_USED = 0.8, 1.1, 0.6, 1.2
LEAST_ALLOCATIONS, MOST_EVICTED, SMALL_ENTRY = 100, 0.5, 1024
#: Factors by which the capacity grows for a hit ratio below ``GOOD_HITS`` of the one wanted, and for too high a utilisation.
MORE_FOR_HITS, MORE_FOR_USE = 1.5, 1.2


def cache_evaluation(caches: DataFrame, target: float = TARGET_HITS, most: float = MOST_USED) -> DataFrame:
    """Rating, issues, advice, whether to evict, the best capacity and what evicting would save.

    Columns: hit_ratio, utilisation (percent), pressure, allocations,
    evictions, entries, avg_entry, used, capacity (bytes).
    """
    hits, used = F.col("hit_ratio"), F.col("utilisation")
    target, most = min(max(target, 0.0), 1.0), min(max(most, 0.0), 100.0)
    rating = (
        F.when((hits >= target) & (used <= most), "Excellent")
        .when((hits >= target * GOOD_HITS) & (used <= most * GOOD_USED), "Good")
        .when((hits >= target * FAIR_HITS) & (used <= most * FAIR_USED), "Fair")
        .otherwise("Poor")
    )
    issues = {"utilisation too high": used > most, "hit ratio below target": hits < target, "memory pressure": F.col("pressure")}
    advice = {
        "raise the capacity or evict more often": used > most,
        "raise the capacity or adjust the timeout": hits < target,
        "many evictions: raise the capacity": F.col("evictions") > F.col("allocations") * MOST_EVICTED,
        "many small entries: consolidate": (F.col("entries") > 0) & (F.col("avg_entry") < SMALL_ENTRY),
        "nothing to change": F.col("rating") == "Excellent",
    }
    listed = lambda tests: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    capacity = F.when(hits >= target, 1.0).when(hits < target * GOOD_HITS, MORE_FOR_HITS).when(used > most, MORE_FOR_USE).otherwise(1.0)
    return (
        caches.withColumn("rating", rating)
        .withColumn("issues", listed(issues))
        .withColumn("advice", listed(advice))
        .withColumn("should_evict", (used > most) | ((hits < target) & (F.col("allocations") > LEAST_ALLOCATIONS)))
        .withColumn("optimal_capacity", F.floor(F.col("capacity") * capacity).cast("long"))
        .withColumn("savings", F.when(used > most, F.floor(F.col("used") * ((used - most) / 100.0))).otherwise(0).cast("long"))
    )


def totals(runs: DataFrame) -> DataFrame:
    """What housekeeping has done so far, from its runs: kind (collection or consolidation), reclaimed, ended."""
    return runs.agg(
        F.count_if(F.col("kind") == "collection").alias("collections"),
        F.count_if(F.col("kind") == "consolidation").alias("consolidations"),
        F.coalesce(F.sum("reclaimed"), F.lit(0)).alias("reclaimed"),
        F.max("ended").alias("last_run"),
    )


@dataclass
class Budget:
    """Seconds shared by tasks: collection takes 40 %, consolidation 40 % of the rest, optimisation what is left."""

    seconds: float
    shares: dict[str, float] = field(default_factory=lambda: {"collection": 0.4, "consolidation": 0.4, "optimisation": 1.0})

    def split(self) -> dict[str, float]:
        out, left = {}, self.seconds
        for name, share in self.shares.items():
            out[name] = left * share
            left -= out[name]
        return out

    def over_channels(self, channels: int) -> list[float]:
        return [self.seconds / channels] * channels


def run_tasks(tasks: dict[str, Callable[[float], object]], budget: Budget) -> list[tuple[str, float, bool, object]]:
    """Run each task with its share: (name, seconds, in time, result). A task that fails doesn't stop the others."""
    out = []
    for name, seconds in budget.split().items():
        if name not in tasks:
            continue
        began = time.monotonic()
        try:
            result: object = tasks[name](seconds)
        except Exception as e:  # noqa: BLE001  reported with the result
            result = e
        took = time.monotonic() - began
        out.append((name, took, took <= seconds, result))
    return out


class Upkeep:
    """The work of an engine's housekeeping on its roots: parts that nothing names are removed, many small parts are merged."""

    def __init__(self, engine: Engine, most_parts: int = 8):
        self.engine, self.most_parts = engine, most_parts

    def collect(self, seconds: float) -> int:
        """Garbage collection within a time: roots that are left are done the next time. Returns parts removed."""
        return sum(self._each(seconds, self.engine.collect_garbage).values())

    def consolidate(self, seconds: float) -> list[str]:
        """Merge roots of more than ``most_parts`` parts; returns their names."""
        many = lambda name: len(self.engine.manifest(name)["parts"]) > self.most_parts and bool(self.engine.compact(name))
        return [name for name, done in self._each(seconds, many).items() if done]

    def _each(self, seconds: float, work: Callable[[str], object]) -> dict[str, object]:
        end, out = time.monotonic() + seconds, {}
        for name in self.engine.roots():
            if time.monotonic() >= end:
                break
            out[name] = work(name)
        return out

    def run(self, budget: Budget | None = None) -> list[tuple[str, float, bool, object]]:
        """All of it within the budget (the engine's if none is given)."""
        budget = budget or Budget(self.engine.config.housekeeping_budget_ms / 1000)
        return run_tasks({"collection": self.collect, "consolidation": self.consolidate}, budget)


class Backups:
    """Copies of the current version of roots, in a store of their own: in ``folder``, or where the engine's settings say."""

    def __init__(self, engine: Engine, folder: str | None = None):
        folder = folder or engine.config.backup_directory
        if not folder:
            raise StorageError("no folder for backups")
        self.engine, self.target = engine, Engine.start(engine.spark, folder)

    def full(self, names: list[str] | None = None) -> list[str]:
        done = []
        for name in names or self.engine.roots():
            df, m = self.engine.root(name), self.engine.manifest(name)
            if df is not None:
                self.target.store(name, df, tuple(m["partition_by"]), {"kind": "full", "of": m["version"], "meta": m["meta"]})
                done.append(name)
        return done

    def incremental(self, name: str, modified: Column, since: Column) -> int:
        df = self.engine.root(name)
        if df is None:
            raise StorageError(f"no root {name}")
        return self.target.append(name, df.where(modified > since))

    def listed(self) -> list[tuple[str, int]]:
        """Roots and their newest backup, the newest first."""
        return sorted(((n, self.target.manifest(n)["version"]) for n in self.target.roots()), key=lambda x: (-x[1], x[0]))

    def restore(self, name: str) -> int:
        df = self.target.root(name)
        if df is None:
            raise StorageError(f"no backup of {name}")
        m = self.target.manifest(name)
        return self.engine.store(name, df, tuple(m["partition_by"]), m["meta"].get("meta"))


class Lock:
    """A lock file in the store's folder; one older than ``stale_seconds`` may be taken over."""

    def __init__(self, engine: Engine, stale_seconds: float = 60.0):
        self.engine, self.stale, self.token = engine, stale_seconds, uuid.uuid4().hex
        self.path = f"{engine.config.directory}/used.lock"

    def holder(self) -> tuple[str, float] | None:
        fs, p = self.engine._fs(self.path)
        if not fs.exists(p):
            return None
        line = self.engine.spark.read.text(self.path).first()
        return (line[0], fs.getFileStatus(p).getModificationTime() / 1000) if line else ("", 0.0)

    def acquire(self) -> bool:
        held = self.holder()
        if held and held[0] != self.token and time.time() - held[1] < self.stale:
            return False
        fs, p = self.engine._fs(self.path)
        if not held:
            fs.mkdirs(p.getParent())
            try:
                out = fs.create(p, False)  # fails if another was faster
            except Exception:  # noqa: BLE001  the JVM's FileAlreadyExistsException
                return False
        else:
            out = fs.create(p, True)
        out.write(bytearray(self.token.encode()))
        out.close()
        return True

    def release(self) -> bool:
        held = self.holder()
        if not held or held[0] != self.token:
            return False
        fs, p = self.engine._fs(self.path)
        return fs.delete(p, False)
