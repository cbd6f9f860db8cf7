"""Row numbers and running sums over a whole table without gathering it in one task.

Rows are dealt by ranges of the order once, summed up along each partition,
and the sums of the partitions before it are added: one row per partition is
all that meets in one place. What is dealt is materialised, so that the
partitions are the same wherever they are used; callers hand in the columns
that they need and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import cut


class Descending:
    """Marks a column of an order as descending."""

    def __init__(self, plain: Column):
        self.plain = plain


def dealt(df: DataFrame, order: list[Column | Descending]) -> DataFrame:
    """Rows dealt and sorted by ranges of the order: one exchange."""
    keys = [f"_o_{i}" for i in range(len(order))]
    plain = [c.plain if isinstance(c, Descending) else c for c in order]
    sort = [F.col(k).desc() if isinstance(c, Descending) else F.col(k).asc() for k, c in zip(keys, order)]
    return df.withColumns(dict(zip(keys, plain))).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*keys)


def running(df: DataFrame, order: list[Column | Descending], values: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its value (a whole number; null counts as 0) over all earlier rows (0 for the first)."""
    names = list(values)
    rows = dealt(df.withColumns({f"_v_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in values.items()}), order)
    at = [rows.columns.index(f"_v_{n}") for n in names]
    schema = StructType([*rows.schema, *StructType.fromDDL("_part int, " + ", ".join(f"`_w_{n}` long" for n in names))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), [0] * len(at)
        for batch in batches:
            added = [pa.array(np.full(batch.num_rows, part, np.int32))]
            for k, column in enumerate(at):
                value = batch.column(column).to_numpy()
                total = np.cumsum(value) + before[k]
                added.append(pa.array(total - value))
                before[k] = int(total[-1]) if len(total) else before[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    placed = cut(rows.mapInArrow(sums, schema))
    totals = placed.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    out = placed.join(F.broadcast(firsts), "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in names])


def dense_ids(df: DataFrame, order: list[Column | Descending], next_id: int | Column = 0, name: str = "entity_id") -> DataFrame:
    """Number rows from ``next_id`` in the given order, which should be total."""
    numbered = running(df, order, {"_n": F.lit(1)})
    return numbered.select((F.col("_n") + (F.lit(next_id) if isinstance(next_id, int) else next_id)).cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def groups_of(df: DataFrame, order: list[Column | Descending], size: int, name: str = "grp") -> DataFrame:
    """Consecutive groups of ``size`` rows, numbered from 0."""
    return running(df, order, {"_n": F.lit(1)}).withColumn(name, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def filled(df: DataFrame, order: list[Column | Descending], size: Column, most: int, name: str = "file_no") -> DataFrame:
    """The container of each row when rows are put into containers in the given order, and a new one is begun when the next row would make it larger than ``most``.

    The first container is empty at first, so a row larger than ``most``
    leaves it so, and each such row is alone. Rows without a size (null or 0)
    are in no container. Where a container begins depends on all rows before
    it: each partition first states what it makes of any filling it may be
    entered with, as a few ranges of fillings with one outcome each; the
    driver chains these, a row or few per partition, and each partition then
    fills its containers.
    """
    rows = dealt(df.withColumn("_v", F.coalesce(size.cast("long"), F.lit(0))), order)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    at = rows.columns.index("_v")

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b.column(at).to_numpy() for b in batches]
        value = np.concatenate(own) if own else np.zeros(0, np.int64)
        upto, begun, left = _outcomes(value[value > 0], most)
        part = np.full(len(upto), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, upto, begun, left)], ["_part", "upto", "begun", "left"])

    stated = rows.mapInArrow(outcomes, "_part int, upto long, begun long, left long").orderBy("_part", "upto").toPandas()
    entered, container, filling = {}, 0, 0
    for part, own in stated.groupby("_part", sort=True):
        entered[int(part)] = (container, filling)
        k = int(np.searchsorted(own["upto"].to_numpy(), filling, "left"))
        begun, left = int(own["begun"].iloc[k]), int(own["left"].iloc[k])
        container, filling = container + begun, left if begun else filling + left
    sent = df.sparkSession.sparkContext.broadcast(entered)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, filling = None, 0
        for batch in batches:
            if container is None and batch.num_rows:
                container, filling = sent.value[batch.column(at + 1)[0].as_py()]
            value = batch.column(at).to_numpy()
            number, container, filling = _numbers(value, most, container, filling)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, mask=value <= 0)], [*batch.schema.names, name])

    return rows.mapInArrow(fill, StructType([*rows.schema, *StructType.fromDDL(f"`{name}` long")])).drop("_v", "_part")


def _next_starts(ends: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """For a container that begins with row i, the row with which the next one begins."""
    return np.maximum(np.searchsorted(ends, ends - value + most, "right"), np.arange(len(value)) + 1)


def _outcomes(value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of fillings on entering, by their ascending upper ends: containers begun, and the filling of the last one on leaving.

    If none is begun, ``left`` is what is added to the filling.
    """
    n, ends = len(value), np.cumsum(value)
    if not n:
        return np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    jump = np.append(_next_starts(ends, value, most), n)
    count, last = np.append(np.ones(n, np.int64), 0), np.append(np.arange(n), n)
    while (jump < n).any():  # pointer doubling: count and last of the way to the end
        count, last = count + count[jump], np.where(jump < n, last[jump], last)
        jump = jump[jump]
    left = ends[-1] - (ends - value)[last[:n]]
    # entered with a filling f, the first container begins with the first row whose end is above most - f
    first = np.searchsorted(ends, most, "right")  # entered empty
    starts = np.arange(min(first, n - 1), -1, -1)  # the fuller, the earlier
    upto = most - np.append(0, ends)[starts]
    if first < n:
        keep_begun, keep_left = count[starts], left[starts]
    else:
        starts = np.arange(n, -1, -1)
        upto = most - np.append(0, ends)[starts]
        keep_begun, keep_left = np.append(0, count[starts[1:]]), np.append(ends[-1], left[starts[1:]])
    upto[-1] = np.iinfo(np.int64).max
    same = np.append((keep_begun[1:] == keep_begun[:-1]) & (keep_left[1:] == keep_left[:-1]), False)
    return upto[~same], keep_begun[~same], keep_left[~same]


def _numbers(value: np.ndarray, most: int, container: int | None, filling: int) -> tuple[np.ndarray, int, int]:
    """The container of each row, and the last one with its filling."""
    number, real = np.zeros(len(value), np.int64), np.flatnonzero(value > 0)
    own = value[real]
    ends, at = np.cumsum(own), 0
    out = np.zeros(len(own), np.int64)
    while at < len(own):
        to = max(at, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most - filling, "right")))
        out[at:to] = container
        if to < len(own):
            container, filling = container + 1, int(own[to])
            out[to] = container
            at = to + 1
        else:
            filling += int(ends[-1] - (ends[at - 1] if at else 0))
            at = to
    number[real] = out
    return number, container, filling
