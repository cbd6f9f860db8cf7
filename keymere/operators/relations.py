"""Joins between entity frames: semi, anti, lookup and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a set of wanted ids is sent to all tasks.
SENT_ROWS = 1_000_000


def having(df: DataFrame, keys: list[str], **conditions: tuple[Column, Column]) -> DataFrame:
    """Keys whose aggregates fulfil all conditions: name -> (aggregate, test of a column of that name)."""
    out = df.groupBy(*keys).agg(*[a.alias(n) for n, (a, _) in conditions.items()])
    for _, test in conditions.values():
        out = out.where(test)
    return out.select(*keys)


def exists(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` with a partner. ``on``: column of left -> column of right."""
    keys = right.select(*[F.col(b).alias(a) for a, b in on.items()])
    return left.join(keys, list(on), "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    keys = right.select(*[F.col(b).alias(a) for a, b in on.items()])
    return left.join(keys, list(on), "left_anti")


def by_ids(df: DataFrame, id_col: str, ids: list | DataFrame) -> DataFrame:
    """Rows with the wanted ids. A short list becomes a pushed-down filter, a long one or a frame a semi-join."""
    if isinstance(ids, list):
        if len(ids) <= 1000:
            return df.where(F.col(id_col).isin(ids))
        kind = df.schema[id_col].dataType.simpleString()
        wanted = df.sparkSession.createDataFrame([(x,) for x in ids], f"`{id_col}` {kind}")
        return df.join(F.broadcast(wanted) if len(ids) <= SENT_ROWS else wanted, id_col, "left_semi")
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def navigate(parents: DataFrame, children: DataFrame, on: dict[str, str], aggregates: dict[str, Column]) -> DataFrame:
    """Parents with aggregates of their children (parents without children are left out)."""
    sums = children.groupBy(*on.values()).agg(*[c.alias(n) for n, c in aggregates.items()]).withColumnsRenamed({b: a for a, b in on.items()})
    return parents.join(sums, list(on))


def nest(children: DataFrame, key: str, columns: list[str], order: str, name: str = "items") -> DataFrame:
    """Children of each key as an ordered array of structs (as long as a key's children are many)."""
    return children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(name))


def conditional(children: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Counts and tests of the children of each key, without gathering them: aggregates of conditions."""
    return children.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def map_value(column: Column, key: object) -> Column:
    """The value of a key of a dictionary, null where it isn't there."""
    return F.try_element_at(column, F.lit(key))


def map_contains(column: Column, key: object) -> Column:
    return F.coalesce(F.map_contains_key(column, key), F.lit(False))


def sample_of(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by a hash of seed and id: the same ones each time, however the rows are dealt."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def overlapping(intervals: DataFrame, start: Column, end: Column, first: Column, last: Column) -> DataFrame:
    """Intervals that meet [first, last], ends included."""
    return intervals.where((start <= last) & (end >= first))


def range_join(a: DataFrame, b: DataFrame, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of intervals (start, end) of both frames that overlap: an equi-join on bins of ``width``.

    A pair is taken in the bin in which the later of both starts, so it occurs once.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.withColumnsRenamed({"start": "a_start", "end": "a_end"})
    y = b.withColumnsRenamed({"start": "b_start", "end": "b_end"})
    joined = x.withColumn("_bin", bins("a_start", "a_end")).join(y.withColumn("_bin", bins("b_start", "b_end")), ["_bin", *(on or [])])
    met = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    return joined.where(met & (F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width))).drop("_bin")
