"""Constraints as frames of violations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Indexer


class ConstraintViolation(Exception):
    def __init__(self, name: str):
        super().__init__(f"constraint {name} is violated")
        self.name = name


@dataclass(frozen=True)
class UniqueConstraint:
    """At most one entity for each combination of non-null keys."""

    indexers: tuple[Indexer, ...]

    def __post_init__(self) -> None:
        if unfit := [x.name for x in self.indexers if not x.unique_allowed]:
            raise ValueError(f"not suitable for a unique constraint: {', '.join(unfit)}")

    @property
    def name(self) -> str:
        return "+".join(x.name for x in self.indexers)

    def violations(self, df: DataFrame) -> DataFrame:
        keyed = df.select(*[x.compared(df).alias(x.name) for x in self.indexers])
        return keyed.dropna().groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def conflicts(self, delta: DataFrame, existing: DataFrame) -> DataFrame:
        """Keys of new rows that exist already or occur twice among them."""
        names = [x.name for x in self.indexers]
        new = delta.select(*[x.compared(delta).alias(x.name) for x in self.indexers]).dropna()
        old = existing.select(*[x.compared(existing).alias(x.name) for x in self.indexers]).dropna()
        return new.groupBy(*names).count().where("count > 1").select(*names).unionByName(new.join(old, names, "left_semi")).distinct()


@dataclass(frozen=True)
class CustomConstraint:
    """A predicate (a Column or SQL text) that each row must fulfil; null counts as not fulfilled.

    With ``on_change`` it is about the structs ``old`` (the row that is
    replaced; null for a new one) and ``new``, and is checked of the rows that
    a mutation adds or changes.
    """

    name: str
    predicate: Column | str
    on_change: bool = False

    def _unfulfilled(self, df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce(F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate, F.lit(False)))

    def violations(self, df: DataFrame, id_col: str = "entity_id") -> DataFrame:
        return self._unfulfilled(df).select(F.lit(self.name).alias("constraint_name"), F.col(id_col).alias("entity_id"))

    def change_violations(self, old: DataFrame, new: DataFrame, id_col: str = "entity_id") -> DataFrame:
        both = changed_rows(old, new, id_col)
        return self._unfulfilled(both).select(F.lit(self.name).alias("constraint_name"), F.col(id_col).alias("entity_id"))


def changed_rows(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """id, ``old`` and ``new`` as structs, of rows that are new or differ."""
    a = old.select(F.col(id_col).alias("_id"), F.struct(*old.columns).alias("old"))
    b = new.select(id_col, F.struct(*old.columns).alias("new"))
    return b.join(a, F.col(id_col) == F.col("_id"), "left").where(~F.col("old").eqNullSafe(F.col("new"))).select(id_col, "old", "new")


@dataclass
class Constraints:
    """Checked in the order in which they were added; the first that fails is raised."""

    all: list[UniqueConstraint | CustomConstraint] = field(default_factory=list)

    def add(self, *new: UniqueConstraint | CustomConstraint) -> None:
        for x in new:
            if any(y.name == x.name for y in self.all):
                raise ValueError(f"constraint {x.name} exists")
            self.all.append(x)

    def remove(self, name: str) -> bool:
        n = len(self.all)
        self.all = [x for x in self.all if x.name != name]
        return len(self.all) < n

    def has(self, name: str) -> bool:
        return any(x.name == name for x in self.all)

    def clear(self) -> None:
        self.all.clear()

    def violations(self, df: DataFrame, id_col: str, before: DataFrame | None = None) -> DataFrame:
        """All violations of custom constraints: constraint_name, entity_id."""
        found = [x.change_violations(df.limit(0) if before is None else before, df, id_col) if x.on_change else x.violations(df, id_col) for x in self.all if isinstance(x, CustomConstraint)]
        out = found[0] if found else df.limit(0).select(F.lit("").alias("constraint_name"), F.col(id_col).alias("entity_id"))
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def check(self, df: DataFrame, id_col: str, before: DataFrame | None = None) -> None:
        for x in self.all:
            if isinstance(x, UniqueConstraint):
                bad = x.violations(df)
            elif x.on_change:
                bad = x.change_violations(df.limit(0) if before is None else before, df, id_col)
            else:
                bad = x.violations(df, id_col)
            if not bad.isEmpty():
                raise ConstraintViolation(x.name)
