"""The query builder over an entity frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import And, Condition, Is, IsIn, IsNot, IsNotIn, Not, Or, Row, Where
from ..functions.keys import Indexer

#: Members above which a set is joined instead of listed in the plan.
LISTED = 1000


class ConditionBuilder:
    """Collects what a key must be: ``query.and_("city").is_("Rome")``."""

    def __init__(self, query: EntityQuery, index: Indexer, combine: Callable[[Condition], EntityQuery]):
        self.query, self.index, self.combine = query, index, combine
        self.negated = False

    def not_(self) -> ConditionBuilder:
        self.negated = not self.negated
        return self

    def _done(self, c: Condition) -> EntityQuery:
        return self.combine(Not(c) if self.negated else c)

    def is_(self, key: object) -> EntityQuery:
        return self._done(Is(self.index, key))

    def is_not(self, key: object) -> EntityQuery:
        return self._done(IsNot(self.index, key))

    def is_in(self, *keys: object) -> EntityQuery:
        return self._done(IsIn(self.index, keys))

    def is_not_in(self, *keys: object) -> EntityQuery:
        return self._done(IsNotIn(self.index, keys))

    def where(self, predicate: Callable[[Column], Column]) -> EntityQuery:
        return self._done(Where(self.index, predicate))

    def is_greater_than(self, value: object) -> EntityQuery:
        return self.where(lambda k: k > F.lit(value))


class EntityQuery:
    """Conditions folded from the left: ``A.and_(B).or_(C).and_(D)`` is ((A and B) or C) and D.

    Immutable; every call returns a new query. Results are in the order of
    ids unless ``order_by`` says otherwise.
    """

    def __init__(self, df: DataFrame, id_col: str, indexers: dict[str, Indexer], condition: Condition | None = None, skip: int = 0, limit: int | None = None, order: tuple[Column, ...] = ()):
        self.df, self.id_col, self.indexers = df, id_col, indexers
        self.condition, self._skip, self._limit, self._order = condition, skip, limit, order

    def _with(self, **changes) -> EntityQuery:
        own = {"condition": self.condition, "skip": self._skip, "limit": self._limit, "order": self._order} | changes
        return EntityQuery(self.df, self.id_col, self.indexers, **own)

    def index(self, name: str | Indexer) -> Indexer:
        if isinstance(name, Indexer):
            return name
        if name not in self.indexers:
            raise KeyError(f"no index {name}")
        return self.indexers[name]

    def _combined(self, kind: type, c: Condition) -> EntityQuery:
        return self._with(condition=c if self.condition is None else kind(self.condition, c))

    def and_(self, what: Condition | str | Indexer | EntityQuery, *key: object, key_type: str | None = None) -> EntityQuery | ConditionBuilder:
        """Add a condition, the condition of another query, or begin one on a key; a ``key_type`` must be the one that the index declares."""
        return self._add(And, what, key, key_type)

    def or_(self, what: Condition | str | Indexer | EntityQuery, *key: object, key_type: str | None = None) -> EntityQuery | ConditionBuilder:
        """The same, as an alternative. Of several queries each is one."""
        if isinstance(what, EntityQuery) and key:
            return self._add(Or, what, (), None).or_(*key)
        return self._add(Or, what, key, key_type)

    def _add(self, kind: type, what: Condition | str | Indexer | EntityQuery, key: tuple, key_type: str | None) -> EntityQuery | ConditionBuilder:
        if isinstance(what, EntityQuery):
            return self if what.condition is None else self._combined(kind, what.condition)
        if isinstance(what, Condition):
            return self._combined(kind, what)
        index = self.index(what)
        if key_type is not None and (index.key_type or self.declared(index)) != key_type:
            raise TypeError(f"the keys of {index.name} are {index.key_type or self.declared(index)}, not {key_type}")
        builder = ConditionBuilder(self, index, lambda c: self._combined(kind, c))
        return builder.is_(key[0]) if key else builder

    def declared(self, index: Indexer) -> str:
        """The type of an index's keys by the schema."""
        return self.df.select(index.key(self.df).alias("k")).schema["k"].dataType.simpleString()

    def where(self, predicate: Column) -> EntityQuery:
        """Add a predicate of the row itself."""
        return self._combined(And, Row(predicate))

    def skip(self, n: int) -> EntityQuery:
        if n < 0:
            raise ValueError("skip must not be negative")
        return self._with(skip=n)

    def limit(self, n: int) -> EntityQuery:
        """At most n rows; 0 gives none."""
        if n < 0:
            raise ValueError("limit must not be negative")
        return self._with(limit=n)

    def order_by(self, *columns: Column) -> EntityQuery:
        return self._with(order=columns)

    def matching(self) -> DataFrame:
        """All matches, unordered, without paging."""
        df, rest = self.df, self.condition
        # large sets at the top of a conjunction become semi-joins
        while isinstance(rest, And) and isinstance(rest.right, IsIn) and len(rest.right.values) > LISTED:
            df, rest = self._joined(df, rest.right), rest.left
        if isinstance(rest, IsIn) and len(rest.values) > LISTED:
            return self._joined(df, rest)
        return df if rest is None else df.where(rest.to_column(df))

    @staticmethod
    def _joined(df: DataFrame, c: IsIn) -> DataFrame:
        key = c.index.compared(df)
        kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
        keys = df.sparkSession.createDataFrame([(v,) for v in c.values if v is not None], f"_key {kind}").select(c.index.normal(F.col("_key")).alias("_key"))
        return df.withColumn("_key", key).join(keys, "_key", "left_semi").drop("_key")

    def execute(self) -> DataFrame:
        out = self.matching()
        if not (self._skip or self._order) and self._limit is None:
            return out
        out = out.orderBy(*self._order, self.id_col)
        out = out.offset(self._skip) if self._skip else out
        return out if self._limit is None else out.limit(self._limit)

    def first(self) -> DataFrame:
        """The first match behind ``skip`` (the limit doesn't count), as no row or one."""
        return self.matching().orderBy(*self._order, self.id_col).offset(self._skip).limit(1)

    def count_frame(self, name: str = "cnt") -> DataFrame:
        return self.matching().agg(F.count(F.lit(1)).alias(name))

    def count(self) -> int:
        """All matches; skip and limit don't count."""
        return self.matching().count()

    def any(self) -> bool:
        return not self.matching().isEmpty()

    def any_frame(self, name: str = "has_any") -> DataFrame:
        return self.matching().limit(1).agg((F.count(F.lit(1)) > 0).alias(name))

    def for_each(self, action: Callable) -> None:
        self.execute().foreach(action)
