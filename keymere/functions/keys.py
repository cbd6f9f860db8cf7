"""Indexers: named key expressions with a comparison rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KeyExpression = str | Column | Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Indexer:
    """A key of an entity: a column name, a Column, or a function of the frame.

    ``comparer`` is ``exact``, ``ci`` (keys compare in lower case) or a
    function of the key's column that gives the form in which keys compare.
    Keys that are null are in no index. ``unique_allowed`` says whether a
    unique constraint may use the key.
    """

    name: str
    expression: KeyExpression
    key_type: str | None = None
    comparer: str | Callable[[Column], Column] = "exact"
    unique_allowed: bool = True

    def stored(self) -> dict:
        """The parts that can be stored; ``expression`` is None if the key is a function or has its own comparer."""
        plain = isinstance(self.expression, str) and isinstance(self.comparer, str)
        return {"name": self.name, "expression": self.expression if plain else None, "key_type": self.key_type, "comparer": self.comparer if plain else "exact", "unique_allowed": self.unique_allowed}

    def key(self, df: DataFrame) -> Column:
        """The key as it is."""
        e = self.expression
        c = e(df) if callable(e) and not isinstance(e, Column) else F.col(e) if isinstance(e, str) else e
        return c.cast(self.key_type) if self.key_type else c

    def normal(self, c: Column) -> Column:
        if callable(self.comparer):
            return self.comparer(c)
        return F.lower(c) if self.comparer == "ci" else c

    def compared(self, df: DataFrame) -> Column:
        """The key as it is compared."""
        return self.normal(self.key(df))

    def literal(self, value: object) -> Column:
        """A value in the form in which keys are compared; text is read as the key's type."""
        c = F.lit(value)
        if isinstance(value, str) and self.key_type and self.key_type != "string":
            c = string_to_key(value, self.key_type)
        return self.normal(c)

    def resolve(self, df: DataFrame, as_text: bool = False) -> DataFrame:
        """Distinct keys of the entities. As text, null becomes empty."""
        key = self.key(df)
        return df.select((F.coalesce(key.cast("string"), F.lit("")) if as_text else key).alias("key")).distinct()


def property_key(name: str, expression: KeyExpression, key_type: str | None = None) -> Indexer:
    return Indexer(name, expression, key_type)


def ignore_case(name: str, expression: KeyExpression) -> Indexer:
    return Indexer(name, expression, "string", "ci")


def identity(id_col: str = "entity_id") -> Indexer:
    return Indexer("identity", id_col, "long")


def numeric(name: str, expression: KeyExpression, key_type: str = "double") -> Indexer:
    return Indexer(name, expression, key_type)


def date_time(name: str, expression: KeyExpression) -> Indexer:
    return Indexer(name, expression, "timestamp_ntz")


def guid(name: str, expression: KeyExpression) -> Indexer:
    return Indexer(name, expression, "string", "ci")


def string_to_key(text: str, key_type: str) -> Column:
    """Text as a key of the type; text that isn't one gives null, which matches nothing."""
    return F.lit(text).try_cast(key_type)
