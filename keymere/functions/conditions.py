"""Conditions over index keys, compiled to one Column.

Logic has two values: a leaf is false for a null key, and ``Not`` is the
complement, so ``Not(Is(k, v))`` holds for a null key where ``IsNot(k, v)``
doesn't. Negations are pushed to the leaves before compilation, which leaves
plain comparisons that Spark can push down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import Indexer


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Or(self, other)

    def __invert__(self) -> Condition:
        return self.operand if isinstance(self, Not) else Not(self)

    def to_column(self, df: DataFrame) -> Column:
        """A boolean column, never true where the condition doesn't hold."""
        return merge(normal_form(self)).build(df, False)

    def build(self, df: DataFrame, negated: bool) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Is(Condition):
    index: Indexer
    value: object

    def build(self, df: DataFrame, negated: bool) -> Column:
        key = self.index.compared(df)
        if self.value is None:
            return F.lit(negated)
        return ~key.eqNullSafe(self.index.literal(self.value)) if negated else key == self.index.literal(self.value)


@dataclass(frozen=True)
class IsNot(Condition):
    index: Indexer
    value: object

    def build(self, df: DataFrame, negated: bool) -> Column:
        key = self.index.compared(df)
        if self.value is None:
            return key.isNull() if negated else key.isNotNull()
        return key.isNull() | (key == self.index.literal(self.value)) if negated else key != self.index.literal(self.value)


@dataclass(frozen=True)
class IsIn(Condition):
    index: Indexer
    values: tuple

    def build(self, df: DataFrame, negated: bool) -> Column:
        key, values = self.index.compared(df), [self.index.literal(v) for v in self.values if v is not None]
        found = key.isin(values) if values else F.lit(False)
        return key.isNull() | ~found if negated else found


@dataclass(frozen=True)
class IsNotIn(Condition):
    index: Indexer
    values: tuple

    def build(self, df: DataFrame, negated: bool) -> Column:
        key, values = self.index.compared(df), [self.index.literal(v) for v in self.values if v is not None]
        found = key.isin(values) if values else F.lit(False)
        return key.isNull() | found if negated else key.isNotNull() & ~found


@dataclass(frozen=True)
class Where(Condition):
    """Any predicate of the key, given as a function of its column."""

    index: Indexer
    predicate: Callable[[Column], Column]

    def build(self, df: DataFrame, negated: bool) -> Column:
        found = self.predicate(self.index.key(df))
        return ~F.coalesce(found, F.lit(False)) if negated else found


@dataclass(frozen=True)
class Row(Condition):
    """Any predicate of the row, as a column; null counts as false."""

    predicate: Column

    def build(self, df: DataFrame, negated: bool) -> Column:
        return ~F.coalesce(self.predicate, F.lit(False)) if negated else self.predicate


@dataclass(frozen=True)
class And(Condition):
    left: Condition
    right: Condition

    def build(self, df: DataFrame, negated: bool) -> Column:
        return self.left.build(df, negated) & self.right.build(df, negated)


@dataclass(frozen=True)
class Or(Condition):
    left: Condition
    right: Condition

    def build(self, df: DataFrame, negated: bool) -> Column:
        return self.left.build(df, negated) | self.right.build(df, negated)


@dataclass(frozen=True)
class Not(Condition):
    operand: Condition

    def build(self, df: DataFrame, negated: bool) -> Column:
        return self.operand.build(df, not negated)


def normal_form(c: Condition, negated: bool = False) -> Condition:
    """Negations at the leaves only."""
    if isinstance(c, Not):
        return normal_form(c.operand, not negated)
    if isinstance(c, (And, Or)):
        kind = (Or if isinstance(c, And) else And) if negated else type(c)
        return kind(normal_form(c.left, negated), normal_form(c.right, negated))
    return Not(c) if negated else c


def merge(c: Condition) -> Condition:
    """``k = a or k = b`` becomes ``k in (a, b)``."""
    if isinstance(c, And):
        return And(merge(c.left), merge(c.right))
    if isinstance(c, Or):
        left, right = merge(c.left), merge(c.right)
        a, b = _members(left), _members(right)
        if a and b and a[0] is b[0]:
            return IsIn(a[0], tuple(dict.fromkeys(a[1] + b[1])))
        return Or(left, right)
    return c


def _members(c: Condition) -> tuple[Indexer, tuple] | None:
    if isinstance(c, Is) and c.value is not None:
        return c.index, (c.value,)
    return (c.index, c.values) if isinstance(c, IsIn) else None


def is_in(index: Indexer, values: Iterable) -> IsIn:
    return IsIn(index, tuple(values))


def row_differs(c: Column, value: object) -> Column:
    """``!=`` as a row predicate of the host language has it: true for null."""
    return ~c.eqNullSafe(F.lit(value))
