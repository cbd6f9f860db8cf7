"""Entity maps: a frame with stable ids, indices, constraints and versioned mutations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition
from ..functions.keys import Indexer
from .constraints import Constraints, CustomConstraint, UniqueConstraint
from .index import EntityIndex
from .prefix import Descending, dense_ids
from .query import EntityQuery


class ReadOnlyError(Exception):
    pass


@dataclass
class Segments:
    """Exponents of the levels of a segment address. The defaults and bounds are fixed values."""

    low: int = 8
    mid: int = 10
    high_min: int = 0
    high_max: int = 30

    def __post_init__(self) -> None:
        for name, value, least, most in (("low", self.low, 0, 20), ("mid", self.mid, 8, 20), ("high_min", self.high_min, 0, 30), ("high_max", self.high_max, 8, 30)):
            if not least <= value <= most:
                raise ValueError(f"{name} must be in {least}..{most}")
        if self.low + self.mid + self.high_max > 50:
            raise ValueError("exponents must sum to 50 at most")


@dataclass
class EntityMap:
    """id -> entity. Mutations return a new map and leave this one as it is.

    ``next_id`` is the id that the next added row gets; where it isn't given,
    it is looked up in the rows when it is needed. ``equality`` names the
    columns by which entities are the same (all columns if none).
    """

    df: DataFrame
    id_col: str = "entity_id"
    next_id: int | None = None
    indexers: dict[str, Indexer] = field(default_factory=dict)
    constraints: Constraints = field(default_factory=Constraints)
    segments: Segments = field(default_factory=Segments)
    equality: tuple[str, ...] = ()
    identity_indexers: tuple[str, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    per_segment: int = 16
    _read_only: int = 0
    _closed: bool = False

    # -- reading ---------------------------------------------------------
    def with_ids(self) -> DataFrame:
        return self.df

    def get(self, entity_id: int) -> DataFrame:
        return self.df.where(F.col(self.id_col) == entity_id)

    peek = get

    def page(self, count: int, offset: int = 0) -> DataFrame:
        return self.df.orderBy(self.id_col).offset(offset).limit(count)

    def show(self, count: int = 10, offset: int = 0) -> str:
        return "[" + ", ".join(str(r.asDict()) for r in self.page(count, offset).collect()) + "]"

    def size_frame(self) -> DataFrame:
        """size, highest_used_id, is_empty. The highest id is that of the rows; ``next_id`` survives removals."""
        n = F.count(F.lit(1))
        return self.df.agg(n.alias("size"), F.max(self.id_col).alias("highest_used_id"), (n == 0).alias("is_empty"))

    def size(self) -> int:
        return self.df.count()

    def free_id(self) -> int:
        """The id that the next added row gets: above all that were used."""
        if self.next_id is not None:
            return self.next_id
        top = self.df.agg(F.max(self.id_col)).first()[0]
        return 0 if top is None else int(top) + 1

    def release(self) -> None:
        self.df.unpersist()

    def iterate(self, action: Callable) -> None:
        self.df.foreach(action)

    def iterate_indexed(self, action: Callable) -> None:
        name = self.id_col
        self.df.foreach(lambda r: action(r[name], r))

    # -- indices ---------------------------------------------------------
    def with_index(self, *new: Indexer, unique: bool = False, identity: bool = False) -> EntityMap:
        out = self._with(indexers=self.indexers | {x.name: x for x in new})
        if unique:
            out.constraints = Constraints([*self.constraints.all])
            out.constraints.add(*[UniqueConstraint((x,)) for x in new])
        if identity:
            out.identity_indexers = (*self.identity_indexers, *[x.name for x in new])
        return out

    def with_category(self, name: str, *members: str) -> EntityMap:
        for m in members:
            self._indexer(m)
        return self._with(categories=self.categories | {name: members})

    def _indexer(self, name: str | Indexer) -> Indexer:
        return name if isinstance(name, Indexer) else self.indexers[name]

    def index(self, name: str | Indexer) -> EntityIndex:
        return EntityIndex(self.df, self._indexer(name), self.id_col)

    # -- querying --------------------------------------------------------
    def query(self, what: Condition | str | Indexer | None = None, *key: object, key_type: str | None = None):
        q = EntityQuery(self.df, self.id_col, self.indexers)
        return q if what is None else q.and_(what, *key, key_type=key_type)

    # -- mutations -------------------------------------------------------
    def _with(self, **changes) -> EntityMap:
        own = {k: getattr(self, k) for k in self.__dataclass_fields__} | changes
        return EntityMap(**own)

    def _guard(self) -> None:
        if self._closed:
            raise RuntimeError("the map is closed")
        if self._read_only:
            raise ReadOnlyError("the map is marked read-only")

    def _checked(self, df: DataFrame, **changes) -> EntityMap:
        self.constraints.check(df, self.id_col, self.df)
        return self._with(df=df, **changes)

    def add_all(self, rows: DataFrame, order: list[Column | Descending], **changes) -> EntityMap:
        """Add rows in the given order; they get the next ids. All or nothing: a violated constraint leaves the map as it is."""
        self._guard()
        first = self.free_id()
        if self.next_id is not None and not self.df.where(F.col(self.id_col) >= first).isEmpty():
            raise ValueError(f"ids from {first} on are in use")
        new = dense_ids(rows.drop(self.id_col), order, first, self.id_col)
        return self._checked(self.df.unionByName(new, allowMissingColumns=True), next_id=first + rows.count(), **changes)

    def add(self, **values: object) -> EntityMap:
        """Add one entity; columns that aren't given are null."""
        self._guard()
        if not values:
            raise ValueError("an entity is needed")
        if unknown := set(values) - set(self.df.columns) | {self.id_col} & set(values):
            raise ValueError(f"not columns of an entity: {', '.join(sorted(unknown))}")
        row = self.df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema if f.name != self.id_col])
        return self.add_all(row, [F.lit(0)])

    def _same(self, values: dict[str, object]) -> Column:
        """Whether a row is the entity: equal in the columns of ``equality``, null to null."""
        names = self.equality or tuple(c for c in self.df.columns if c != self.id_col)
        out = F.lit(True)
        for c in names:
            out &= F.col(c).eqNullSafe(F.lit(values.get(c)).cast(self.df.schema[c].dataType))
        return out

    def find(self, **values: object) -> int:
        """The smallest id of an entity that is the same as this one, or -1."""
        found = self.df.where(self._same(values)).agg(F.min(self.id_col)).first()[0]
        return -1 if found is None else int(found)

    def remove_entity(self, **values: object) -> tuple[EntityMap, int]:
        """Remove the first entity that is the same as this one; also its id, or -1."""
        self._guard()
        found = self.find(**values)
        return (self if found < 0 else self.remove([found])), found

    def replace(self, old: dict[str, object], new: dict[str, object]) -> EntityMap:
        """Put a new entity in the place of the first that is the same as ``old``; the very same or a missing one is an error."""
        self._guard()
        if old is new:
            raise ValueError("an entity can't replace itself")
        found = self.find(**old)
        if found < 0:
            raise KeyError("no such entity")
        fields = [F.lit(found).cast(self.df.schema[self.id_col].dataType).alias(self.id_col)]
        fields += [F.lit(new.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema if f.name != self.id_col]
        return self.set(self.df.sparkSession.range(1).select(*fields))

    def remove(self, ids: DataFrame | list[int]) -> EntityMap:
        self._guard()
        if isinstance(ids, list):
            return self._with(df=self.df.where(~F.col(self.id_col).isin(ids)), next_id=self.free_id())
        keys = ids.select(F.col(ids.columns[0]).alias(self.id_col))
        return self._with(df=self.df.join(keys, self.id_col, "left_anti"), next_id=self.free_id())

    def remove_first(self, condition: Condition) -> EntityMap:
        """Remove the match with the smallest id."""
        self._guard()
        return self.remove(self.df.where(condition.to_column(self.df)).agg(F.min(self.id_col).alias(self.id_col)))

    def remove_all(self, reset_ids: bool = True) -> EntityMap:
        self._guard()
        return self._with(df=self.df.limit(0), next_id=0 if reset_ids else self.free_id())

    def set(self, delta: DataFrame) -> EntityMap:
        """Replace rows by id: a row of ``delta`` takes the columns that it has. Ids that the map lacks are an error."""
        self._guard()
        if not delta.join(self.df, self.id_col, "left_anti").isEmpty():
            raise KeyError("unknown id")
        return self._checked(self.merged(delta))

    def merged(self, delta: DataFrame) -> DataFrame:
        names = [c for c in delta.columns if c != self.id_col]
        d = delta.withColumnsRenamed({c: f"_d_{c}" for c in names}).withColumn("_hit", F.lit(True))
        joined = self.df.join(d, self.id_col, "left")
        taken = lambda c: F.when(F.col("_hit"), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        return joined.select(*[taken(c) for c in self.df.columns])

    def update(self, condition: Condition, assignments: dict[str, Column]) -> EntityMap:
        self._guard()
        return self._checked(self.updated(condition, assignments))

    def updated(self, condition: Condition, assignments: dict[str, Column]) -> DataFrame:
        hit = F.coalesce(condition.to_column(self.df), F.lit(False))
        return self.df.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in self.df.columns])

    def apply(self, condition: Condition, assignments: dict[str, Column], result: Column) -> tuple[EntityMap, DataFrame]:
        """Update, and a result of each updated row."""
        after = self.update(condition, assignments)
        ids = self.df.where(condition.to_column(self.df)).select(self.id_col)
        return after, after.df.join(ids, self.id_col, "left_semi").select(self.id_col, result.alias("result"))

    def changes_from(self, old: EntityMap) -> DataFrame:
        """Rows added, removed and changed since an older version: ``change`` and the new row (the old one of removed ids)."""
        a, b = old.df.withColumn("_h", F.xxhash64(*old.df.columns)), self.df.withColumn("_h", F.xxhash64(*self.df.columns))
        added = self.df.join(old.df, self.id_col, "left_anti").withColumn("change", F.lit("insert"))
        removed = old.df.join(self.df, self.id_col, "left_anti").withColumn("change", F.lit("delete"))
        both = b.join(a.select(self.id_col, F.col("_h").alias("_o")), self.id_col).where("_h <> _o").drop("_h", "_o").withColumn("change", F.lit("update"))
        return added.unionByName(removed).unionByName(both)

    # -- marks -----------------------------------------------------------
    def mark_read_only(self) -> None:
        self._read_only += 1

    def unmark_read_only(self) -> None:
        self._read_only = max(0, self._read_only - 1)

    def close(self) -> None:
        self.df.unpersist()
        self._closed = True

    # -- persistence -----------------------------------------------------
    def segmented(self) -> DataFrame:
        """The rows with the number of their segment, by which they are stored: 2 ** per_segment ids each."""
        return self.df.withColumn("segment_id", F.shiftright(F.col(self.id_col), self.per_segment))

    def metadata(self) -> dict:
        """What a stored map needs beside its rows. Keys and predicates that are functions or columns have no stored form."""
        known = [{"name": c.name, "keys": [x.name for x in c.indexers]} if isinstance(c, UniqueConstraint) else {"name": c.name, "predicate": c.predicate if isinstance(c.predicate, str) else None, "on_change": c.on_change} for c in self.constraints.all]
        own = {x.name: x for c in self.constraints.all if isinstance(c, UniqueConstraint) for x in c.indexers} | self.indexers
        return {"id_col": self.id_col, "next_id": self.free_id(), "indexers": [own[n].stored() for n in sorted(own)], "constraints": known, "segments": vars(self.segments), "equality": list(self.equality), "identity": list(self.identity_indexers), "per_segment": self.per_segment}


def builder(
    df: DataFrame,
    id_col: str,
    *indexers: Indexer,
    unique: tuple[Indexer, ...] = (),
    custom: tuple[CustomConstraint, ...] = (),
    identity: tuple[Indexer, ...] = (),
    equality: tuple[str, ...] = (),
    segments: Segments | None = None,
    next_id: int | None = None,
) -> EntityMap:
    """An entity map over rows with ids. Without ``next_id`` added rows get ids above those of the rows."""
    out = EntityMap(df, id_col, next_id, {x.name: x for x in (*indexers, *unique, *identity)}, segments=segments or Segments(), equality=equality, identity_indexers=tuple(x.name for x in identity))
    out.constraints.add(*[UniqueConstraint((x,)) for x in unique], *custom)
    return out
