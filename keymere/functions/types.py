"""Types of entities: their Spark forms, and a dictionary of ids, names and schemas."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed ids and Spark forms of the built-in types.
BUILT_IN: dict[str, tuple[int, str]] = {
    "object": (1, "bigint"),
    "string": (2, "string"),
    "int32": (3, "int"),
    "int64": (4, "bigint"),
    "boolean": (5, "boolean"),
    "byte": (6, "smallint"),
    "int16": (7, "smallint"),
    "single": (8, "float"),
    "double": (9, "double"),
    "decimal": (10, "decimal(38,18)"),
    "datetime": (11, "timestamp_ntz"),
    "datetimeoffset": (12, "struct<at:timestamp,offset_minutes:int>"),
    "timespan": (13, "interval day to second"),
    "guid": (14, "string"),
    "char": (15, "string"),
    "sbyte": (16, "tinyint"),
    "uint16": (17, "int"),
    "uint32": (18, "bigint"),
    "uint64": (19, "decimal(20,0)"),
    "byte[]": (20, "binary"),
    "int32[]": (21, "array<int>"),
    "string[]": (22, "array<string>"),
    "object[]": (23, "array<bigint>"),
}
#: First id of types that are registered later.
FIRST_OWN = 1000


class TypeConflict(Exception):
    pass


@dataclass
class TypeDictionary:
    """Names, ids and schemas of entity types. A name keeps its id; a changed schema is a conflict."""

    own: dict[str, tuple[int, T.StructType]] = field(default_factory=dict)

    def register(self, name: str, schema: T.StructType, type_id: int | None = None) -> int:
        if name in BUILT_IN:
            raise TypeConflict(f"{name} is a built-in type")
        if name in self.own:
            known, old = self.own[name]
            if old != schema or type_id not in (None, known):
                raise TypeConflict(f"{name} is registered otherwise")
            return known
        ids = {i for i, _ in self.own.values()}
        if type_id is not None and (type_id in ids or type_id < FIRST_OWN):
            raise TypeConflict(f"type id {type_id} is taken")
        new = type_id if type_id is not None else max(ids, default=FIRST_OWN - 1) + 1
        self.own[name] = (new, schema)
        return new

    def id_of(self, name: str) -> int | None:
        return BUILT_IN[name][0] if name in BUILT_IN else self.own[name][0] if name in self.own else None

    def name_of(self, type_id: int) -> str | None:
        pairs = [*((n, i) for n, (i, _) in BUILT_IN.items()), *((n, i) for n, (i, _) in self.own.items())]
        return next((n for n, i in pairs if i == type_id), None)

    def schema_of(self, name: str) -> T.StructType | None:
        return self.own[name][1] if name in self.own else None

    def frame(self, spark: SparkSession) -> DataFrame:
        """The dictionary as a table: type_id, type_name, schema_json (null for built-in types)."""
        rows = [(i, n, None) for n, (i, _) in BUILT_IN.items()] + [(i, n, s.json()) for n, (i, s) in self.own.items()]
        return spark.createDataFrame(rows, "type_id long, type_name string, schema_json string")

    @classmethod
    def from_frame(cls, df: DataFrame) -> TypeDictionary:
        rows = df.where("schema_json is not null").collect()  # a row per type
        return cls({r["type_name"]: (r["type_id"], T.StructType.fromJson(json.loads(r["schema_json"]))) for r in rows})


@dataclass(frozen=True)
class Handler:
    """A type of values: how they are stored, and how they come back, as functions of columns."""

    name: str
    to_stored: Callable[[Column], Column]
    from_stored: Callable[[Column], Column]


@dataclass
class Handlers:
    """Handlers by name, applied to the columns of a frame that have their type."""

    known: dict[str, Handler] = field(default_factory=dict)

    def add(self, handler: Handler) -> None:
        if handler.name in self.known:
            raise TypeConflict(f"{handler.name} has a handler")
        self.known[handler.name] = handler

    def _of(self, name: str) -> Handler:
        if name not in self.known:
            raise TypeConflict(f"{name} has no handler")
        return self.known[name]

    def to_stored(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.withColumns({c: self._of(h).to_stored(F.col(c)) for c, h in columns.items()})

    def from_stored(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.withColumns({c: self._of(h).from_stored(F.col(c)) for c, h in columns.items()})
