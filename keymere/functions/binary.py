"""Values as bytes: variable-length integers, and whole rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import varint_length, zigzag


def varint(v: Column) -> Column:
    """The zig-zag variable-length form of a long: seven bits a byte, the lowest first, and a mark on all but the last."""
    z, n = zigzag(v), varint_length(v)
    byte = lambda i: F.lpad(F.hex(_seven(z, i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


def from_varint(data: Column) -> Column:
    """The long that :func:`varint` wrote."""
    hexed = F.hex(data)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    z = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(127), 7 * i)))
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(1))


def _seven(z: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", z, 7 * i).bitwiseAND(127)


#: Fixed: how values of fixed length are packed, little-endian.
_PACKED = {"tinyint": "b", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d", "boolean": "?"}
_EPOCH = datetime(1970, 1, 1)


def _pack(value: object, kind: T.DataType) -> bytes:
    name = kind.simpleString()
    if name in _PACKED:
        return struct.pack("<" + _PACKED[name], value)
    if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
        data = bytes(value) if isinstance(kind, T.BinaryType) else str(value).encode()
        return struct.pack("<i", len(data)) + data
    if isinstance(kind, T.DateType):
        return struct.pack("<i", (value - date(1970, 1, 1)).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        plain = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return struct.pack("<q", (plain - _EPOCH) // timedelta(microseconds=1))
    if isinstance(kind, T.ArrayType):
        return struct.pack("<i", len(value)) + b"".join(_value(x, kind.elementType) for x in value)
    if isinstance(kind, T.StructType):
        return b"".join(_value(value[f.name], f.dataType) for f in kind)
    raise TypeError(f"{name} has no stored form")


def _value(value: object, kind: T.DataType) -> bytes:
    """A mark whether there is a value, and the value."""
    return b"\0" if value is None else b"\1" + _pack(value, kind)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> object:
        (out,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def value(self, kind: T.DataType) -> object:
        if not self.take("?"):
            return None
        name = kind.simpleString()
        if name in _PACKED:
            return self.take(_PACKED[name])
        if isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)):
            n = self.take("i")
            raw = self.data[self.at : self.at + n]
            self.at += n
            return raw if isinstance(kind, T.BinaryType) else Decimal(raw.decode()) if isinstance(kind, T.DecimalType) else raw.decode()
        if isinstance(kind, T.DateType):
            return date(1970, 1, 1) + timedelta(days=self.take("i"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            plain = _EPOCH + timedelta(microseconds=self.take("q"))
            return plain.replace(tzinfo=timezone.utc) if isinstance(kind, T.TimestampType) else plain
        if isinstance(kind, T.ArrayType):
            return [self.value(kind.elementType) for _ in range(self.take("i"))]
        return {f.name: self.value(f.dataType) for f in kind}


def encode(row: dict, schema: T.StructType) -> bytes:
    return b"".join(_value(row[f.name], f.dataType) for f in schema)


def decode(data: bytes, schema: T.StructType) -> dict:
    reader = _Reader(data)
    return {f.name: reader.value(f.dataType) for f in schema}


def serialised(df: DataFrame, name: str = "data") -> DataFrame:
    """Each row as one value of bytes."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(r, schema) for r in batch.to_pylist()], pa.binary())], [name])

    return df.mapInArrow(run, f"`{name}` binary")


def deserialised(df: DataFrame, schema: T.StructType, name: str = "data") -> DataFrame:
    """The rows that :func:`serialised` wrote."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([decode(x, schema) for x in batch.column(0).to_pylist()], schema=kinds)

    return df.select(name).mapInArrow(run, schema)
