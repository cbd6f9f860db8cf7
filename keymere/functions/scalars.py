"""Scalar computations of the storage layer as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_of(key: Column, channels: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(channels))


def segment_address(entity_id: Column, low: int = 8, mid: int = 10) -> dict[str, Column]:
    """The three levels of a segment address."""
    return {"low": entity_id.bitwiseAND((1 << low) - 1), "mid": F.shiftright(entity_id, low).bitwiseAND((1 << mid) - 1), "high": F.shiftright(entity_id, low + mid)}


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_length(v: Column) -> Column:
    """Bytes of the zig-zag variable-length form of a long."""
    z = zigzag(v)
    bits = F.when(z == 0, 1).when(z < 0, 64).otherwise(F.length(F.bin(z)))
    return F.ceil(bits / 7).cast("int")


def rolling_checksum(data: Column) -> Column:
    """Unsigned 32-bit ``c = (c << 1) ^ b`` over the bytes. Only the last 32 bytes count, as older ones are shifted out."""
    tail = F.substring(data, F.greatest(F.octet_length(data) - 31, F.lit(1)), F.lit(32))
    hexed = F.hex(tail)
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(tail), F.lit(1)))
    byte = lambda i: F.coalesce(F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"), F.lit(0).cast("long"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda c, i: F.shiftleft(c, 1).bitwiseXOR(byte(i)).bitwiseAND(0xFFFFFFFF))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def mask_secrets(text: Column) -> Column:
    """The values of password fields in a connection string, replaced by stars."""
    return F.regexp_replace(text, r"(?i)(password|pwd)\s*=\s*[^;]*", "$1=***")


def rating(value: Column, excellent: float, good: float, fair: float) -> Column:
    return F.when(value >= excellent, "Excellent").when(value >= good, "Good").when(value >= fair, "Fair").otherwise("Poor")


def ticks_to_micros(ticks: Column) -> Column:
    return F.floor(ticks / 10).cast("long")


def nanos_to_ticks(nanos: Column) -> Column:
    return F.floor(nanos / 100).cast("long")


def age_in_years(born: Column, now: Column) -> Column:
    return F.year(now) - F.year(born)


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def numbered_name(number: Column, digits: int) -> Column:
    return F.lpad(number.cast("string"), digits, "0")
