"""The transaction log: entries are written as frames of bytes, each with its length and a checksum.

A log is a table (or files) of frames in the order of ``position``; a reader
stops at the first frame that isn't whole. All integers are little-endian.
Tables of frames are written and read by expressions; the functions on single
frames are for the writer and for log files.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Engine, StorageError

#: Fixed codes of log entries.
STORE, CREATE, TRANSFER, DELETE, TRUNCATE, COMMIT, ROLLBACK = range(1, 8)
#: An entry: its code, transaction, time, channel and number, and what its code has besides.
ENTRY = "type int, tx_id long, ts_ms long, channel int, seq long, file_no long, offset long, length long, object_ids array<long>, path string, op_count int, target_no long"
FRAME = "position long, frame binary"
#: Fixed layout: code, transaction, time, channel, number; then by code.
_HEAD = struct.Struct("<bqqiq")
_FIELDS: dict[int, tuple[tuple[str, str], ...]] = {
    STORE: (("file_no", "q"), ("offset", "q"), ("length", "q"), ("object_ids", "*q")),
    CREATE: (("file_no", "q"), ("path", "s")),
    TRANSFER: (("file_no", "q"), ("offset", "q"), ("length", "q"), ("target_no", "q")),
    DELETE: (("file_no", "q"),),
    TRUNCATE: (("file_no", "q"), ("length", "q")),
    COMMIT: (("op_count", "i"),),
    ROLLBACK: (),
}
_TYPES = dict(x.split() for x in ENTRY.split(", "))
_NAMES = list(_TYPES)
#: What is stored of a field of any length first: how many values or bytes follow.
_COUNT = "i"


def _size(kind: str) -> int:
    """Bytes of a field; of one of any length, those of its count."""
    return struct.calcsize("<" + (_COUNT if kind in ("*q", "s") else kind))


def _placed(fields: tuple[tuple[str, str], ...], at: int) -> list[tuple[str, str, int]]:
    """Name, kind and first byte in the body, of fields from ``at``. Only the last one may be of any length."""
    out = []
    for name, kind in fields:
        out.append((name, kind, at))
        at += _size(kind)
    return out


#: The same as _HEAD, field by field.
_HEAD_PLACED = _placed(tuple(zip(_NAMES, "bqqiq")), 0)
_PLACED = {code: _placed(fields, _HEAD.size) for code, fields in _FIELDS.items()}


def encode(entry: dict) -> bytes:
    """A frame: the length of the entry's bytes, these, and their CRC-32."""
    out = [_HEAD.pack(entry["type"], entry["tx_id"], entry["ts_ms"], entry["channel"], entry["seq"])]
    for name, kind in _FIELDS[entry["type"]]:
        value = entry[name]
        if kind == "*q":
            out.append(struct.pack(f"<i{len(value)}q", len(value), *value))
        elif kind == "s":
            text = value.encode()
            out.append(struct.pack("<i", len(text)) + text)
        else:
            out.append(struct.pack("<" + kind, value))
    body = b"".join(out)
    return struct.pack("<i", len(body)) + body + struct.pack("<I", zlib.crc32(body))


def decode(frame: bytes) -> dict | None:
    """The entry of a frame; None if it isn't whole or its fields don't fit in it."""
    if len(frame) < 8 + _HEAD.size or struct.unpack_from("<i", frame)[0] != len(frame) - 8:
        return None
    body = frame[4:-4]
    if zlib.crc32(body) != struct.unpack("<I", frame[-4:])[0] or body[0] not in _FIELDS:
        return None
    out = dict.fromkeys(_NAMES) | dict(zip(_NAMES, _HEAD.unpack_from(body)))
    at = _HEAD.size
    for name, kind in _FIELDS[out["type"]]:
        to = at + _size(kind)
        if to > len(body):
            return None
        if kind in ("*q", "s"):
            n, at = struct.unpack_from("<i", body, at)[0], to
            to = at + (8 * n if kind == "*q" else n)
            if not at <= to <= len(body):
                return None
            try:
                out[name] = list(struct.unpack_from(f"<{n}q", body, at)) if kind == "*q" else body[at:to].decode()
            except UnicodeDecodeError:
                return None
        else:
            out[name] = struct.unpack_from("<" + kind, body, at)[0]
        at = to
    return out


def split(data: bytes) -> Iterator[bytes]:
    """The frames of a log file, the last of which may be cut."""
    at = 0
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else -1
        to = at + size + 8 if size >= 0 else len(data)
        yield data[at:to]
        at = max(to, at + 1)


# Expressions are put together as SQL, for each of their hundreds of parts would else be a call of the JVM.


def _swapped(v: str) -> str:
    """A long with its bytes in the opposite order. The value is named eight times, so it should be a plain column."""
    for n, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        v = f"(shiftrightunsigned({v}, {n}) & {mask}L | shiftleft({v} & {mask}L, {n}))"
    return f"(shiftrightunsigned({v}, 32) | shiftleft({v}, 32))"


def _packed(v: str, kind: str) -> str:
    """The bytes of a whole number in hexadecimal digits, the lowest first."""
    swapped = _swapped(f"cast({v} as bigint)")
    return f"substring(lpad(hex({swapped}), 16, '0'), 1, {2 * _size(kind)})"


def _number(data: str, kind: str) -> str:
    """The long whose bytes are given, the highest first."""
    return f"cast(conv(hex({data}), 16, {-10 if kind == 'q' else 10}) as bigint)"


def _turned(v: str, kind: str) -> str:
    """What :func:`_number` read, the lowest byte first."""
    return v if kind == "b" else _swapped(v) if kind == "q" else f"shiftright({_swapped(v)}, 32)"


def encoded(entries: DataFrame, position: Column) -> DataFrame:
    """Frames of entries. One that lacks a field of its code is an error."""
    missing = "raise_error('an entry has no code, or lacks a field of its code')"

    def digits(name: str, kind: str) -> str:
        if kind == "*q":
            return f"{_packed(f'size({name})', _COUNT)}, array_join(transform({name}, x -> coalesce({_packed('x', 'q')}, {missing})), '')"
        return f"{_packed(f'octet_length({name})', _COUNT)}, hex({name})" if kind == "s" else _packed(name, kind)

    head = ", ".join(digits(f"`{name}`", kind) for name, kind, _ in _HEAD_PLACED)
    own = " ".join(f"when {code} then concat({', '.join(['""', *(digits(f'`{name}`', kind) for name, kind in fields)])})" for code, fields in _FIELDS.items())
    rows = entries.select(position.cast("long").alias("position"), *_NAMES)
    rows = rows.selectExpr("position", f"coalesce(unhex(concat({head}, case type {own} end)), {missing}) as body")
    rows = rows.selectExpr("position", "body", "octet_length(body) as size", "crc32(body) as crc")
    # a table of one frame each: conditions on what is read from frames would else be evaluated by writing them again for each use
    return rows.selectExpr("position", f"explode(array(concat(unhex({_packed('size', 'i')}), body, unhex({_packed('crc', 'i')})))) as frame")


def decoded(frames: DataFrame) -> DataFrame:
    """Entries of frames with their position and whether they are ``valid``; the fields of others are null."""
    body = lambda at, n: f"substring(frame, {at} + 5, {n})"
    number = lambda at, kind: f"_{kind}{at}"  # noqa: E731  once it is read
    read = sorted({(at, _COUNT if kind in ("*q", "s") else kind) for fields in (_HEAD_PLACED, *_PLACED.values()) for _, kind, at in fields})
    size = "(octet_length(frame) - 8)"
    rows = frames.selectExpr(
        "cast(position as bigint) as position",
        "frame",
        f"{_number('substring(frame, 1, 4)', 'i')} as _size",
        f"{_number('substring(frame, -4, 4)', 'i')} as _crc",
        f"crc32({body(0, size)}) as _own",
        *[f"{_number(body(at, _size(kind)), kind)} as {number(at, kind)}" for at, kind in read],
    )
    whole = f"{size} >= {_HEAD.size} and {_turned('_size', 'i')} = {size} and shiftrightunsigned({_swapped('_crc')}, 32) = _own"
    rows = rows.selectExpr("position", "frame", f"{whole} as _whole", *[f"{_turned(number(at, kind), kind)} as {number(at, kind)}" for at, kind in read])

    code, fit = number(0, "b"), []
    for c, fields in _PLACED.items():
        ok = f"{size} >= {_HEAD.size + sum(_size(kind) for _, kind, _ in fields)}"
        for _, kind, at in fields[-1:]:
            if kind in ("*q", "s"):
                n = number(at, _COUNT)
                ok += f" and {n} between 0 and ({size} - {at + 4}) div {8 if kind == '*q' else 1}"
            if kind == "s":
                ok += f" and is_valid_utf8(cast({body(at + 4, f'cast({n} as int)')} as string))"
        fit.append(f"when {c} then {ok}")
    rows = rows.selectExpr("*", f"coalesce(_whole and case {code} {' '.join(fit)} end, false) as valid")

    def value(kind: str, at: int) -> str:
        if kind not in ("*q", "s"):
            return number(at, kind)
        n = f"cast({number(at, _COUNT)} as int)"
        if kind == "s":
            return f"cast({body(at + 4, n)} as string)"
        return f"transform(transform(array_repeat(0, {n}), (_, i) -> {_number(body(f'{at + 4} + 8 * i', 8), 'q')}), x -> {_swapped('x')})"

    found = {name: f"when valid then {value(kind, at)}" for name, kind, at in _HEAD_PLACED}
    for name in _NAMES[len(found) :]:
        found[name] = " ".join(f"when valid and {code} = {c} then {value(kind, at)}" for c, fields in _PLACED.items() for other, kind, at in fields if other == name)
    return rows.selectExpr("position", "valid", *[f"cast(case {x} end as {_TYPES[name]}) as `{name}`" for name, x in found.items()])


def up_to_damage(entries: DataFrame) -> DataFrame:
    """Entries before the first one that isn't valid."""
    bad = entries.agg(F.min(F.when(~F.col("valid"), F.col("position"))).alias("bad"))
    return entries.where(F.col("position") < F.coalesce(bad.scalar(), F.lit((1 << 63) - 1)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of log files: each file up to its first damaged frame. Files are read whole, one a row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                whole = []
                for frame in split(data):
                    if decode(frame) is None:
                        break
                    whole.append(frame)
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(whole), pa.string()), "position": pa.array(range(len(whole)), pa.int64()), "frame": pa.array(whole, pa.binary())})

    frames = files.mapInArrow(run, f"path string, {FRAME}")
    return decoded(frames).where("valid").drop("valid")


def transactions(entries: DataFrame) -> DataFrame:
    """tx_id, entries, committed: a commit that is followed by no rollback of the transaction."""
    last = F.max_by("type", F.when(F.col("type").isin(COMMIT, ROLLBACK), F.col("position")))
    return entries.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(last == COMMIT, F.lit(False)).alias("committed"))


class Log:
    """A writer of transactions: begun, filled with entries, committed or rolled back. Each is one commit of the log's root."""

    def __init__(self, engine: Engine, root: str = "log", channel: int = 0):
        self.engine, self.root, self.channel, self.open = engine, root, channel, {}
        frames = engine.root(root)
        last = None if frames is None else frames.agg(F.max("position").alias("p")).first()["p"]
        self.position = 0 if last is None else last + 1
        known = None if frames is None else decoded(frames).agg(F.max("tx_id").alias("t")).first()["t"]
        self.next_tx = (known or 0) + 1

    def begin(self) -> int:
        tx, self.next_tx = self.next_tx, self.next_tx + 1
        self.open[tx] = []
        return tx

    def _add(self, tx: int, kind: int, **fields) -> None:
        if tx not in self.open:
            raise StorageError(f"transaction {tx} isn't open")
        own = self.open[tx]
        own.append({"type": kind, "tx_id": tx, "ts_ms": time.time_ns() // 1_000_000, "channel": self.channel, "seq": len(own) + 1} | fields)

    def store(self, tx: int, file_no: int, offset: int, length: int, object_ids: list[int]) -> None:
        self._add(tx, STORE, file_no=file_no, offset=offset, length=length, object_ids=list(object_ids))

    def create(self, tx: int, file_no: int, path: str) -> None:
        self._add(tx, CREATE, file_no=file_no, path=path)

    def transfer(self, tx: int, file_no: int, offset: int, length: int, target_no: int) -> None:
        self._add(tx, TRANSFER, file_no=file_no, offset=offset, length=length, target_no=target_no)

    def delete(self, tx: int, file_no: int) -> None:
        self._add(tx, DELETE, file_no=file_no)

    def truncate(self, tx: int, file_no: int, length: int) -> None:
        self._add(tx, TRUNCATE, file_no=file_no, length=length)

    def commit(self, tx: int) -> None:
        n = len(self.open.get(tx, []))
        self._add(tx, COMMIT, op_count=n)
        self._write(tx)

    def rollback(self, tx: int) -> None:
        self._add(tx, ROLLBACK)
        self._write(tx)

    def _write(self, tx: int) -> None:
        rows = [(self.position + k, bytearray(encode(e))) for k, e in enumerate(self.open[tx])]
        self.engine.append(self.root, self.engine.spark.createDataFrame(rows, FRAME))
        self.position += len(rows)
        del self.open[tx]

    def entries(self) -> DataFrame:
        """The log's entries, up to the first damaged one."""
        frames = self.engine.root(self.root)
        return up_to_damage(decoded(self.engine.spark.createDataFrame([], FRAME) if frames is None else frames)).drop("valid")


def recover(engine: Engine, root: str, sizes: DataFrame) -> DataFrame:
    """What a start after a crash finds: each file that committed transactions wrote, its size by the log, and its state.

    sizes: file_no, size of the files that are there.
    """
    from .storage import recovery

    log = Log(engine, root).entries()
    done = transactions(log).where("committed").select("tx_id")
    expected = log.where(F.col("type") == STORE).join(done, "tx_id", "left_semi").groupBy("file_no").agg(F.max(F.col("offset") + F.col("length")).alias("expected_size"))
    return recovery(expected, sizes)
