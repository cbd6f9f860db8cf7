"""Packing of documents into training sequences over the length histogram.

Documents are cut into pieces of the sequence length and one remainder. The
remainders are packed by their histogram alone, longest first, each length into
the shortest packs that it fits: a pattern is a list of lengths and how often
it is used. Documents then take their places by their rank among the pieces of
equal length, so nothing but the histogram goes through the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, wide
from .text import text_slices
from .token_ids import append_end
from .tokenize import encode_slice

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids. A null text is empty and has the end id only.

    Strings of special tokens get these tokens' ids, as the library does it by
    itself, or are ordinary text with ``plain``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_slices(batch.column(1)):
                ids, ends = append_end(*encode_slice(part, tokenizer, plain), end_id)
                sizes = np.diff(ends)
                count = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, sizes[row] - start)
                first = ends[row] + start
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist())]
                columns = {
                    "doc_id": batch.column(0).slice(at, len(part)).take(pa.array(row)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(sizes[row], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + size).tolist())], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack_histogram(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: ``(count, lengths of the pattern)`` for a histogram of lengths.

    Lengths go longest first into the packs with most room left, so packs grow
    evenly; of a pattern that is used more often than needed only a part is
    changed. At most two patterns are added per length.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pattern: tuple[int, ...], room: int) -> None:
        if room:
            open_packs[room].append((count, pattern))
        else:
            done.append((count, pattern))

    for size in sorted(histogram, reverse=True):
        left = int(histogram[size])
        if not 0 < size <= length:
            raise ValueError(f"length {size} doesn't fit {length}")
        while left:
            room = next((r for r in range(length, size - 1, -1) if open_packs.get(r)), -1)
            if room < 0:
                put(left, (size,), length - size)
                break
            count, pattern = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((count - used, pattern))
            put(used, (*pattern, size), room - size)
            left -= used
    for packs in open_packs.values():
        done += packs
    return [x for x in done if x[0]]


class Places:
    """Which sequence and offset the piece of a length takes by its rank among the pieces of that length."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]], first_sequence: int):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        at = first_sequence
        for count, pattern in patterns:
            offset = 0
            for size in pattern:
                slots[size].append((count, at, offset))
                offset += size
            at += count
        self.sequences = at
        self.tables = {size: (np.cumsum([0] + [c for c, _, _ in x])[:-1], np.array([s for _, s, _ in x]), np.array([o for _, _, o in x])) for size, x in slots.items()}

    def of(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        firsts, sequence, offset = self.tables[size]
        at = np.searchsorted(firsts, ranks, "right") - 1
        return sequence[at] + ranks - firsts[at], offset[at]


def pack(pieces: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`cut_pieces`.

    Full pieces are sequences of their own. Pieces are dealt by ranges of
    (length, doc_id, start), equal ones at random, so neither a very common
    length nor a much repeated row makes a large partition; a task needs the
    counts per length of the partitions before it: at most a row per partition
    and length, and each partition holds few lengths.
    """
    columns = pieces.columns
    names = [*columns, "_part", "_rank"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            size = batch.column(columns.index("length")).to_numpy()
            if not len(size):
                continue
            first = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
            ranks = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size))))
            if size[0] == last:
                ranks[: first[1] if len(first) > 1 else len(size)] += seen
            last, seen = size[-1], ranks[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part), pa.int64()), pa.array(ranks, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = ["length", "doc_id", "start", "ids_crc32"]
    dealt = pieces.withColumn("_deal", F.rand(5)).repartitionByRange(*wide(pieces), *order, "_deal").sortWithinPartitions(*order).drop("_deal")
    ordered = scratch.table(dealt.mapInArrow(rank, schema + ", _part long, _rank long"), "ordered")
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = defaultdict(int)
    for row in sorted(ordered.groupBy("length", "_part").count().collect(), key=lambda x: (x["_part"], x["length"])):
        before[row["_part"], row["length"]] = total[row["length"]]
        total[row["length"]] += row["count"]
    full = total.pop(length, 0)
    places = Places(pack_histogram(total, length), full)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(names.index("_part")).to_numpy()
            size = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            pairs = part.astype(np.int64) * (length + 1) + size
            for pair in np.unique(pairs):
                own = np.flatnonzero(pairs == pair)
                p, s = divmod(int(pair), length + 1)
                ranks = rank[own] + before[p, s]
                if s == length:
                    sequence[own] = ranks
                else:
                    sequence[own], offset[own] = places.of(s, ranks)
            out = {c: batch.column(names.index(c)) for c in columns}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ordered.mapInArrow(assign, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, length: int = 1024, with_ids: bool = False, **names) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Each id of each document lies in exactly one piece. Offsets of a sequence
    have no gaps; the room that is left at its end is padding. Rows of equal
    id and text are packed as often as they occur. A null text has the end id
    only, a null id stays null, an empty table gives no rows, and a very long
    text is cut into as many pieces as it needs. Other columns are ignored.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, length, with_ids, **names)
    return pack(scratch.table(pieces, "pieces"), length, scratch)


def sequences(packed: DataFrame, length: int, pad_id: int) -> DataFrame:
    """The sequences themselves: sequence_id, n_ids and ids, padded unless the filled length is a power of two.

    Needs pieces with ids. A sequence has at most ``length`` ids, so no group is large.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for n, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                ids.append(own if n & (n - 1) == 0 else np.pad(own, (0, length - n), constant_values=pad_id))
            yield pa.RecordBatch.from_pydict({"sequence_id": batch.column(0), "n_ids": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return grouped.mapInArrow(join, "sequence_id long, n_ids long, ids array<int>")
