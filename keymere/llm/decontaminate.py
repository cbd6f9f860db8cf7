"""Benchmark decontamination: passages of documents within an edit distance of benchmark items.

Words (lower case, ASCII marks at the ends taken off) are the symbols. An item
with k edits allowed is cut into k + 1 pieces. Edits touch at most k of them,
wherever they lie, so any passage within the limit holds a piece unchanged.
The CGK random walk of a piece emits at each step the word under the pointer,
and moves on or stays by a random bit of that word, until it leaves the piece.
Windows of the pieces' sizes, one at each word of each document, are walked
with the same bits; equal words give equal walks, so a window that agrees with
a piece in all steps is a candidate, and none is missed. An exact
edit-distance computation around it decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, text_slices
from .toxicity import stems

#: Edits allowed, as a share of the item's words.
RATE = 0.1
#: Steps of a walk for each word of its piece; by then it has nearly always left the piece.
STEPS = 3
#: Items, and bytes of their texts, compared in one pass over the documents. The index of so many has about 8 bytes a byte.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 8 << 20
_BLOCK = 1 << 16
FOUND = "item_id long, first_word long, n_words long, distance long, item_words long"


def word_values(words: Words) -> np.ndarray:
    """A 64-bit value for each word; words that differ only in case or in marks at their ends share it."""
    import xxhash

    values = np.array([xxhash.xxh3_64_intdigest(x) if x else 0 for x in stems(words.vocabulary)] or [0], np.uint64)
    return values[words.ids] if len(words.ids) else np.zeros(0, np.uint64)


def symbols(values: np.ndarray) -> np.ndarray:
    """32-bit values of words for the walk; their bits steer it."""
    with np.errstate(over="ignore"):
        mixed = values * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def walk_keys(symbols: np.ndarray, count: int, sizes: list[int]) -> list[np.ndarray]:
    """For each size, a 32-bit key of all that the walks from the first ``count`` words emit within so many words."""
    padded = np.concatenate([symbols, np.zeros(max(sizes) + 1, np.uint32)])
    at, moved = np.arange(count), np.zeros(count, np.uint8)
    key, keys = np.zeros(count, np.uint32), [np.zeros(count, np.uint32) for _ in sizes]
    emitted, bit, inside = np.empty(count, np.uint32), np.empty(count, np.uint32), np.empty(count, bool)
    moved = moved if max(sizes) * STEPS < 256 else moved.astype(np.int64)
    for step in range(STEPS * max(sizes)):
        np.take(padded, at, out=emitted, mode="clip")
        key ^= emitted
        key *= np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        for size, own in zip(sizes, keys):
            if step < STEPS * size:
                np.less(moved, size, out=inside)
                np.copyto(own, key, where=inside)
        np.right_shift(emitted, np.uint32(step % 31), out=bit)
        np.bitwise_and(bit, np.uint32(1), out=bit)
        np.add(at, bit, out=at, casting="unsafe")
        np.add(moved, bit, out=moved, casting="unsafe")
    return keys


@dataclass
class _Table:
    """The pieces of one size, by their keys."""

    size: int
    hashes: np.ndarray  # ascending
    owners: np.ndarray  # item numbers
    firsts: np.ndarray  # first word of the piece in its item
    seen: np.ndarray  # bitmap of the hashes, 32 to 64 times as many bits


class ItemIndex:
    """Pieces and words of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE):
        self.ids, self.values, self.rate = [], [], rate
        column = pa.array([t or "" for _, t in items], pa.large_string())
        for at, part in text_slices(column):
            words = Words(part)
            values = word_values(words)
            for i in range(len(part)):
                own = values[words.offsets[i] : words.offsets[i + 1]]
                if len(own):
                    self.ids.append(items[at + i][0])
                    self.values.append(own)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, v in enumerate(self.values):
            n = min(self.limit(i) + 1, len(v))
            by_size.setdefault(len(v) // n, []).extend((i, p * len(v) // n) for p in range(n))
        self.tables = [self._build(size, pieces) for size, pieces in sorted(by_size.items())]

    def limit(self, i: int) -> int:
        return int(self.rate * len(self.values[i]))

    def _build(self, size: int, pieces: list[tuple[int, int]]) -> _Table:
        words = np.concatenate([self.values[i][first : first + size] for i, first in pieces])
        key = walk_keys(symbols(words), len(words), [size])[0][::size]
        order = np.argsort(key, kind="stable")
        owners, firsts = np.array(pieces).T
        seen = np.zeros(1 << min(max(12, len(pieces).bit_length() + 5), 32), bool)
        seen[key & np.uint32(len(seen) - 1)] = True
        return _Table(size, key[order], owners[order].astype(np.int32), firsts[order].astype(np.int32), np.packbits(seen, bitorder="little"))

    def n_bytes(self) -> int:
        """Of the arrays."""
        return sum(v.nbytes for v in self.values) + sum(t.hashes.nbytes + t.owners.nbytes + t.firsts.nbytes + t.seen.nbytes for t in self.tables)

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, item numbers, where the item would start) of windows that agree with a piece."""
        if not len(values):
            return
        sizes, letters = [t.size for t in self.tables], symbols(values)
        for first in range(0, len(values), _BLOCK):
            near = letters[first : first + _BLOCK + max(sizes)]
            for t, key in zip(self.tables, walk_keys(near, min(_BLOCK, len(values) - first), sizes)):
                low = key & np.uint32(8 * len(t.seen) - 1)
                maybe = np.flatnonzero(np.take(t.seen, low >> np.uint32(3)) >> (low & np.uint32(7)).astype(np.uint8) & np.uint8(1))
                if not len(maybe):
                    continue
                a, b = np.searchsorted(t.hashes, key[maybe], "left"), np.searchsorted(t.hashes, key[maybe], "right")
                n = b - a
                if n.any():
                    at = first + np.repeat(maybe, n)
                    slot = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    texts = np.searchsorted(offsets, at, "right") - 1
                    whole = at + t.size <= offsets[texts + 1]
                    yield texts[whole], t.owners[slot[whole]], (at - t.firsts[slot])[whole]

    def matches(self, values: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, first word, words, distance, item words): the best passage of each item in each text, if within the limit."""
        found = [np.stack(x) for x in self.candidates(values, offsets)]
        if not found:
            return []
        texts, items, starts = np.concatenate(found, axis=1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.lexsort((starts, items, texts))
        done = (-1, -1, -1)
        for text, item, start in zip(texts[order].tolist(), items[order].tolist(), starts[order].tolist()):
            v, k = self.values[item], self.limit(item)
            if done[:2] == (text, item) and start <= done[2]:
                continue
            lo, hi = max(int(offsets[text]), start - k), min(int(offsets[text + 1]), start + k + len(v) + k)
            done = (text, item, start + k // 2)
            region = values[lo:hi]
            if np.isin(v, region).sum() < len(v) - k:  # each edit takes at most one of the item's words
                continue
            d, a, b = infix_distance(v, region)
            if d <= k and (d, lo + a) < best.get((text, item), (k + 1, 0, 0))[:2]:
                best[text, item] = (d, lo + a, b - a)
        return [(t, self.ids[i], a - int(offsets[t]), n, d, len(self.values[i])) for (t, i), (d, a, n) in sorted(best.items())]


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between ``item`` and any infix of ``text``, and that infix's bounds.

    Sellers' recurrence, a row per word of the item. Insertions within a row
    are a running minimum of value minus column. The start of the best infix
    is carried along; among equal values the later start is taken.
    """
    m = len(text)
    column = np.arange(m + 1)
    big = m + 1  # value * big - start orders by value, then the later start
    row = -column.astype(np.int64)
    for i, w in enumerate(item):
        new = row + big
        if m:
            np.minimum(new[1:], row[:-1] + np.where(text == w, 0, big), out=new[1:])
        row = np.minimum.accumulate(new - column * big) + column * big
    end = int(np.argmin(row))
    value = int((row[end] + big - 1) // big) if row[end] > 0 else 0
    return value, int(value * big - row[end]), end


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and item found in it: doc_id and the columns of ``FOUND``.

    A passage counts if it differs from the item in at most ``rate`` of the
    item's words (insertions, deletions, substitutions), wherever the edits
    lie; of an item's passages in a text the closest is given, and of equally
    close ones the first. So an item of one word is found in every text that
    has this word, whole texts being searched however long they are. Items and
    texts that are null or without words match nothing; an empty table of
    either gives no rows. Items go to the tasks in blocks of about
    ``ITEMS_AT_ONCE`` items and ``BYTES_AT_ONCE`` bytes, each against all
    documents. Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    wanted = items.where("text is not null").select("item_id", "text")
    total = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(-(-total["n"] // ITEMS_AT_ONCE), -(-total["b"] // BYTES_AT_ONCE) if total["n"] else 0)
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = ItemIndex(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str), rate)
        if index.values:
            found = _search(own, index, schema)
            out = found if block == 0 else out.unionByName(found)
    return out


def _search(docs: DataFrame, index: ItemIndex, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first, part in text_slices(batch.column(1)):
                words = Words(part)
                found = index.matches(word_values(words), words.offsets)
                if found:
                    text, *rest = zip(*found)
                    ids = batch.column(0).take(pa.array([first + t for t in text]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "first_word", "n_words", "distance", "item_words"])

    return docs.mapInArrow(run, schema)
