"""Vectorised splitting of Arrow text columns into words and tokenizer chunks.

All functions work on whole texts. Byte masks over the Arrow buffer find the
boundaries, Arrow's dictionary encoding finds the distinct pieces, so Python
objects are made for distinct pieces only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the arrays over them take some thirty times as much.
SLICE_BYTES = 2 << 20
#: White space beyond ASCII in UTF-8, its two or three bytes as a number.
_ODD_SPACE = np.array([int.from_bytes(chr(x).encode(), "big") for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, slice)`` pairs of at most ``most`` bytes, or of one longer text; nulls become empty."""
    column = pa.array(column, pa.string()) if not isinstance(column, pa.Array) else column
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, column.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of :func:`text_slices` and the offsets of its rows, from 0."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def pieces(raw: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Cut ``raw`` at ``starts`` (ascending, the first 0)."""
    ends = np.append(starts, len(raw)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def free_prefix(names: list[str], stem: str) -> str:
    """A beginning that none of the names has: for columns that are put beside a user's."""
    while any(n.lower().startswith(stem) for n in names):
        stem = "_" + stem
    return stem


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    ``offsets[i]:offsets[i+1]`` are the words of row i in ``ids``, which index
    ``vocabulary`` (a list of bytes). ``starts``/``ends`` are byte positions in ``raw``.
    """

    def __init__(self, column: pa.Array, lower_ascii: bool = False):
        raw, rows = utf8(column)
        if lower_ascii:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw, self.rows = raw, rows
        word = ~is_space(raw)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw):
            cut[1:-1] = word[1:] != word[:-1]
            cut[rows[:-1][rows[:-1] < len(raw)]] = True
            cut[-1] = False
        starts = np.flatnonzero(cut)
        encoded = pieces(raw, starts).dictionary_encode() if len(starts) else None
        real = word[starts] if len(starts) else np.zeros(0, bool)
        ends = np.append(starts[1:], len(raw))
        self.starts, self.ends = starts[real], ends[real]
        self.ids = np.asarray(encoded.indices)[real] if encoded is not None else np.zeros(0, np.int32)
        self.vocabulary: list[bytes] = encoded.dictionary.to_pylist() if encoded is not None else []
        self.offsets = np.searchsorted(self.starts, rows)


def chunk_starts(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions at which texts can be cut without a change to the tokens of either vocabulary.

    Cuts are made before a single space between non-spaces, around a single
    line feed between non-spaces, and between an ASCII letter and a following
    full stop or comma. No pre-token of the two vocabularies crosses them.
    """
    kind = np.zeros(256, np.uint8)
    kind[[9, 11, 12, 13]] = 1
    kind[10], kind[32] = 2, 3
    kind[65:91] = kind[97:123] = 4
    kind[[44, 46]] = 5
    kind[[28, 29, 30, 31]] = 1
    k = kind[raw]
    space = (k >= 1) & (k <= 3)
    cut = np.zeros(len(raw) + 1, bool)
    single = (k == 3) | (k == 2)
    single[1:] &= ~space[:-1]
    single[:-1] &= ~space[1:]
    if len(raw):
        single[0] = single[-1] = False
        edge = np.zeros(len(raw) + 1, bool)
        edge[rows] = True
        single &= ~edge[:-1] & ~edge[1:]
    cut[:-1] = single
    cut[1:] |= single & (k == 2)
    cut[1:-1] |= (k[1:] == 5) & (k[:-1] == 4)
    cut[rows[:-1]] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def odd_rows(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows that have white space beyond ASCII."""
    lead = np.zeros(256, bool)
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    at = np.flatnonzero(lead[raw])
    if not len(at):
        return at
    near = np.append(raw, [0, 0]).astype(np.int32)
    two = near[at] << 8 | near[at + 1]
    found = at[np.isin(np.where(near[at] == 0xC2, two, two << 8 | near[at + 2]), _ODD_SPACE)]
    return np.unique(np.searchsorted(rows, found, "right") - 1)


def gather(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[s:s+n]`` of all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    first = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - first, lengths) + np.arange(total)]
