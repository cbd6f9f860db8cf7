"""Batched tokenization with a vocabulary file of the ``tokenizers`` library.

Texts are cut where no pre-token can cross, each distinct piece is encoded by
the library, workers remember the pieces that they meet most, and the ids of a
text are put together from those of its pieces. Texts with white space beyond
ASCII, or with the string of an added token, go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import chunk_starts, gather, odd_rows, pieces, utf8

#: Distinct pieces that a worker remembers; beyond that it forgets the half that it met least.
CACHE_PIECES = 1 << 18
#: Byte -> character of the byte-level alphabet (a rule of the vocabularies): letters for bytes that don't stand for themselves.
_OWN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = np.arange(256, dtype="<u4")
_ALPHABET[[b for b in range(256) if b not in _OWN_BYTES]] = 256 + np.arange(256 - len(_OWN_BYTES))
_BREAK = chr(_ALPHABET[10])
_CACHES: dict[tuple[str, bool], "PieceCache"] = {}


class PieceCache:
    """Ids of pieces, in one pool; ``uses`` counts how often each was met, with older meetings worth less."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        added = [] if plain else self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content.encode() for x in added]
        if any(x.normalized or x.single_word for x in added):
            raise ValueError("added tokens that depend on their surroundings aren't supported")
        self.known = pa.array([], pa.binary())
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int32) for _ in range(3))

    def encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) by the library as it is."""
        ids, sizes = [], []
        for i in range(0, len(texts), 512):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False):
                own = e.ids
                sizes.append(len(own))
                ids.append(np.array(own, np.uint32))
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array(sizes, np.int32)

    def encode_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters up to U+024F, each with a space before it or none.

        They go straight to the library's model, in the form that the whole
        tokenizer gives them: lower case and without the space where the
        vocabulary has it so, then the byte-level alphabet.
        """
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0].as_py()
        if self.lower:
            data = data.replace(b" ", b"").decode().lower().encode()
        letters = _ALPHABET[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        found = [[x.id for x in self.model.tokenize(w)] for w in letters.split(_BREAK)]
        return np.fromiter((x for own in found for x in own), np.uint32), np.fromiter(map(len, found), np.int32)

    def encode(self, new: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's ids start, their number) of distinct pieces."""
        word = _words_of_letters(new)
        ids, sizes = np.zeros(0, np.uint32), np.zeros(len(new), np.int32)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        if word.any():
            ids, sizes[word] = self.encode_words(new.filter(pa.array(word)))
        if not word.all():
            rest, sizes[~word] = self.encode_whole(new.filter(pa.array(~word)).cast(pa.string()).to_pylist())
            ids = np.concatenate([ids, rest])
        starts = np.zeros(len(new), np.int32)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids, starts, sizes

    def lookup(self, found: pa.BinaryArray) -> np.ndarray:
        """The number of each piece; new ones are encoded. Numbers hold until the next lookup."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        n = len(self.known)
        at = pc.index_in(found, value_set=self.known)
        number = at.fill_null(-1).to_numpy(zero_copy_only=False)
        missed = number < 0
        if missed.any():
            number = number.copy()
            new = found.filter(pa.array(missed)).dictionary_encode()
            number[missed] = n + np.asarray(new.indices)
            ids, starts, sizes = self.encode(new.dictionary)
            self.starts = np.concatenate([self.starts, starts + np.int32(len(self.pool))])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, ids])
            self.known = pa.concat_arrays([self.known, new.dictionary])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])
        self.uses += np.bincount(number, minlength=len(self.uses)).astype(np.int32)
        return number

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.uses, kind="stable")[-(CACHE_PIECES // 2) :])  # of equals the latest
        self.known = self.known.take(pa.array(keep))
        self.pool = gather(self.starts[keep], self.sizes[keep], self.pool)
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] >> 1
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)


def _words_of_letters(column: pa.BinaryArray) -> np.ndarray:
    """Which pieces are a word of ASCII letters and letters from U+00C0 to U+024F, with a space before it or none.

    U+0130 isn't taken, as its lower case is two characters.
    """
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[: ends[-1]]
    before = np.append(np.uint8(0), raw[:-1])
    bad = ~((raw | 32) - np.uint8(97) < 26) & (raw < 0x80)
    bad |= (raw >= 0xC9) | (raw == 0xC2)
    bad |= (before == 0xC3) & ((raw == 0x97) | (raw == 0xB7)) | (before == 0xC4) & (raw == 0xB0)
    spaced = raw[ends[:-1]] == 32
    bad[ends[:-1][spaced]] = False
    total = np.append(0, np.cumsum(bad, dtype=np.int64))
    return (total[ends[1:]] == total[ends[:-1]]) & (np.diff(ends) > spaced)


def cache_of(path: str, plain: bool = False) -> PieceCache:
    """With ``plain``, strings of special tokens in a text are ordinary text; else they get their ids, as the library does by itself."""
    if (path, plain) not in _CACHES:
        _CACHES[path, plain] = PieceCache(path, plain)
    return _CACHES[path, plain]


def encode_slice(column: pa.Array, path: str, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice of ``text_slices`` as one array, and the offsets of each text in it."""
    cache = cache_of(path, plain)
    raw, rows = utf8(column)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
    data = raw.tobytes()
    odd = odd_rows(raw, rows)
    if any(x in data for x in cache.added):
        odd = np.union1d(odd, [i for i in range(len(rows) - 1) if any(x in data[rows[i] : rows[i + 1]] for x in cache.added)]).astype(np.int64)
    if len(odd) == len(rows) - 1:
        ids, sizes = cache.encode_whole([data[rows[i] : rows[i + 1]].decode() for i in odd])
        return ids, np.append(0, np.cumsum(sizes, dtype=np.int64))
    filled = np.flatnonzero(rows[1:] > rows[:-1])
    starts = chunk_starts(raw, np.append(rows[filled], len(raw)))
    number = cache.lookup(pieces(raw, starts))
    sizes = cache.sizes[number]
    ids = gather(cache.starts[number], sizes, cache.pool)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))[np.searchsorted(starts, rows)]
    return _with_whole(cache, data, rows, ids, ends, odd) if len(odd) else (ids, ends)


def _with_whole(cache: PieceCache, data: bytes, rows: np.ndarray, ids: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids that the library gives for the whole texts ``odd`` in place of those of their pieces."""
    own, own_sizes = cache.encode_whole([data[rows[i] : rows[i + 1]].decode() for i in odd])
    own_ends = np.append(0, np.cumsum(own_sizes))
    out, at = [], 0
    for k, i in enumerate(odd):
        out += [ids[at : ends[i]], own[own_ends[k] : own_ends[k + 1]]]
        at = ends[i + 1]
    sizes = np.diff(ends)
    sizes[odd] = own_sizes
    return np.concatenate([*out, ids[at:]]), np.append(0, np.cumsum(sizes))
