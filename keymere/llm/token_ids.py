"""Token-id corpora: one flat id array per shard, document boundaries in Elias-Fano code.

A shard file holds, in this order, all ids (little-endian, 2 bytes where the
vocabulary allows, else 4), the doc_ids (8 bytes each), the three parts of the
boundary code and a trailer of fixed size. Boundaries are looked up with
``select``; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .scratch import Scratch, open_fs, wide
from .text import text_slices
from .tokenize import cache_of, encode_slice

MAGIC = b"KMTOKEN1"
_TRAILER = struct.Struct("<8sQQQQQQBB6x")
_NO_ID = -(1 << 63)
#: Ids that a reader holds at once, unless one document has more.
READ_IDS = 1 << 21
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def append_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind each document."""
    n = len(ends) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ends = ends + np.arange(n + 1)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    return out, ends


class ShardWriter:
    """Streams ids to a file; only boundaries and doc_ids stay in memory."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width, self.n_ids = uri, width, 0
        self.fs, self.final = open_fs(uri)
        self.fs.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.ends: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def write(self, doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.ends.append(ends[1:] + self.n_ids)
        self.docs.append(doc_ids)
        self.n_ids += len(ids)

    def close(self) -> int:
        ends, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ends, self.docs))
        code = EliasFano.encode(ends, self.n_ids)
        parts = code.parts()
        self.out.write(docs.astype("<i8").tobytes())
        for x in parts:
            self.out.write(x)
        self.out.write(_TRAILER.pack(MAGIC, len(docs), self.n_ids, *map(len, parts), 0, self.width, code.low_bits))
        self.out.close()
        self.fs.move(self.temp, self.final)
        return len(docs)


class ShardReader:
    """Random access to the documents of a shard file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        trailer = self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        magic, n, n_ids, a, b, c, _, self.width, low_bits = _TRAILER.unpack(trailer)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.n_docs, self.n_ids = n, n_ids
        at = n_ids * self.width
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n, at), "<i8")
        at += 8 * n
        low, high, samples = (np.frombuffer(self.file.read_at(k, at + s), d) for k, s, d in ((a, 0, np.uint8), (b, a, np.uint8), (c, a + b, "<u8")))
        self.boundaries = EliasFano(n, low_bits, low, high, samples)

    def span(self, i: int) -> tuple[int, int]:
        return (self.boundaries.access(i - 1) if i else 0), self.boundaries.access(i)

    def ids(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.width, first * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.span(i))

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, one past the last, boundaries from the first on, ids), in bounded blocks."""
        ends = np.concatenate([[0], self.boundaries.all()])
        at = 0
        while at < self.n_docs:
            to = min(max(int(np.searchsorted(ends, ends[at] + READ_IDS, "right")) - 1, at + 1), self.n_docs)
            yield at, to, ends[at : to + 1], self.ids(int(ends[at]), int(ends[to]))
            at = to


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary_size: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """Encode ``docs`` into shard files below ``folder``; returns their manifest (lazily).

    Documents are in ascending id order over all shards: a range partitioning,
    so no task holds more than its share. A null text is empty, a null id comes
    first. Rows of equal id are ordered by a hash of the text, and equal rows
    are dealt at random, so neither a repeated id nor a repeated row makes a
    large partition; each row is written. A very long text is encoded by
    itself. An empty table has an empty manifest. Other columns are ignored.
    Strings of special tokens get these tokens' ids, as the library does it by
    itself, or are ordinary text with ``plain``.
    """
    width = 2 if vocabulary_size <= 1 << 16 else 4
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), key.alias("k"), F.rand(3).alias("r"))
    rows = rows.repartitionByRange(*wide(rows), "id", "k", "r").sortWithinPartitions("id", "k", "t").select("id", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/shard-{shard:07d}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(uri, width)
            numbers = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for at, part in text_slices(batch.column(1)):
                ids, ends = append_end(*encode_slice(part, tokenizer, plain), end_id)
                out.write(numbers[at : at + len(part)], ids, ends)
        if out:
            n = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uri], "n_docs": [n], "n_ids": [out.n_ids]})

    return rows.mapInArrow(write, MANIFEST)


def read_token_shards(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    The manifest has a row per shard; only that list goes through the driver.
    """
    rows, base = [], 0
    for x in sorted(manifest.collect(), key=lambda x: x["shard"]):
        rows.append((x["path"], base))
        base += x["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                for a, b, ends, ids in shard.blocks():
                    data, own = ids.tobytes(), ends - ends[0]
                    crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(own[:-1].tolist(), own[1:].tolist())]
                    numbers = shard.doc_ids[a:b]
                    columns = {
                        "doc_id": pa.array(numbers, pa.int64(), mask=numbers == _NO_ID),
                        "start": pa.array(first + ends[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(ends), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)

    paths = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))
    return paths.mapInArrow(read, schema)


def token_corpus(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, **names) -> DataFrame:
    """Write the corpus below the scratch folder, keep its manifest there, and return the manifest."""
    spark = docs.sparkSession
    size = cache_of(tokenizer).tokenizer.get_vocab_size()
    return scratch.table(write_token_shards(docs, scratch.path("shards"), tokenizer, end_id, size, **names), "manifest")
