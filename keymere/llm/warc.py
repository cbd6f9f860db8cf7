"""WARC archives with a two-level capture index.

Records are gzip members. The index sorts capture lines by reversed-host URL
key into compressed blocks; a sparse directory has the first key of each
block. A lookup finds the index file, then the block, then the line by binary
search, and the record by one range read.
"""

from __future__ import annotations

import base64
import bisect
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, open_fs, wide

#: Fixed values of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BLOCK_LINES = 1024
FILE_BYTES = 1 << 30
#: Groups of equal payloads that are sent to all tasks (their sum, page and URL).
HOT_GROUPS = 1000
_NO_ID = -(1 << 63)
CAPTURES = "key string, page_id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host reversed, in lower case; null and urls without a host sort first.

    Tabs and line feeds, which separate fields and lines of the index, are percent-encoded.
    """
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "\t", "%09"), "\n", "%0A")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)), F.lit(""))


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit that has the response's HTTP headers but no payload.

    ``WARC-Page-ID`` and ``WARC-Refers-To-Page-ID`` are headers of our own;
    readers that don't know them follow the target URI and date.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + _one_line(url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {DATE}"]
        head += [f"WARC-Refers-To-Target-URI: {_one_line(refers_url)}"] if refers_url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC headers, the payload's full length and the payload that the record holds."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return headers, length, payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row below ``folder``; returns the captures (lazily).

    Of equal payloads of at least ``min_bytes`` bytes those with the largest
    page_id are responses and the others revisit it; smaller payloads are all
    responses. A null payload is empty. A null page_id is kept, but never
    referred to; rows that repeat the largest page_id are all responses, and a
    row that is there several times has as many records, each with an id of
    its own. Very long payloads are single records. An empty table makes no
    file; other columns are ignored. Equality is that of SHA-1 sums. The
    largest groups of copies, ``HOT_GROUPS`` at most, are sent to all tasks,
    and the others are joined, so that no task gets a large group. File names
    hold the attempt, so a repeated task never changes a file that captures
    point to.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("key", url_key(F.col("url")))
    named = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("last")
    last = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(named, F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    hot = last.orderBy(F.desc("n"), "sha1").limit(HOT_GROUPS).select("sha1", F.col("last").alias("hot"))
    rows = rows.join(F.broadcast(hot), "sha1", "left")
    # rows that are settled go anywhere
    key = F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.rand(11).cast("string")))
    joined = rows.withColumn("find", key).join(last.select(F.col("sha1").alias("find"), "last"), "find", "left").withColumn("last", F.coalesce("hot", "last"))
    refers = (F.length("payload") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    joined = joined.withColumns({"refers_to": F.when(refers, F.col("last.page_id")), "refers_url": F.when(refers, F.col("last.url"))})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        stem, number, out, at = f"{task.partitionId():07d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for payload, page, url, refers, refers_url, sha1 in zip(batch.column(5), *(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6))):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(str(uuid.uuid4()), page, url, payload.as_buffer().to_pybytes(), digest, refers, refers_url)
                if out is None or at + len(data) > FILE_BYTES:
                    if out:
                        out.close()
                    name, at, number = f"{stem}-{number:04d}.warc.gz", 0, number + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                files.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    return joined.select("page_id", "url", "refers_to", "refers_url", "key", "payload", "sha1").mapInArrow(write, CAPTURES)


DIRECTORY = "file string, first_key string, first_page long, offset long, length long"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into compressed blocks of index files; returns the block directory (lazily)."""
    ordered = captures.repartitionByRange(*wide(captures), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{task.partitionId():07d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.idx"
        out, at, lines, found = None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
            out.write(data)
            found.append((name, lines[0][0], lines[0][1], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, page, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append((key, _NO_ID if page is None else page, *rest))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["file", "first_key", "first_page", "offset", "length"])

    return ordered.mapInArrow(write, DIRECTORY)


class CaptureIndex:
    """An index: the folders of index and archive files and the first keys of the index files.

    The directory of a file's blocks is read from the directory table only by
    the tasks that look into the file.
    """

    def __init__(self, index_folder: str, archive_folder: str, directory: DataFrame):
        self.index_folder, self.archive_folder, self.directory = index_folder, archive_folder, directory

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Captures of distinct (key, page_id) rows; what isn't there gives no row.

        Wanted rows are dealt by ranges, so that a task looks into neighbouring
        blocks only. Each task gets the list of index files with their first
        keys, and loads the block directories of the files it needs.
        """
        index_folder = self.index_folder
        files = self.directory.groupBy("file").agg(F.min(F.struct("first_key", "first_page")).alias("first"), F.sort_array(F.collect_list(F.struct("first_key", "first_page", "offset", "length"))).alias("blocks"))
        firsts = sorted(((r["first"]["first_key"], r["first"]["first_page"]), r["file"]) for r in files.select("file", "first").collect())
        table = _directory_files(files, index_folder)
        keys = [x[0] for x in firsts]
        names = [x[1] for x in firsts]
        spark = wanted.sparkSession
        if not names:
            return spark.createDataFrame([], CAPTURES)
        table.count()

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_fs(index_folder)
            open_file, blocks, loaded, lines = None, [], None, []
            for batch in batches:
                found = []
                for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    mark = (key, _NO_ID if page is None else page)
                    at = max(bisect.bisect_left(keys, mark) - 1, 0)
                    while at < len(names) and keys[at] <= mark:
                        if open_file != names[at]:
                            open_file = names[at]
                            blocks = _read_directory(fs, f"{root}/{open_file}.dir")
                            data = fs.open_input_file(f"{root}/{open_file}")
                        b = max(bisect.bisect_left(blocks, mark, key=lambda x: x[:2]) - 1, 0)
                        while b < len(blocks) and blocks[b][:2] <= mark:
                            if loaded != (open_file, b):
                                loaded = (open_file, b)
                                lines = _lines(data.read_at(blocks[b][3], blocks[b][2]))
                            k = bisect.bisect_left(lines, mark, key=lambda x: x[:2])
                            while k < len(lines) and lines[k][:2] == mark:
                                found.append((key, page, *lines[k][2:]))
                                k += 1
                            b += 1
                        at += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])

        near = wanted.select("key", "page_id").repartitionByRange(*wide(wanted), "key", "page_id").sortWithinPartitions("key", "page_id")
        return near.mapInArrow(find, CAPTURES)

    def read(self, captures: DataFrame, with_payload: bool = False) -> DataFrame:
        """Range-read the records of captures: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
        folder = self.archive_folder
        schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_fs(folder)
            name, data = None, None
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            for batch in batches:
                rows = []
                for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if file != name:
                        name, data = file, fs.open_input_file(f"{root}/{file}")
                    headers, size, payload = parse(data.read_at(length, offset))
                    number = lambda x: None if x is None else int(x)
                    row = (number(headers.get("WARC-Page-ID")), headers.get("WARC-Target-URI"), size, headers["WARC-Payload-Digest"][5:], headers["WARC-Type"], number(headers.get("WARC-Refers-To-Page-ID")))
                    rows.append((*row, payload) if with_payload else row)
                if rows:
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(rows[0])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        near = captures.select("file", "offset", "length").repartitionByRange(*wide(captures), "file", "offset").sortWithinPartitions("file", "offset")
        return near.mapInArrow(load, schema)


def _directory_files(files: DataFrame, folder: str) -> DataFrame:
    """Put each index file's block directory beside it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .scratch import write_file

        for batch in batches:
            for file, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = "\n".join(f"{b['first_key']}\t{b['first_page']}\t{b['offset']}\t{b['length']}" for b in blocks)
                write_file(f"{folder}/{file}.dir", zlib.compress(text.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    return files.select("file", "blocks").mapInArrow(write, "file string")


def _read_directory(fs, path: str) -> list[tuple[str, int, int, int]]:
    with fs.open_input_file(path) as f:
        text = zlib.decompress(f.read()).decode()
    return [(k, int(p), int(o), int(n)) for k, p, o, n in (x.split("\t") for x in text.split("\n"))]


def _lines(block: bytes) -> list[tuple[str, int, str, int, int]]:
    return [(k, int(p), f, int(o), int(n)) for k, p, f, o, n in (x.split("\t") for x in zlib.decompress(block).decode().split("\n"))]


def archive(spark: SparkSession, pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> tuple[CaptureIndex, DataFrame]:
    """Write archives and their index; returns the index and the captures."""
    captures = scratch.table(write_archives(pages, scratch.path("archives"), min_bytes), "captures")
    directory = scratch.table(write_index(captures, scratch.path("index")), "directory")
    return CaptureIndex(scratch.path("index"), scratch.path("archives"), directory), captures
