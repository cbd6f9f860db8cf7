"""Blob files: a file is an ordered list of numbered blobs."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running
from ..operators.relations import overlapping

#: Schemes of the stores and how Spark addresses them; the others have no Hadoop file system.
SCHEMES = {"local": "file", "nio": "file", "s3": "s3a", "azure": "abfss", "oci": "oci", "gcs": "gs", "hdfs": "hdfs"}
#: Stores that overwrite a file instead of appending a blob to it.
OVERWRITE = {"nio"}


#: Readers of stores without a file system: store -> function of (spark, path) that gives path, number and data of blobs.
READERS: dict[str, Callable] = {}


def register_reader(store: str, read: Callable) -> None:
    """Let :func:`read_store` load blobs of a store that Spark has no file system for (a key-value or document store, a topic)."""
    if store in SCHEMES or store in READERS:
        raise ValueError(f"store {store} is known")
    READERS[store] = read


def read_store(spark, store: str, path: str) -> DataFrame:
    """Blobs below a path of any known store: path, n, data."""
    if store in READERS:
        return READERS[store](spark, path).select("path", "n", "data")
    files = read_files(spark, uri(store, path)).select("path", F.col("content").alias("data"))
    number = F.regexp_extract("path", r"\.(\d+)$", 1)
    return files.select(F.regexp_replace("path", r"\.\d+$", "").alias("path"), F.when(number != "", number.cast("long")).otherwise(0).alias("n"), "data")


def uri(store: str, path: str) -> str:
    if store not in SCHEMES:
        raise ValueError(f"store {store} has no file system that Spark reads; register a reader of its blobs")
    return f"{SCHEMES[store]}://{'/' if SCHEMES[store] == 'file' and not path.startswith('/') else ''}{path}"


def read_files(spark, path: str) -> DataFrame:
    """Files below a path: path, modification time, length, content (read only if used)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def with_offsets(blobs: DataFrame, file: str, number: str, size: Column, name: str = "start_off", large: bool = False) -> DataFrame:
    """Add the byte at which each blob begins in its file.

    A window of each file, in one task; for files of very many blobs
    (``large``) a running sum over all, dealt by (file, number), from which the
    sum at the file's beginning is taken off.
    """
    if not large:
        before = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
        return blobs.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    placed = running(blobs, [F.col(file), F.col(number)], {"_all": size})
    firsts = placed.groupBy(F.col(file).alias("_file")).agg(F.min("_all").alias("_first"))
    out = placed.join(firsts, F.col(file).eqNullSafe(F.col("_file")))
    return out.withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first", "_file")


def file_sizes(blobs: DataFrame, file: str, size: Column) -> DataFrame:
    return blobs.groupBy(file).agg(F.sum(size).alias("size"))


def next_numbers(blobs: DataFrame, file: str, number: str, name: str = "next_no") -> DataFrame:
    return blobs.groupBy(file).agg((F.max(number) + 1).alias(name))


def range_blobs(blobs: DataFrame, file: str, number: str, size: Column, offset: int, length: int) -> DataFrame:
    """Blobs that hold a part of [offset, offset + length); a negative length means to the end."""
    placed = with_offsets(blobs.withColumn("_size", size), file, number, F.col("_size"), "_start").where("_size > 0")
    end = F.col("_start") + F.col("_size") - 1
    last = F.lit(offset + length - 1) if length >= 0 else end
    return overlapping(placed, F.col("_start"), end, F.lit(offset), last)


def range_parts(blobs: DataFrame, file: str, number: str, data: str, offset: int, length: int) -> DataFrame:
    """The parts of a range of each file: its blobs, cut to the range, in rows of their own."""
    hit = range_blobs(blobs, file, number, F.octet_length(data).cast("long"), offset, length)
    first = F.greatest(F.lit(offset) - F.col("_start"), F.lit(0))
    n = F.least(F.lit(offset + length) - F.col("_start"), F.col("_size")) - first if length >= 0 else F.col("_size") - first
    return hit.withColumn(data, F.substring(F.col(data), (first + 1).cast("int"), n.cast("int"))).drop("_start", "_size")


def read_range(blobs: DataFrame, file: str, number: str, data: str, offset: int, length: int) -> DataFrame:
    """The bytes of a range of each file, put together in order: for ranges that fit a row."""
    parts = range_parts(blobs, file, number, data, offset, length)
    pieces = parts.select(file, F.struct(F.col(number).alias("n"), F.hex(data).alias("h")).alias("p"))
    return pieces.groupBy(file).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["h"]), "")).alias(data))


def chunk(rows: DataFrame, data: str, most: int) -> DataFrame:
    """Split each row's bytes into chunks of ``most`` bytes: adds blob_no and replaces the bytes. Nothing gives no chunk."""
    count = F.ceil(F.octet_length(data) / most).cast("int")
    numbered = rows.where(F.octet_length(data) > 0).withColumn("blob_no", F.explode(F.sequence(F.lit(0), count - 1)))
    return numbered.withColumn(data, F.substring(F.col(data), F.col("blob_no") * most + 1, F.lit(most))).withColumn("blob_no", F.col("blob_no").cast("long"))


def truncate(blobs: DataFrame, file: str, number: str, data: str, length: int) -> DataFrame:
    """Files cut to ``length`` bytes."""
    placed = with_offsets(blobs, file, number, F.octet_length(data), "_start").where(F.col("_start") < length)
    left = (F.lit(length) - F.col("_start")).cast("int")
    return placed.withColumn(data, F.substring(F.col(data), F.lit(1), left)).drop("_start")


def copy_file(blobs: DataFrame, file: str, source: str, target: str) -> DataFrame:
    return blobs.unionByName(blobs.where(F.col(file) == source).withColumn(file, F.lit(target)))


def copy_range(blobs: DataFrame, file: str, number: str, data: str, source: str, offset: int, length: int, target: str) -> DataFrame:
    """Append a range of a file to another one, as new blobs."""
    own = blobs.where(F.col(file) == target).agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("n"))
    parts = range_parts(blobs.where(F.col(file) == source), file, number, data, offset, length)
    least = parts.agg(F.min(number).alias("n"))
    moved = parts.withColumns({file: F.lit(target), number: (F.col(number) - least.scalar() + own.scalar()).cast(blobs.schema[number].dataType)})
    return blobs.unionByName(moved.select(*blobs.columns))


def append_blob(blobs: DataFrame, file: str, number: str, data: str, name: str, content: bytes, store: str = "local") -> DataFrame:
    """Write bytes to a file: a further blob, or the only one in stores that overwrite. Nothing is written for no bytes."""
    if not content:
        return blobs
    kept = blobs.where(F.col(file) != name) if store in OVERWRITE else blobs
    top = F.lit(0) if store in OVERWRITE else blobs.where(F.col(file) == name).agg(F.coalesce(F.max(number) + 1, F.lit(0)).alias("n")).scalar()
    row = blobs.sparkSession.createDataFrame([(name, bytearray(content))], f"`{file}` string, `{data}` binary").withColumn(number, top.cast(blobs.schema[number].dataType))
    return kept.unionByName(row, allowMissingColumns=True)


def move_file(blobs: DataFrame, file: str, source: str, target: str) -> DataFrame:
    return blobs.withColumn(file, F.when(F.col(file) == source, F.lit(target)).otherwise(F.col(file)))


def delete_file(blobs: DataFrame, file: str, name: str) -> DataFrame:
    return blobs.where(F.col(file) != name)


#: Settings of the stores and the Hadoop options that they become; {} stands for the account or bucket.
HADOOP_OPTIONS: dict[str, dict[str, str]] = {
    "s3": {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "endpoint": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region", "path_style": "fs.s3a.path.style.access", "timeout_ms": "fs.s3a.connection.timeout"},
    "azure": {"account_key": "fs.azure.account.key.{}.dfs.core.windows.net", "sas_token": "fs.azure.sas.fixed.token.{}.dfs.core.windows.net"},
    "oci": {"hostname": "fs.oci.client.hostname", "tenant": "fs.oci.client.auth.tenantId", "user": "fs.oci.client.auth.userId", "fingerprint": "fs.oci.client.auth.fingerprint", "key_file": "fs.oci.client.auth.pemfilepath"},
    "gcs": {"key_file": "google.cloud.auth.service.account.json.keyfile", "project": "fs.gs.project.id"},
}


def hadoop_options(store: str, account: str = "", **settings: object) -> dict[str, str]:
    """Hadoop options of a store's settings; unknown settings are an error."""
    known = HADOOP_OPTIONS.get(store, {})
    if unknown := set(settings) - set(known):
        raise ValueError(f"unknown settings of {store}: {', '.join(sorted(unknown))}")
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return {known[k].format(account): text(v) for k, v in settings.items() if v is not None}


def exists(files: DataFrame, path_col: str, path: str) -> DataFrame:
    """Whether a file or a folder of that path is there, as one row: is_file, is_folder, is_empty."""
    name = path.rstrip("/")
    own = files.select(F.col(path_col).alias("p")).where((F.col("p") == name) | F.col("p").startswith(name + "/"))
    is_file, below = F.coalesce(F.bool_or(F.col("p") == name), F.lit(False)), F.coalesce(F.bool_or(F.col("p") != name), F.lit(False))
    return own.agg(is_file.alias("is_file"), below.alias("is_folder"), (~below).alias("is_empty"))


class BlobFiles:
    """The files of a table of blobs. What changes them gives a new object; nothing is written until a result is."""

    def __init__(self, blobs: DataFrame, file: str = "path", number: str = "n", data: str = "data", store: str = "local"):
        self.blobs, self.file, self.number, self.data, self.store = blobs, file, number, data, store

    def _of(self, blobs: DataFrame) -> BlobFiles:
        return BlobFiles(blobs, self.file, self.number, self.data, self.store)

    def sizes(self) -> DataFrame:
        return file_sizes(self.blobs, self.file, F.octet_length(self.data).cast("long"))

    @contextmanager
    def remembered(self):
        """Sizes and existence kept in memory while the block runs, as one small row a file."""
        sizes = self.sizes().persist()
        try:
            yield sizes
        finally:
            sizes.unpersist()

    def exists(self, name: str) -> bool:
        return not self.blobs.where(F.col(self.file) == name).isEmpty()

    def is_empty(self, folder: str) -> bool:
        return self.blobs.where(F.col(self.file).startswith(folder.rstrip("/") + "/")).isEmpty()

    def read(self, name: str, offset: int = 0, length: int = -1) -> DataFrame:
        return read_range(self.blobs.where(F.col(self.file) == name), self.file, self.number, self.data, offset, length)

    def write(self, name: str, content: bytes) -> BlobFiles:
        return self._of(append_blob(self.blobs, self.file, self.number, self.data, name, content, self.store))

    def copy(self, source: str, target: str, offset: int = 0, length: int = -1) -> BlobFiles:
        whole = offset == 0 and length < 0
        return self._of(copy_file(self.blobs, self.file, source, target) if whole else copy_range(self.blobs, self.file, self.number, self.data, source, offset, length, target))

    def move(self, source: str, target: str) -> BlobFiles:
        return self._of(move_file(self.blobs, self.file, source, target))

    def truncate(self, name: str, length: int) -> BlobFiles:
        others = delete_file(self.blobs, self.file, name)
        return self._of(others.unionByName(truncate(self.blobs.where(F.col(self.file) == name), self.file, self.number, self.data, length)))

    def delete(self, name: str) -> BlobFiles:
        return self._of(delete_file(self.blobs, self.file, name))
