"""Shared scratch space for tables and files that must outlive executors.

Everything goes below the folder that the session names in
``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) a folder
of our own is chosen, since driver and executors then share one machine.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as a URI without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="keymere-")
        spark.sparkContext.setCheckpointDir(root)
    return (root if "://" in root or root.startswith("file:") else f"file://{root}").rstrip("/")


#: Bytes that a task should read at most after rows are dealt out.
TASK_BYTES = 128 << 20


def wide(df: DataFrame) -> tuple[int, ...]:
    """The number of partitions to deal ``df`` out to, where the session's is too few for the tables it reads; else nothing, which lets Spark join small ones."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Spark takes a size that it doesn't know for as large as can be
    wanted = sum(x for x in sizes if x < 1 << 60) // TASK_BYTES
    return (wanted,) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once, where they would not find it by their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in map(os.path.abspath, filter(None, known)):
        return
    folder = tempfile.mkdtemp(prefix="keymere-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/keymere", "zip", root, "keymere"))
    _shipped.add(app)


class Scratch:
    """A private folder in the shared space, removed by :meth:`drop`."""

    _live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/keymere/{tag}-{uuid.uuid4().hex[:12]}"
        Scratch._live.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, survives lost executors."""
        at = self.path(name)
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self, *names: str) -> None:
        """Delete tables that are done with, and let Spark delete the shuffles that made them: it does so when
        the driver's garbage is collected, which may otherwise be long after executors' disks are full."""
        for name in names:
            _delete(self.spark, self.path(name))
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        _delete(self.spark, self.root)
        if self in Scratch._live:
            Scratch._live.remove(self)

    @classmethod
    def drop_all(cls) -> None:
        """Remove all scratch folders of this process. Results not yet written are lost."""
        for s in list(cls._live):
            s.drop()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """``(filesystem, path)`` of a URI of the shared space, usable on any node."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data) -> None:
    """Write a whole file so that a second attempt, or a second copy of the task, does no harm."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temp, compression=None) as out:
        for part in data if isinstance(data, (list, tuple)) else [data]:
            out.write(part)
    filesystem.move(temp, path)
