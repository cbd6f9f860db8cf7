"""The folder that driver and executors share: for checkpoints and for tables that a query writes.

It is the one that ``spark.checkpoint.dir`` names; only where that is unset
(tests, a laptop) a folder of our own is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder as a URI; also set as the session's checkpoint folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="keymere-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return (folder if folder.startswith("file:") or "://" in folder else f"file://{folder}").rstrip("/")


def own_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/keymere/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise rows with their partitions and their order; Spark removes the files when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
