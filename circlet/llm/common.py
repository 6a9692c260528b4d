"""What the corpus operators share: staged tables, size-checked broadcasts and views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the complement of the words counted and shingled by the operators.
WORD = r"[^\x20\x09-\x0D]+"
#: A table goes to every executor only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where it is unset, a temporary one serves a local master; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-staged-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, read_in: SparkSession | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs one stage at most.

    The shuffle files behind df are dropped once the table is written, unless the session says otherwise. read_in: the
    session that reads, by default that of df.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    if spark.conf.get(CLEANUP, None) is None:
        spark.conf.set(CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    return (read_in or spark).read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, hinted for broadcast only if its counted rows are within the bound; a plain join serves beyond."""
    df = staged(df)
    return F.broadcast(df) if df.count() <= rows else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without copying; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 19):
    """Ranges of whole rows of about `limit` bytes (one row, if it alone is longer)."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
