"""Shared helpers: input tables, scratch tables in the shared checkpoint folder, Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; a longer text is handled alone.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to Python workers small, for the whole session since plans run later: by rows here, and by bytes through Spark's spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and the executors share. Where none is set, a temporary one in local mode, as in tests, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return root
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corrie-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/corrie-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """df, written and read back; with file_rows, in files of no more rows, which readers share out."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
        gc.collect()
        self.spark._jvm.System.gc()  # Spark deletes a finished step's shuffle files once its plan is collected
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but `used` under names that clash with none of an operator's; and what names them back.

    The second takes the result and names of new columns to keep.
    """
    inner = {c: c if c in used else f"__{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, *new: str) -> DataFrame:
        return df.select(*(F.col(f"`{i}`").alias(c) for c, i in inner.items() if c not in new), *new)

    return docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items())), back


def row_key() -> F.Column:
    """A key for a document that also tells apart rows that share a doc_id; equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[cuts[i] : cuts[i + 1]]; no bytes are copied row by row."""
    cuts = np.asarray(cuts, np.int64)
    values = np.ascontiguousarray(values[cuts[0] : cuts[-1]] if len(cuts) else values[:0])
    ends = (cuts - cuts[0]) * values.itemsize if len(cuts) else np.zeros(1, np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("a packed column must stay under 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def unpacked(col: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a packed column, read-only and without a copy, and where each row's begin and the last ends."""
    data, offs = text_buffers(col)
    return data.view(kind), offs // np.dtype(kind).itemsize


def one_row(values: np.ndarray) -> pa.Array:
    """A binary column of one row that holds all values."""
    return packed(values, np.array([0, len(values)]))


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks and would keep it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most `most` bytes of text, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    give_back()
