"""Shared helpers: the shared work folder, written tables, Arrow text buffers, global offsets."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import words

#: A side of a join is broadcast only if it has been counted and has at most so many narrow rows.
BROADCAST_ROWS = 1_000_000


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only where a local session has none (tests) a temporary
    folder is set as the checkpoint folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/wayfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet into the work folder and read it back: lineage ends at shared files, so a lost
    executor costs no more than the tasks it was running."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables that `written` made, once nothing reads them any more."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Arrow batches for Python tasks hold whole texts: 10,000 rows could be gigabytes, on both sides of the socket.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, where the user has not set them."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already written table for broadcast if its counted rows stay below the bound; else
    leave the join to shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """An object that a worker process makes once and keeps until it needs another one: tokenizers and their memos."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Give back what earlier stages left in a reused worker process: tokenizers and memos, powers as long as the longest text, and
    freed pages that the C library keeps (where it is glibc)."""
    _held.clear()
    words.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def text_chunks(column: pa.Array, limit: int = 1 << 21):
    """Cut a column into runs of rows of about limit bytes: (first row, end row, bytes, offsets from 0)."""
    raw, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def part_offsets(totals: DataFrame) -> DataFrame:
    """(part, total) -> (part, base): exclusive prefix sums in order of part. One row per partition of the
    numbered table, so the single-task window over it is bounded by the number of partitions."""
    from pyspark.sql import Window

    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("base"))
