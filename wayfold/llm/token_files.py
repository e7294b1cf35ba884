"""Token-ID output: ids as Parquet list columns, read back selectively.

`write_tokens` encodes whole texts in the tasks that hold them and writes one row per document: doc_id, part
(the writing task), local_start (ids of that task before it), n_tokens and tokens (list of int). The ids
are dictionary-encoded (a vocabulary of 50,000 fits a dictionary page; version 2 pages fall back to delta
encoding), row groups are bounded by size, and the writer adds column indexes, so that a reader that wants
doc_id or n_tokens alone, or an id range, skips the token pages.
`with_starts` gives each row its global start: per-task totals, a prefix sum over the few tasks, and the
local start. No row passes a single task.

Nulls: a null text is an empty one; a null doc_id sorts first. Repeated rows and ids are kept, each with its
own ids. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.bpe_encode import encoder
from wayfold.llm.common import part_offsets, release, small_batches, work_path

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Row groups of about 16 MB and pages of 256 KB keep a selective read small; the dictionary page may
#: hold the whole vocabulary.
OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "snappy",
}


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, text) -> SCHEMA, in the rows' order, with end_id appended to each document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                ids = [encode(t) + end for t in rows.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offsets[:-1] + np.int64(at)), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                at += int(n.sum())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, ordered: bool = True, partitions: int | None = None) -> str:
    """Write the token files and give their folder. ordered: rows run in ascending doc_id over the parts
    (range partitions sorted by doc_id, equal ids by text); else they stay where they are, with no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or work_path(spark, "tokens")
    rows = docs.select("doc_id", "text")
    if ordered:
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encoded(rows, tokenizer, end_id).write.options(**OPTIONS).parquet(path)
    return path


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add start, the ids of all rows before a row in (part, local_start) order. Reads two narrow columns
    for the totals."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return tokens.join(F.broadcast(part_offsets(totals)), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows of token files with their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write token files for docs and return what they hold: doc_id, start, n_tokens, ids_crc32."""
    path = write_tokens(docs, tokenizer, end_id, path)
    return checksums(with_starts(read_tokens(docs.sparkSession, path)))
