"""Packing by concatenate and cut.

All documents' ids, each ended by end_id, form one stream; sequence k holds the ids [k * length,
(k + 1) * length). The first pass encodes and writes token files where the rows lie (no shuffle) with
per-task running sums; the second adds each task's prefix sum and cuts documents at the fixed windows. A
document that crosses a border gives one record on each side. Only the last sequence is not full.

Nulls: a null text packs as its end id alone; a null doc_id is kept. Repeated rows are packed each on its
own. An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.common import release
from wayfold.llm.token_files import read_tokens, with_starts, write_tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Rows of token files with global starts -> PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            g, n, lists = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            first, last = g // length, (g + n - 1) // length
            count = np.where(n > 0, last - first + 1, 0)
            row = np.repeat(np.arange(len(g)), count)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(seq * length, g[row]), np.minimum((seq + 1) * length, (g + n)[row])
            at = offsets[row] - g[row]
            crc = [zlib.crc32(values[a:b]) for a, b in zip((lo + at).tolist(), (hi + at).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(lo - g[row]), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of length ids; one row per piece."""
    path = write_tokens(docs, tokenizer, end_id, ordered=False)
    return cut(with_starts(read_tokens(docs.sparkSession, path)), length)
