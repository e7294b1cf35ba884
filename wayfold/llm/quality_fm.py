"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the number of
features by the sum-of-squares identity. Features of a text, all from the whole of it:
  * its distinct lower-cased words, hashed into 2**15 buckets, with the square root of their counts, scaled
    to length 1;
  * statistics of its bytes and words (upper case, digits, symbols, non-ASCII, full stops, line breaks, mean
    word length, share of distinct words, share of the commonest word) and, as metadata, its length, each
    as one of 16 bins.
Fitting reads at most `sample` labelled rows (the smallest by a hash of doc_id, a documented bound), only rows
with crc32(doc_id as text) mod 5 <> 0, and runs on the driver in seconds. Scoring is narrow and covers every row.

Nulls and edges: a null text scores as an empty one (bins only); null labels or doc_ids are not learnt from;
repeated labels count once per distinct (doc_id, label); no usable label gives score 0.5; doc_id, lang,
source and labels are no features; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import release, small_batches, text_chunks
from wayfold.llm.words import word_bounds, word_hashes

WORDS, BINS, FACTORS = 1 << 15, 16, 8
#: Byte classes counted: upper case, digits, symbols, beyond ASCII, full stops, line breaks, bars.
_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
_CLASSES[3, 128:] = True
_CLASSES[4, ord(".")] = True
_CLASSES[5, 10] = True
_CLASSES[6, ord("|")] = True
STATS = 11
SIZE = STATS * BINS + WORDS


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document of a buffer: row offsets, indices, values."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first).astype(float)
    stats = np.zeros((STATS, n))
    for i, c in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(c[data])])
        share = np.diff(total[offsets]) / np.maximum(size, 1)
        stats[i] = np.minimum(np.sqrt(share) * (BINS - 1), BINS - 1)
    stats[7] = np.minimum(np.log2(size + 1), BINS - 1)
    stats[8] = np.minimum(size / np.maximum(words, 1), BINS - 1)
    bucket = (word_hashes(data, starts, ends, lower=True) >> np.uint64(49)).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(n), np.diff(first)) * WORDS + bucket, return_counts=True)
    row, value = key // WORDS, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=count, minlength=n))
    distinct = np.bincount(row, minlength=n)
    stats[9] = distinct / np.maximum(words, 1) * (BINS - 1)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    stats[10] = np.sqrt(top / np.maximum(words, 1)) * (BINS - 1)
    fixed = np.arange(STATS)[:, None] * BINS + stats.astype(np.int64)
    rows = np.concatenate([np.repeat(np.arange(n), STATS), row])
    index = np.concatenate([fixed.T.ravel(), STATS * BINS + key % WORDS])
    values = np.concatenate([np.full(n * STATS, 0.5), value / norm[row]])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64), index[order].astype(np.int32), values[order].astype(np.float32)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, offsets: np.ndarray, index: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the rows and, for the gradient, their factor sums. No row is without features."""
        vx = self.v[index] * x[:, None]
        sums = np.add.reduceat(vx, offsets[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), offsets[:-1])
        linear = np.add.reduceat(self.w[index] * x, offsets[:-1])
        return self.w0 + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adaptive-gradient fit of the logistic loss, in a fixed order."""
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    if not len(rows):
        return m
    mean = np.clip(labels.mean(), 0.01, 0.99)
    m.w0 = float(np.log(mean / (1 - mean)))
    gw, gv, g0 = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            n = [len(rows[i][0]) for i in part]
            offsets = np.concatenate([[0], np.cumsum(n)])
            index, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            z, sums = m.logits(offsets, index, x)
            error = (_sigmoid(z) - labels[part]) / len(part)
            e = np.repeat(error, n) * x
            used = np.unique(index)
            at = np.searchsorted(used, index)
            d = np.bincount(at, weights=e, minlength=len(used)) + decay * m.w[used]
            gw[used] += d * d
            m.w[used] -= rate * d / np.sqrt(gw[used])
            each = e[:, None] * (np.repeat(sums, n, axis=0) - m.v[index] * x[:, None])
            for f in range(FACTORS):
                d = np.bincount(at, weights=each[:, f], minlength=len(used)) + decay * m.v[used, f]
                gv[used, f] += d * d
                m.v[used, f] -= rate * d / np.sqrt(gv[used, f])
            d0 = float(error.sum())
            g0 += d0 * d0
            m.w0 -= rate * d0 / g0**0.5
    return m


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """label, feature, value of at most sample labelled rows outside the held-out fold."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().where(~held_out("doc_id")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi, data, at in text_chunks(batch.column(2), 1 << 20):
                offsets, index, value = text_features(data, at)
                cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), cut(index), cut(value)], names=["doc_id", "label", "feature", "value"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, feature binary, value binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Machine:
    small_batches(docs.sparkSession)
    found = sorted(labelled(docs, labels, sample).collect(), key=lambda r: (r.doc_id, r.label, bytes(r.feature)))
    rows = [(np.frombuffer(r.feature, np.int32), np.frombuffer(r.value, np.float32)) for r in found]
    return fit(rows, np.array([r.label for r in found], float))


def scores(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with the score of every row's text added as column name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at), 1 << 20):
                z, _ = shared.value.logits(*text_features(data, offsets))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(_sigmoid(z.astype(float)))], names=[*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    rows = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    return rows.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
