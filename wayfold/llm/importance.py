"""Target-distribution importance resampling by a dictionary of distinct n-grams.

Words are runs of digits, letters a-z (A-Z lowered first) and all characters beyond ASCII; features are all runs of one or two
consecutive words, repeats counted.
  1. Dictionary: each task counts the distinct features of some MB of texts, Spark adds the counts up by string, so that
     a feature of every text is one row a task, not one an occurrence. Each distinct string is hashed once (crc32 modulo
     buckets), and its count goes to its bucket.
  2. The gain of each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s and t counts in all documents
     and all target texts, S and T their sums. There are as many gains as buckets, a fixed number, whatever the data.
  3. Gains back to documents: the distinct features of some MB of texts get their bucket's gain, and each document adds
     gain times count over its own. weight is the floored mean.
  4. score = weight + floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 32 bits of sha256(`seed:doc_id`): Gumbel noise, so that the
     highest scores are a sample without replacement. They are ranked by range partitions and prefix counts.
Words are told apart by 64-bit hashes inside a chunk of texts, features by their strings everywhere else.

Nulls and edges: a null text has no features; no features give weight 0; a null doc_id has the key `seed:` and comes last among
equals; rows of one doc_id have the same noise, and equal ones are ranked in any order; no document with enough words, or an
empty table, draws nothing; empty targets leave t = T = 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import part_offsets, small_batches, text_chunks, written
from wayfold.llm.words import word_bounds, word_hashes

#: Bytes as they count: upper case as lower case, what is in no word as a space.
_AS = np.arange(256, dtype=np.uint8)
_AS[65:91] += 32
_AS[[c for c in range(128) if not chr(c).isalnum()]] = 32
CHUNK = 2 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts (bytes, offsets): the distinct words, sorted; the key of each occurrence (a word's place times
    their number plus one, and for two words the place of the second plus one); its text; and each text's words."""
    data = _AS[data]
    begin, end, first = word_bounds(data, offsets)
    _, place, word = np.unique(word_hashes(data, begin, end, lower=False), return_index=True, return_inverse=True)
    raw, lengths = data.tobytes(), (end - begin)[place]
    words = pa.array([raw[a : a + n] for a, n in zip(begin[place].tolist(), lengths.tolist())], pa.binary())
    order = pc.array_sort_indices(words).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, word = words.take(pa.array(order)), rank[word]
    size = len(words) + 1
    follows = np.ones(len(word), bool)  # whether a word has one before it in its text
    follows[first[:-1][first[:-1] < len(word)]] = False
    second = np.flatnonzero(follows)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key = np.concatenate([word * size, word[second - 1] * size + word[second] + 1])
    return words, key, np.concatenate([text, text[second]]), np.diff(first)


def strings(words: pa.Array, key: np.ndarray) -> pa.Array:
    """The features of keys as UTF-8 strings."""
    first, second = np.divmod(key, len(words) + 1)
    left, right = words.take(pa.array(first)), words.take(pa.array(np.maximum(second - 1, 0)))
    return pc.if_else(pa.array(second == 0), left, pc.binary_join_element_wise(left, right, pa.scalar(b" ")))


def _remainders() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ c >> 1
    return c


_CRC = _remainders()


def crc32s(values: pa.Array) -> np.ndarray:
    """crc32 of each value of a binary array: byte by byte for all values side by side, long ones by the library."""
    _, ends, raw = values.cast(pa.large_binary()).buffers()
    at, raw = np.frombuffer(ends, np.int64)[: len(values) + 1], np.frombuffer(raw or b"", np.uint8)
    length = np.diff(at)
    order = np.argsort(-np.minimum(length, 65), kind="stable")
    begin, left, c = at[:-1][order], length[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    long, alive = np.count_nonzero(left > 64), np.count_nonzero(left > 0)
    for j in range(64):
        alive = np.count_nonzero(left[:alive] > j)
        if alive <= long:
            break
        some = c[long:alive]
        c[long:alive] = _CRC[(some ^ raw[begin[long:alive] + j]) & 255] ^ some >> 8
    out = np.empty(len(order), np.uint32)
    out[order] = ~c
    for k in order[:long]:
        out[k] = crc32(raw[at[k] : at[k + 1]])
    return out


def dictionary(texts: DataFrame) -> DataFrame:
    """feature, n: the distinct features of a column text and how often each occurs in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _gathered(batches):
            for _, _, data, offsets in text_chunks(column.column(0), CHUNK):
                words, key, _, _ = features(data, offsets)
                distinct, n = np.unique(key, return_counts=True)
                for lo in range(0, len(distinct), 20_000):
                    yield pa.RecordBatch.from_arrays([strings(words, distinct[lo : lo + 20_000]).cast(pa.string()), pa.array(n[lo : lo + 20_000])], names=["feature", "n"])

    small_batches(texts.sparkSession)
    some = texts.select(F.col("text").cast("string")).mapInArrow(run, "feature string, n long")
    return some.groupBy("feature").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about a chunk: the larger it is, the fewer of its features occur twice in a task."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: occurrences of the features of each bucket, each distinct string hashed once."""
    bucket = F.crc32(F.col("feature").cast("binary")) % buckets
    return dictionary(texts).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, targets: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket: as many numbers as buckets."""
    counts = bucket_counts(docs, buckets).withColumn("of", F.lit(0)).unionByName(bucket_counts(targets, buckets).withColumn("of", F.lit(1)))
    found = np.zeros((2, buckets), np.int64)
    for r in counts.collect():  # at most two rows a bucket
        found[r.of, r.bucket] = r.n
    (s, t), (all_s, all_t) = found.astype(float), found.sum(1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            ids = table.column(0).combine_chunks()
            for lo, hi, data, offsets in text_chunks(table.column(1), CHUNK):
                words, key, text, n_words = features(data, offsets)
                distinct, feature = np.unique(key, return_inverse=True)
                own = gain[crc32s(strings(words, distinct)) % len(gain)]
                total, n = np.zeros(hi - lo, np.int64), np.bincount(text, minlength=hi - lo)
                np.add.at(total, text, own[feature])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int) -> DataFrame:
    """rows with score, the weight and the noise of its doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (written) with place, 1, 2, 3... by score downwards and doc_id: range partitions, sorted, numbered inside, and
    moved on by the counts of the partitions before. Rows of one score and doc_id may fall to several partitions."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_any")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_any", F.rand(1)).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_any")
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("part", F.shiftright("_id", 33))
    before = part_offsets(dealt.groupBy("part").agg(F.count("*").alias("total")))
    return dealt.join(F.broadcast(before), "part").withColumn("place", F.col("base") + (F.col("_id") - F.shiftleft(F.col("part"), 33)) + 1).drop("_id", "part", "base")


def resampled(docs: DataFrame, targets: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Each row's doc_id, n_features, weight, score, and rank if it is drawn: percent of the N documents with at least
    least_words words, by score."""
    rows = written(scored(weights(docs, gains(docs, targets, buckets)), seed), "scores")
    long = F.coalesce(F.col("n_words"), F.lit(0)) >= least_words
    draw = rows.where(long).count() * percent // 100
    drawn = ranked(rows.where(long)).withColumn("rank", F.when(F.col("place") <= draw, F.col("place"))).drop("place")
    return drawn.unionByName(rows.where(~long).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
