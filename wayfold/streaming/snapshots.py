"""Snapshot ingest as Structured Streaming: dedup by key and time, latest state, freshness, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.merges import last_wins, upsert
from wayfold.sources.work import written


def stream(spark: SparkSession, path: str, schema, files: int | None = 1) -> DataFrame:
    """The Parquet files of a folder or pattern as a stream of so many files a trigger (None: all there are)."""
    rows = spark.readStream.schema(schema)
    return (rows.option("maxFilesPerTrigger", files) if files else rows).parquet(path)


def deduplicated(rows: DataFrame, keys: list[str], at: str, delay: str = "2 hours") -> DataFrame:
    """One row of each key and time; as the time is part of the key, state is dropped behind the watermark."""
    return rows.withWatermark(at, delay).dropDuplicates([*keys, at])


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Running latest row of each key (update or complete mode)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("last"), F.count("*").alias("seen"))


def windowed(rows: DataFrame, key: str, at: str, length: str, slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts of each key by window; late rows beyond the delay are left out."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def merge_batches(rows: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> DataStreamWriter:
    """Sink that merges each micro-batch into a Parquet table by key. A batch that is run again after a failure finds its
    number in the table's folder and changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v={epoch}"
        new = last_wins(batch, keys, order)
        try:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v={epoch - 1}") if epoch else None
        except Exception as e:
            raise RuntimeError(f"the table of batch {epoch - 1} is missing") from e
        (upsert(old, new, keys) if old is not None else new).write.mode("overwrite").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingest_batch(batch: DataFrame, epoch: int, path: str, keys: list[str], at: str, bad: Column, delay: int) -> None:
    """One micro-batch of keyed snapshots, its number `e` from 0. Written below path:
      table/v=e     the latest row of each key, by time, after this batch;
      failed/v=e    keys with a bad row in this batch, with how many: all of the key's rows of the batch are left out, and other keys
                    go on, as if each key were committed alone (a test that is null is bad);
      late/v=e      rows more than `delay` seconds older than the newest row of all earlier batches, kept out of the table;
      mark/v=e      the newest time seen, one row.
    All four are overwritten by number and come from numbers before it, so that a batch that is run again changes nothing."""
    spark, schema = batch.sparkSession, batch.schema
    before = lambda name, kind: spark.read.schema(kind).parquet(f"{path}/{name}/v={epoch - 1}") if epoch else spark.createDataFrame([], kind)
    time = f"newest {schema[at].dataType.simpleString()}"
    mark = before("mark", time).first()
    late = F.lit(False) if mark is None or mark.newest is None else F.col(at) < F.lit(mark.newest) - F.expr(f"INTERVAL {delay} SECONDS")
    marked = written(batch.select("*", F.coalesce(bad, F.lit(True)).alias("_bad"), F.coalesce(late, F.lit(False)).alias("_late")), "batch")
    failed = marked.where("_bad").groupBy(*keys).agg(F.count("*").alias("bad_rows"))
    failed.write.mode("overwrite").parquet(f"{path}/failed/v={epoch}")
    names = failed.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    good = marked.join(names, same, "left_anti")
    good.where("_late").drop("_bad", "_late").write.mode("overwrite").parquet(f"{path}/late/v={epoch}")
    order = [at, *(c for c in schema.names if c not in keys and c != at)]
    rows = before("table", schema).unionByName(good.where("not _late").drop("_bad", "_late"))
    last_wins(rows, keys, order).write.mode("overwrite").parquet(f"{path}/table/v={epoch}")
    newest = marked.select(F.col(at).alias("newest")).unionByName(before("mark", time)).agg(F.max("newest").alias("newest"))
    newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/mark/v={epoch}")


def ingested(rows: DataFrame, path: str, keys: list[str], at: str, bad: Column, delay: int, checkpoint: str) -> DataStreamWriter:
    """Sink that takes a stream through ingest_batch, all that is new at each start."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: ingest_batch(batch, epoch, path, keys, at, bad, delay)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingested_table(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """What `ingested` has written: of table the newest version, of failed and late all batches."""
    if name != "table":
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    files = spark.read.schema(schema).parquet(f"{path}/table")
    last = files.agg(F.max("v")).first()[0]
    return files.where(F.col("v") == last).drop("v") if last is not None else files.drop("v")


#: Keys share so many groups of the limiter by hash: a group costs milliseconds, whatever it holds.
BUCKETS = 1024


def _limiter(seconds: int, most: int):
    """State of a bucket of keys: hits that the watermark has not passed, and of each key the allowed hits of the last window.
    Times are microseconds, keys strings."""
    window = seconds * 1_000_000

    def decide(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, ids, keys, kept_ats, kept_keys = state.get if state.exists else ([], [], [], [], [])
        waiting, kept = list(zip(ats, ids, keys)), {}
        for at, key in zip(kept_ats, kept_keys):
            kept.setdefault(key, []).append(at)
        if not state.hasTimedOut:
            for part in parts:
                waiting += zip(part["at"].tolist(), part["id"].tolist(), part["key"].tolist())
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda x: x[:2])
        due = [x for x in waiting if x[0] // 1000 <= mark]
        rest = waiting[len(due) :]
        out = []
        for at, hit, key in due:
            mine = kept[key] = [x for x in kept.get(key, ()) if x > at - window]
            allowed = len(mine) < most
            wait = 0 if allowed else max(1, (window - (at - mine[0])) // 1_000_000 + 1)
            if allowed:
                mine.append(at)
            out.append((key, hit, at, allowed, wait))
        held = [(x, key) for key, mine in kept.items() for x in mine if (x + window) // 1000 >= mark]  # what a later hit can still meet
        if rest or held:
            wakes = [rest[0][0] // 1000] if rest else []
            wake = min([*wakes, *((x + window) // 1000 + 1 for x, _ in held)])
            state.update(([x[0] for x in rest], [x[1] for x in rest], [x[2] for x in rest], [x[0] for x in held], [x[1] for x in held]))
            state.setTimeoutTimestamp(max(wake - 1, mark, 1))  # it wakes once the watermark is beyond that
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "at", "allowed", "retry_after"])

    return decide


def limited(rows: DataFrame, key: str, hit: str, at: str, seconds: int, most: int, delay: str = "2 hours") -> DataFrame:
    """Sliding-window rate limit of a stream by event time: key, id, at (microseconds), allowed, retry_after (seconds until the oldest
    allowed hit leaves the window; 0 if allowed). Rejected hits do not count. A hit is decided once the watermark has
    passed it, in order of time and then id, whatever order and trigger it came in; hits behind the watermark are dropped.
    An event-time timeout wakes a bucket of keys, and a key whose window has passed holds no state. State comes and goes with the
    rows. Of a bucket a trigger's hits are held by one task."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
    hits = rows.withWatermark(at, delay).select(bucket, F.col(key).cast("string").alias("key"), F.col(hit).cast("long").alias("id"), F.unix_micros(at).alias("at"), F.col(at))
    out, kept = "key string, id bigint, at bigint, allowed boolean, retry_after bigint", "ats array<bigint>, ids array<bigint>, keys array<string>, kept_ats array<bigint>, kept_keys array<string>"
    found = hits.groupBy("bucket").applyInPandasWithState(_limiter(seconds, most), out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("key", F.col("key").cast(kind))
