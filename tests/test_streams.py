"""Stream queries on events of many files, whose users cross triggers and whose times span more than a year."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.compare import connect, differences
from wayfold.plans import all_oracles, all_queries
from wayfold.streaming import snapshots as st


@pytest.fixture(scope="module")
def long_events(spark, tmp_path_factory):
    """Five files, the newest events first, over 400 days, and a burst of one user."""
    rng = np.random.default_rng(5)
    top = tmp_path_factory.mktemp("events")
    days = np.sort(rng.uniform(0, 400, 1000))[::-1]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=int(86400 * d)), int(rng.integers(0, 12)), ("view", "click")[i % 2], float(i)) for i, d in enumerate(days)]
    # a burst of one user, of more rows than an Arrow batch, in no order
    burst = [(1000 + i, datetime(2024, 3, 1) + timedelta(seconds=int(s)), 99, "view", 0.0) for i, s in enumerate(rng.permutation(2500) * 400)]
    for n in range(5):
        part = rows[200 * n : 200 * n + 200] + burst[500 * n : 500 * n + 500]
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{top}/events.parquet")
    return str(top), rows + burst


@pytest.mark.parametrize("name", ["stm01_stream_windows", "stm01_ingest", "stm02_stream_dedup", "stm03_stream_latest", "stm05_stream_rate_limit"])
def test_whole_span_and_users_across_triggers(spark, sf_dir, long_events, name):
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{long_events[0]}/events.parquet/*.parquet')")
    assert differences(all_queries()[name](spark, long_events[0]), con, all_oracles()[name]) == ""


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


HIT = "id long, who string, ts timestamp"


def run_in_parts(spark, folder, parts, start, schema=HIT):
    """Each part lands and is taken by a run of the stream of its own."""
    progress = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run = start(spark.readStream.schema(schema).parquet(f"{folder}/in")).start()
        run.awaitTermination()
        progress.append(run.lastProgress)
    return progress


def sequential(hits, seconds, most):
    """The plain limiter, hit after hit."""
    kept, out = {}, {}
    for i, who, ts in sorted(hits, key=lambda r: (r[2], r[0])):
        mine = kept.setdefault(who, [])
        mine[:] = [t for t in mine if t > ts - timedelta(seconds=seconds)]
        if len(mine) < most:
            mine.append(ts)
            out[i] = (True, 0)
        else:
            out[i] = (False, max(1, int(seconds - (ts - mine[0]).total_seconds()) + 1))
    return out


def test_limiter_over_triggers_in_any_order_and_its_state_expires(spark, tmp_path):
    rng = np.random.default_rng(3)
    hits = [(i, f"u{rng.integers(4)}", at(float(m))) for i, m in enumerate(np.sort(rng.uniform(0, 240, 300)).round(4))]
    parts = [hits[:120], hits[120:200], hits[200:]]
    # neighbours of two triggers change places: late by less than the watermark's delay
    parts[0][-1], parts[1][0] = parts[1][0], parts[0][-1]
    parts.append([(1000, "last", at(600.0))])  # moves the watermark past all windows
    out = str(tmp_path / "out")
    start = lambda r: st.limited(r, "who", "id", "ts", 600, 3, "30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    progress = run_in_parts(spark, tmp_path, [[*map(tuple, p)] for p in parts], start)
    found = {r.id: (r.allowed, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert found == sequential(hits, 600, 3)
    assert any(not a for a, _ in found.values())
    # of five keys only the one whose hit the watermark has not passed has state: it waits
    assert progress[-1].stateOperators[0].numRowsTotal <= 2


def test_dedup_state_is_bounded_by_the_watermark(spark, tmp_path):
    parts = [[(k * 500 + i, f"u{i % 7}", at(k * 600 + i)) for i in range(500) for _ in range(2)] for k in range(4)]
    out = str(tmp_path / "out")
    start = lambda r: st.deduplicated(r, ["who"], "ts", "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    progress = run_in_parts(spark, tmp_path, parts, start)
    assert spark.read.parquet(out).count() == 2000
    assert progress[-1].stateOperators[0].numRowsTotal <= 121  # of 2,000 rows those of the last two hours


def test_ingest_keeps_failures_and_late_rows_apart_and_replays(spark, tmp_path):
    parts = [
        [(1, "a", at(0)), (2, "b", at(5)), (-1, "bad", at(6)), (3, "bad", at(7))],
        [(4, "a", at(200)), (5, "bad", at(201)), (6, "b", at(300)), (7, None, at(301))],
        [(8, "a", at(150)), (9, "b", at(250)), (-2, "b", at(310)), (10, "c", at(290))],
    ]
    out = str(tmp_path / "out")
    run_in_parts(spark, tmp_path, parts, lambda rows: st.ingested(rows, out, ["who"], "ts", F.col("id") < 0, 7200, f"{tmp_path}/c"))
    table = lambda: sorted((str(r.who), r.id) for r in st.ingested_table(spark, out, "table", HIT).collect())
    # the bad key fails alone in batch 0 and commits in batch 1; b fails in batch 2 and keeps what batch 1 committed
    assert table() == [("None", 7), ("a", 4), ("b", 6), ("bad", 5), ("c", 10)]
    assert sorted((r.who, r.bad_rows) for r in st.ingested_table(spark, out, "failed", "who string, bad_rows long").collect()) == [("b", 1), ("bad", 1)]
    # 150 is more than two hours behind 301, the newest time of the batches before
    assert [(r.who, r.id) for r in st.ingested_table(spark, out, "late", HIT).collect()] == [("a", 8)]
    before = table()
    st.ingest_batch(spark.createDataFrame(parts[2], HIT), 2, out, ["who"], "ts", F.col("id") < 0, 7200)  # a batch that is run again
    assert table() == before and len(st.ingested_table(spark, out, "late", HIT).collect()) == 1
