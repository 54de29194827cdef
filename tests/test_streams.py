"""Keyed streaming state, the breaker as a stream, and progress while a stream runs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lotwise.operators import ordered, state
from lotwise.streaming import events, keyed

EVENTS = "seq long, kind string, url string, run_id string, haendler_id string, payload string, error string, stage string, status_code int, error_type string, ts string"


def some_events(n, seed=3):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        kind = rng.choice(["vehicle_processing", "vehicle_done", "vehicle_failed", "vendor_done", "vendor_failed", "error", "other"])
        url = "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 9)}"
        payload = rng.choice([None, f"p{seq}"])
        rows.append((seq, kind, rng.choice([url, url, None]) if kind == "other" else url, rng.choice(["", "r1", "r2", None]), rng.choice(["H", None]), payload, f"e{seq}", rng.choice([None, "page"]), None, "", str(seq)))
    return rows


def first_tables(spark):
    jobs = [(f"u{k}", "r1" if k % 2 else "r2", "v", "C", "", "", "queued", k, None, "t0", k) for k in range(6)] + [("hot", "r1", "v", "C", "", "", "queued", 0, "old", "t0", 9)]
    vendors = [(f"u{k}", "r1", "C", "", "old" if k else None, "queued", None, "t0") for k in range(4)]
    vehicles = [(f"u{k}", "r0", "H", "old", "done", "t0") for k in range(0, 12, 3)]
    frame = spark.createDataFrame
    return {"vehicle_jobs": frame(jobs, state.JOB_STATE), "vendors": frame(vendors, state.VENDOR_STATE), "vehicles": frame(vehicles, state.VEHICLE_STATE)}


def contents(tables):
    return {name: sorted((tuple(r) for r in df.collect()), key=str) for name, df in tables.items()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_state_over_several_batches_equals_the_batch_job(spark, tmp_path, shuffled):
    rows = some_events(160)
    first = first_tables(spark)
    whole = events.apply_batch(first["vendors"], first["vehicle_jobs"], first["vehicles"], spark.createDataFrame([], state.ERROR_STATE), spark.createDataFrame(rows, EVENTS), "r2", "now")
    expected = contents({n: whole[n].select(*df.columns) if n != "errors" else whole[n] for n, df in events.load_state(spark, str(tmp_path / "none")).items()})
    if shuffled:  # batches bring the events in any order
        random.Random(1).shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = events.read_events(spark, str(tmp_path / "in"), per_trigger=1)
    streams = events.write_state(source, str(tmp_path / "state"), str(tmp_path / "cp"), "r2", "now", first)
    streams.awaitTermination()
    assert len(streams.queries[0].recentProgress) > 2
    assert contents(events.load_state(spark, str(tmp_path / "state"))) == expected
    # A batch appends what it touched, and the first tables are left as they were.
    log = spark.read.parquet(str(tmp_path / "state/changes"))
    assert log.groupBy("entity", "url", "version").count().filter("count > 1").isEmpty()
    # Another start finds nothing to do.
    events.write_state(source, str(tmp_path / "state"), str(tmp_path / "cp"), "r2", "now", first).awaitTermination()
    assert contents(events.load_state(spark, str(tmp_path / "state"))) == expected


def test_events_are_folded_where_they_are_read(spark):
    rows = spark.createDataFrame(some_events(400), EVENTS).repartition(2)
    folded = keyed.folded(rows).collect()
    assert max(sum(1 for r in folded if (r.entity, r.url, r.run_id) == k) for k in {(r.entity, r.url, r.run_id) for r in folded}) <= 2
    hot = [r for r in folded if (r.entity, r.url) == ("vehicle", "hot")]
    assert sum(r.starts for r in hot) == rows.filter("kind = 'vehicle_processing' AND url = 'hot'").count()


LIMITS = [
    {"streak_limit": 3},
    {"streak_limit": 2, "cooldown": True, "total_limit": 30},
    {"total_limit": 6, "rate_limit": 0.9},
    {"streak_limit": 3, "cooldown": True, "rate_limit": 0.55},
]


@pytest.mark.parametrize("limits", LIMITS)
def test_breaker_of_a_split_log(spark, tmp_path, limits):
    rng = random.Random(7)
    rows = [(k, rng.choice(["a", "b"]), rng.choice([True, True, False, None])) for k in range(120)]
    log = spark.createDataFrame(rows, "seq long, method string, blocked boolean")
    for k in range(3):
        log.filter(F.col("seq").between(40 * k, 40 * k + 39)).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        events.write_breaker(source, str(tmp_path / "out"), str(tmp_path / "cp"), "method", "seq", "blocked", **limits).awaitTermination()
    names = ["method", "seq", "attempts", "blocked_total", "blocked_streak", "breaker", "trip_reason"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect())
    expected = sorted(tuple(r) for r in ordered.block_breaker(log, "method", "seq", "blocked", **limits).select(*names).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in expected]


def test_a_cooldown_ends_by_its_timer(spark, tmp_path):
    keyed.use_rocksdb(spark)
    rows = [(k, "m", True) for k in range(4)]
    spark.createDataFrame(rows, "seq long, method string, blocked boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, method string, blocked boolean").parquet(str(tmp_path / "in"))
    found = keyed.breaker(source, "method", "seq", "blocked", streak_limit=3, cooldown=True, cooldown_seconds=0.5)
    running = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        states, end = [], time.monotonic() + 60
        while "resumed" not in states and time.monotonic() < end:
            time.sleep(0.5)
            if (tmp_path / "out/_spark_metadata").exists():
                states = [r["breaker"] for r in spark.read.schema(keyed.BREAKER_ROW).parquet(str(tmp_path / "out")).collect()]
    finally:
        running.stop()
    assert sorted(states) == ["closed", "closed", "closed", "cooldown", "resumed"]


def test_progress_of_every_batch_equals_the_marks(spark, tmp_path):
    rows = [(k, "x", f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}") for k in range(1, 121)]
    done = spark.createDataFrame(rows, "seq long, run string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("started", F.lit("2024-01-01").cast("timestamp"))
    marks = events.Progress(1704067200.0, expected=200)
    spark.streams.addListener(marks)
    try:
        for part in range(4):
            done.filter(F.col("seq").between(30 * part + 1, 30 * part + 30)).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(done.schema).parquet(str(tmp_path / "in"))
            events.observed(source, F.lit(True), F.col("ts")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            marks.wait(part + 1)
    finally:
        spark.streams.removeListener(marks)
    batch = ordered.progress_marks(done, "run", "seq", "ts", "started", 30, expected=200).orderBy("done").collect()
    names = ["done", "per_hour", "avg_seconds", "eta_seconds"]
    assert [[pytest.approx(m[n]) for n in names] for m in marks.marks] == [[r[n] for n in names] for r in batch]
