"""Queries over ordered operators: stops, breakers, progress, traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import ordered
from lotwise.queries.base import query, run, table
from lotwise.queries.q_state import _scratch
from lotwise.streaming import events as stream

# Pages of a crawl: ten events of a type are one page, users are the dealers found.
_CRAWL = """
SELECT event_type AS crawl, event_id / 10 - event_id % 10 / 10.0 AS unused, CAST(floor(event_id / 40) AS BIGINT) AS page, CAST(user_id AS STRING) AS dealer
FROM events
""".replace("event_id / 10 - event_id % 10 / 10.0 AS unused, ", "")


@query(
    "new_keys_per_page",
    f"""
WITH c AS ({_CRAWL}), f AS (SELECT crawl, dealer, min(page) AS page FROM c GROUP BY 1, 2)
SELECT p.crawl, p.page, count(f.dealer) AS new_count FROM (SELECT DISTINCT crawl, page FROM c) p LEFT JOIN f ON p.crawl = f.crawl AND p.page = f.page GROUP BY 1, 2
""",
)
def _(spark, sf_dir):
    return ordered.pages_with_new_keys(run(spark, sf_dir, _CRAWL), "crawl", "page", "dealer")


@query(
    "page_stop",
    f"""
WITH c AS ({_CRAWL}), f AS (SELECT crawl, dealer, min(page) AS page FROM c GROUP BY 1, 2),
n AS (SELECT p.crawl, p.page, count(f.dealer) AS new_count FROM (SELECT DISTINCT crawl, page FROM c) p LEFT JOIN f ON p.crawl = f.crawl AND p.page = f.page GROUP BY 1, 2),
g AS (SELECT *, count(*) FILTER (WHERE new_count > 0) OVER (PARTITION BY crawl ORDER BY page) AS grp FROM n),
r AS (SELECT *, CASE WHEN new_count = 0 THEN count(*) FILTER (WHERE new_count = 0) OVER (PARTITION BY crawl, grp ORDER BY page) ELSE 0 END AS streak FROM g),
e AS (SELECT crawl, min(page) FILTER (WHERE streak >= 3) AS stop_at FROM r GROUP BY 1)
SELECT r.crawl, page, new_count, streak AS empty_streak, stop_at FROM r JOIN e USING (crawl) WHERE stop_at IS NULL OR page <= stop_at
""",
)
def _(spark, sf_dir):
    pages = ordered.pages_with_new_keys(run(spark, sf_dir, _CRAWL), "crawl", "page", "dealer")
    done = ordered.stop_on_empty_pages(pages, "crawl", "page")
    return done.select("crawl", "page", "new_count", "empty_streak", "stop_at")


_FETCHED = """
SELECT user_id AS crawl, event_id AS page, CASE WHEN event_type IN ('error', 'click') THEN 'playwright-headed' ELSE 'curl' END AS strategy FROM events
"""


@query(
    "fallback_stop",
    f"""
WITH g AS (SELECT *, count(*) FILTER (WHERE strategy = 'curl') OVER (PARTITION BY crawl ORDER BY page) AS grp FROM ({_FETCHED})),
r AS (SELECT *, count(*) FILTER (WHERE strategy <> 'curl') OVER (PARTITION BY crawl, grp ORDER BY page) AS n FROM g),
e AS (SELECT crawl, min(page) FILTER (WHERE strategy <> 'curl' AND n >= 3) AS stop_at FROM r GROUP BY 1)
SELECT r.crawl, page FROM r JOIN e USING (crawl) WHERE stop_at IS NULL OR page < stop_at
""",
)
def _(spark, sf_dir):
    return ordered.stop_on_fallbacks(run(spark, sf_dir, _FETCHED), "crawl", "page", "strategy").select("crawl", "page")


_ATTEMPTS = """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'existing' ELSE 'cache' END AS method, event_type IN ('error', 'click') AS blocked FROM events
"""
_BREAKER = f"""
WITH g AS (SELECT *, count(*) FILTER (WHERE NOT blocked) OVER w AS grp, count(*) OVER w AS attempts, count(*) FILTER (WHERE blocked) OVER w AS total
  FROM ({_ATTEMPTS}) WINDOW w AS (PARTITION BY method ORDER BY event_id)),
r AS (SELECT *, CASE WHEN blocked THEN count(*) FILTER (WHERE blocked) OVER (PARTITION BY method, grp ORDER BY event_id) ELSE 0 END AS streak FROM g)
"""


_BREAKER_OPENS = (
    _BREAKER
    + """,
t AS (SELECT *, CASE WHEN blocked AND streak >= 9 THEN 'streak' WHEN blocked AND total >= 2000 THEN 'total' WHEN blocked AND total / attempts > 0.8 THEN 'rate' END AS why FROM r),
e AS (SELECT method, min(event_id) FILTER (WHERE why IS NOT NULL) AS open_at FROM t GROUP BY 1)
SELECT event_id, t.method, attempts, total AS blocked_total, streak AS blocked_streak,
  CASE WHEN event_id > open_at THEN 'skipped' WHEN event_id = open_at THEN 'tripped' ELSE 'closed' END AS breaker, CASE WHEN event_id = open_at THEN why END AS trip_reason
FROM t JOIN e USING (method)
"""
)


@query("breaker", _BREAKER_OPENS)
def _(spark, sf_dir):
    done = ordered.block_breaker(
        run(spark, sf_dir, _ATTEMPTS), "method", "event_id", "blocked", streak_limit=9, total_limit=2000, rate_limit=0.8, width=700
    )
    return done.drop("blocked")


_BREAKER_COOLS = (
    _BREAKER
    + """,
c AS (SELECT *, CASE WHEN blocked THEN (streak - 1) % 3 + 1 ELSE 0 END AS pos FROM r),
t AS (SELECT *, blocked AND pos >= 3 AS cool, blocked AND pos < 3 AND total >= 1500 AS opens FROM c),
e AS (SELECT method, min(event_id) FILTER (WHERE opens) AS open_at FROM t GROUP BY 1)
SELECT event_id, t.method, pos AS blocked_streak, CASE WHEN event_id > open_at THEN 'skipped' WHEN event_id = open_at THEN 'tripped' WHEN cool THEN 'cooldown' ELSE 'closed' END AS breaker
FROM t JOIN e USING (method)
"""
)


@query("breaker_cooldown", _BREAKER_COOLS)
def _(spark, sf_dir):
    done = ordered.block_breaker(
        run(spark, sf_dir, _ATTEMPTS), "method", "event_id", "blocked", streak_limit=3, cooldown=True, total_limit=1500, width=700
    )
    return done.select("event_id", "method", "blocked_streak", "breaker")


def _arrivals(spark, sf_dir, folder, parts):
    """The given events arrive in the folder part by part, in order; yields the stream to be started after each."""
    events = table(spark, sf_dir, "events")
    top = events.agg(F.max("event_id") + 1).first()[0]
    for part in range(parts):
        events.filter(F.floor(F.col("event_id") * parts / top) == part).write.mode("append").parquet(folder)
        yield spark.readStream.schema(events.schema).parquet(folder)


def _live_breaker(spark, sf_dir, **limits):
    """The breaker's rows from a stream of several micro-batches; attempts are not read again."""
    folder = _scratch(spark, "breaker")
    for arrived in _arrivals(spark, sf_dir, f"{folder}/in", 3):
        arrived.createOrReplaceTempView("live_attempts")
        attempts = spark.sql(_ATTEMPTS.replace("FROM events", "FROM live_attempts"))
        stream.write_breaker(attempts, f"{folder}/rows", f"{folder}/progress", "method", "event_id", "blocked", **limits).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").filter("seq IS NOT NULL").withColumnRenamed("seq", "event_id")


@query("stream_breaker", _BREAKER_OPENS)
def _(spark, sf_dir):
    return _live_breaker(spark, sf_dir, streak_limit=9, total_limit=2000, rate_limit=0.8).drop("blocked")


@query("stream_breaker_cooldown", _BREAKER_COOLS)
def _(spark, sf_dir):
    done = _live_breaker(spark, sf_dir, streak_limit=3, cooldown=True, total_limit=1500)
    return done.select("event_id", "method", "blocked_streak", "breaker")


@query(
    "stream_progress",
    """
WITH p AS (SELECT event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS part, ts FROM events WHERE event_type = 'purchase'),
d AS (SELECT part, sum(count(*)) OVER (ORDER BY part) AS done, epoch_us(max(ts)) / 1e6 - 1704067200.0 AS elapsed FROM p GROUP BY part)
SELECT CAST(done AS BIGINT) AS done, round(done / elapsed * 3600, 6) AS per_hour, round(elapsed / done, 6) AS avg_seconds, round(greatest(0, 5000 - done) / (done / elapsed * 3600 / 3600), 4) AS eta_seconds FROM d
""",
)
def _(spark, sf_dir):
    folder = _scratch(spark, "progress")
    marks = stream.Progress(1704067200.0, expected=5000)
    spark.streams.addListener(marks)
    try:
        for part, rows in enumerate(_arrivals(spark, sf_dir, f"{folder}/in", 4)):
            seen = stream.observed(rows, F.col("event_type") == "purchase", F.col("ts").cast("timestamp"))
            seen.writeStream.format("noop").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
            marks.wait(part + 1)
    finally:
        spark.streams.removeListener(marks)
    found = [(m["done"], m["per_hour"], m["avg_seconds"], m["eta_seconds"]) for m in marks.marks]
    rows = spark.createDataFrame(found, "done long, per_hour double, avg_seconds double, eta_seconds double")
    return rows.select("done", F.round("per_hour", 6).alias("per_hour"), F.round("avg_seconds", 6).alias("avg_seconds"), F.round("eta_seconds", 4).alias("eta_seconds"))


@query(
    "fail_disable",
    """
SELECT event_id, user_id, count(*) FILTER (WHERE event_type = 'error') OVER w AS failures,
  count(*) FILTER (WHERE event_type = 'error') OVER w - (event_type = 'error')::INT >= 5 AS details_disabled
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed"))
    return ordered.disable_after_failures(rows, "user_id", "event_id", "failed", 5, width=1000).drop("failed")


@query(
    "progress_marks",
    """
WITH d AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done FROM events)
SELECT event_type, event_id, done, round(done / (epoch_us(ts) / 1e6 - 1704067200.0) * 3600, 6) AS per_hour,
  round(greatest(0, 3000 - done) / (done / (epoch_us(ts) / 1e6 - 1704067200.0) * 3600 / 3600), 4) AS eta_seconds
FROM d WHERE done % 100 = 0
""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_type", "event_id", "ts", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started")
    )
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    marks = ordered.progress_marks(rows, "event_type", "event_id", "ts", "started", 100, expected=3000, width=1000)
    return marks.select(
        "event_type", "event_id", "done", F.round("per_hour", 6).alias("per_hour"), F.round("eta_seconds", 4).alias("eta_seconds")
    )


@query("running_totals", "SELECT event_id, event_type, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS total FROM events")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    done = ordered.scan(rows, ["event_type"], "event_id", sums={"total": F.col("user_id")}, width=512)
    return done.select("event_id", "event_type", "total")


_INVENTORY = """
SELECT l_suppkey, CAST(l_linenumber AS INT) AS cat_ord, concat('c', CAST(l_linenumber AS STRING)) AS category, concat('k', CAST(l_partkey AS STRING)) AS entry, l_orderkey * 100000 + l_partkey AS pos
FROM lineitem
"""


@query(
    "traversal_report",
    f"""
WITH f AS (SELECT l_suppkey, entry, min(cat_ord) AS cat_ord FROM ({_INVENTORY}) GROUP BY 1, 2),
n AS (SELECT l_suppkey, cat_ord, count(*) AS fresh FROM f GROUP BY 1, 2),
c AS (SELECT DISTINCT l_suppkey, cat_ord, category FROM ({_INVENTORY})),
r AS (SELECT c.*, coalesce(fresh, 0) AS fresh, coalesce(sum(coalesce(fresh, 0)) OVER (PARTITION BY c.l_suppkey ORDER BY c.cat_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c LEFT JOIN n USING (l_suppkey, cat_ord)),
x AS (SELECT l_suppkey, min(cat_ord) FILTER (WHERE before + fresh >= 250) AS full_at FROM r GROUP BY 1)
SELECT r.l_suppkey, r.category, before < 250 AS visited, before >= 250 AS skipped,
  CASE WHEN before >= 250 THEN concat('max_cars_per_vendor reached after c', full_at) ELSE '' END AS skip_reason,
  CAST(CASE WHEN before < 250 THEN least(fresh, 250 - before) ELSE 0 END AS BIGINT) AS vehicle_count
FROM r JOIN x USING (l_suppkey)
""",
)
def _(spark, sf_dir):
    return ordered.traversal_report(run(spark, sf_dir, _INVENTORY), "l_suppkey", "category", "cat_ord", "entry", 250)
