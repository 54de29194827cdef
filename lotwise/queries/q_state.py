"""Queries over run state: queueing, events, reads, ids, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import ordered, state
from lotwise.queries.base import BASE, query, run, s, table
from lotwise.streaming import events as stream

_HOME = "https://home.marktplatz.example"

# State before the run: customers of even nations are known vendors.
_STATE = f"""
SELECT concat('{_HOME}/K', {s('c_custkey')}) AS normalized_vendor_url,
       CASE WHEN c_custkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS run_id,
       concat('C', lpad({s('c_custkey + 1')}, 7, '0')) AS haendler_id, '{{}}' AS dealer_json, 'v' AS vendor_json,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'queued' END AS status,
       'e' AS last_error, 't0' AS updated_at
FROM customer WHERE c_nationkey % 2 = 0
"""
_DEALERS = f"""
SELECT o_orderkey AS ord, concat('/k', {s('o_custkey')}, '/?x=1') AS url, {s('o_orderkey')} AS dealer_json FROM orders
"""
_MAX_ID = "(SELECT max(c_custkey) + 1 FROM customer WHERE c_nationkey % 2 = 0)"


@query(
    "queue_vendors",
    f"""
WITH st AS ({_STATE}),
d AS (SELECT concat('{_HOME}/K', o_custkey) AS url, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS dealer_json FROM orders GROUP BY 1),
fresh AS (SELECT url, row_number() OVER (ORDER BY lower(url), url) AS rn FROM d WHERE url NOT IN (SELECT normalized_vendor_url FROM st)),
j AS (SELECT st.*, d.url, d.dealer_json AS dj, fresh.rn, d.url IS NOT NULL AND NOT coalesce(st.run_id = 'r2' AND st.status = 'done', false) AS touched
  FROM st FULL JOIN d ON st.normalized_vendor_url = d.url LEFT JOIN fresh ON d.url = fresh.url)
SELECT coalesce(normalized_vendor_url, url) AS normalized_vendor_url, CASE WHEN touched THEN 'r2' ELSE run_id END AS run_id,
  coalesce(haendler_id, concat('C', lpad(CAST(rn + {_MAX_ID} AS VARCHAR), 7, '0'))) AS haendler_id,
  CASE WHEN touched THEN dj ELSE dealer_json END AS dealer_json,
  CASE WHEN touched AND coalesce(run_id, '') <> 'r2' THEN NULL ELSE vendor_json END AS vendor_json,
  CASE WHEN touched THEN 'queued' ELSE status END AS status, CASE WHEN NOT touched THEN last_error END AS last_error,
  CASE WHEN touched THEN 't1' ELSE updated_at END AS updated_at, touched AS queued
FROM j
""",
)
def _(spark, sf_dir):
    return state.queue_vendors(run(spark, sf_dir, _STATE), run(spark, sf_dir, _DEALERS), "ord", "r2", "t1")


_JOBS = f"""
SELECT concat('u', {s('o_orderkey')}) AS vehicle_url, CASE WHEN o_orderkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS run_id,
       'v0' AS normalized_vendor_url, 'C1' AS haendler_id, '{{}}' AS vendor_info_json, '{{}}' AS fallback_json,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'processing' ELSE 'queued' END AS status,
       o_orderkey % 5 AS attempts, 'e' AS last_error, 't0' AS updated_at, o_orderkey AS first_seq
FROM orders
"""
_ENTRIES = f"""
SELECT concat('u', {s('l_orderkey')}) AS vehicle_url, 'v1' AS normalized_vendor_url, 'C2' AS haendler_id,
       lkey AS vendor_info_json, lkey AS fallback_json, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord
FROM ({BASE})
"""


@query(
    "queue_jobs",
    f"""
WITH d AS (SELECT vehicle_url, arg_max(fallback_json, ord) AS fj FROM ({_ENTRIES}) GROUP BY 1)
SELECT j.vehicle_url, CASE WHEN t THEN 'r2' ELSE run_id END AS run_id, CASE WHEN t THEN fj ELSE fallback_json END AS fallback_json,
  CASE WHEN t THEN 'queued' ELSE status END AS status, CASE WHEN t AND run_id <> 'r2' THEN 0 ELSE attempts END AS attempts, t AS queued
FROM (SELECT j.*, d.fj, d.fj IS NOT NULL AND NOT (run_id = 'r2' AND status = 'done') AS t FROM ({_JOBS}) j LEFT JOIN d USING (vehicle_url)) j
""",
)
def _(spark, sf_dir):
    done = state.queue_vehicles(run(spark, sf_dir, _JOBS), run(spark, sf_dir, _ENTRIES), "ord", "r2", "t1")
    return done.select("vehicle_url", "run_id", "fallback_json", "status", "attempts", "queued")


# Events of the given table as status changes; a quarter belongs to another run.
_KIND = "CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'other' END"
_RUN = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'r1' WHEN 1 THEN '' ELSE 'r2' END"
_EVENTS = f"""
SELECT event_id AS seq, {_KIND} AS kind, concat('u', {s('user_id')}) AS vehicle_url, {_RUN} AS run_id, {s('event_id')} AS payload,
       concat('e', {s('event_id')}) AS error, {s('event_id')} AS ts FROM events
"""
_USER_JOBS = f"""
SELECT concat('u', {s('user_id')}) AS vehicle_url, CASE WHEN user_id % 2 = 0 THEN 'r2' ELSE 'r1' END AS run_id, 'v' AS normalized_vendor_url,
       'C1' AS haendler_id, '' AS vendor_info_json, '' AS fallback_json, 'queued' AS status, user_id % 3 AS attempts,
       CAST(NULL AS STRING) AS last_error, 't0' AS updated_at, min(event_id) AS first_seq
FROM events GROUP BY user_id
"""


@query(
    "job_events",
    f"""
WITH e AS (SELECT e.* FROM ({_EVENTS}) e JOIN ({_USER_JOBS}) j ON e.vehicle_url = j.vehicle_url AND (e.run_id = '' OR e.run_id = j.run_id) WHERE kind <> 'other'),
a AS (SELECT vehicle_url, arg_max(kind, seq) AS k, count(*) FILTER (WHERE kind = 'processing') AS starts, arg_max(ts, seq) AS t,
  arg_max(error, seq) FILTER (WHERE kind = 'failed') AS err FROM e GROUP BY 1)
SELECT j.vehicle_url, coalesce(k, status) AS status, attempts + coalesce(starts, 0) AS attempts, err AS last_error, coalesce(t, updated_at) AS updated_at
FROM ({_USER_JOBS}) j LEFT JOIN a USING (vehicle_url)
""",
)
def _(spark, sf_dir):
    done = state.apply_job_events(run(spark, sf_dir, _USER_JOBS), run(spark, sf_dir, _EVENTS))
    return done.select("vehicle_url", "status", "attempts", "last_error", "updated_at")


@query(
    "upsert_vehicles",
    f"""
SELECT concat('u', user_id) AS vehicle_url, CASE WHEN max(event_id) FILTER (WHERE event_type = 'purchase') IS NULL THEN 'old'
   ELSE CAST(max(event_id) FILTER (WHERE event_type = 'purchase') AS VARCHAR) END AS data_json
FROM events GROUP BY user_id
""",
)
def _(spark, sf_dir):
    old = run(spark, sf_dir, _USER_JOBS).select(
        "vehicle_url", "run_id", "haendler_id", F.lit("old").alias("data_json"), "status", "updated_at"
    )
    new = run(spark, sf_dir, _EVENTS).filter(F.col("kind") == "done").withColumn("haendler_id", F.lit("C9"))
    return state.upsert_vehicles(old, new).select("vehicle_url", "data_json")


@query(
    "requeue",
    f"SELECT vehicle_url, CASE WHEN status = 'processing' AND run_id = 'r1' THEN 'queued' ELSE status END AS status FROM ({_JOBS})",
)
def _(spark, sf_dir):
    return state.requeue_interrupted(run(spark, sf_dir, _JOBS), "r1").select("vehicle_url", "status")


@query(
    "pending",
    f"SELECT vehicle_url, first_seq FROM ({_JOBS}) WHERE status IN ('queued', 'failed') AND run_id = 'r2'",
)
def _(spark, sf_dir):
    return state.pending(run(spark, sf_dir, _JOBS), "first_seq", "r2").select("vehicle_url", "first_seq")


@query("status_hist", f"SELECT status, count(*) AS count FROM ({_JOBS}) GROUP BY status")
def _(spark, sf_dir):
    return state.status_counts(run(spark, sf_dir, _JOBS))


@query(
    "export_vendors",
    f"SELECT haendler_id, normalized_vendor_url, vendor_json FROM ({_STATE}) WHERE status = 'done' AND run_id = 'r1'",
)
def _(spark, sf_dir):
    return state.export_vendors(run(spark, sf_dir, _STATE), "r1")


@query(
    "export_vehicles",
    "SELECT concat('u', user_id) AS vehicle_url, concat('H', user_id % 9) AS haendler_id, CAST(max(event_id) AS VARCHAR) AS data_json FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY user_id",
)
def _(spark, sf_dir):
    new = run(spark, sf_dir, _EVENTS).filter("kind = 'done'")
    user = F.expr("cast(substring(vehicle_url, 2) as bigint)")
    done = new.withColumns({"haendler_id": F.concat(F.lit("H"), (user % 9).cast("string")), "run_id": F.when(user % 2 == 0, F.lit("r2")).otherwise(F.lit("r1"))})
    held = state.upsert_vehicles(spark.createDataFrame([], state.VEHICLE_STATE), done)
    return state.export_vehicles(held, "r2").select("vehicle_url", "haendler_id", "data_json")


@query(
    "export_errors",
    "SELECT event_id AS seq, 'vehicle' AS stage, concat('u', user_id) AS url, concat('m', event_id) AS error_message FROM events WHERE event_type = 'error' AND event_id % 2 = 0",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("seq"), F.lit("vehicle").alias("stage"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("error"),
    )
    held = spark.createDataFrame([], state.ERROR_STATE)
    for part in range(2):
        held = state.append_errors(held, rows.filter(F.col("seq") % 2 == part), f"r{part}", "now")
    return state.export_errors(held, "r0").select("seq", "stage", "url", "error_message")


_RUNS = """
SELECT concat('run', CAST(event_id AS STRING)) AS run_id, event_type AS state, CAST(ts AS STRING) AS started_at, CAST(NULL AS STRING) AS finished_at,
       'processing' AS status, CAST(user_id AS STRING) AS config_hash, concat('/runs/', CAST(event_id AS STRING)) AS path, CAST(user_id % 8 AS INT) AS shard, event_id
FROM events
"""


@query("run_ledger", "SELECT event_type AS state, CAST(arg_max(user_id, ts) AS VARCHAR) AS config_hash FROM events GROUP BY 1")
def _(spark, sf_dir):
    return state.latest_config(run(spark, sf_dir, _RUNS))


@query(
    "resume_conflicts",
    "SELECT event_type AS state, CAST(arg_max(user_id, ts) AS VARCHAR) AS latest_hash FROM events GROUP BY 1 HAVING arg_max(user_id, ts) % 2 = 1",
)
def _(spark, sf_dir):
    runs = run(spark, sf_dir, _RUNS)
    wanted = state.latest_config(runs).withColumn(
        "config_hash", F.when(F.col("config_hash").cast("int") % 2 == 1, F.lit("x")).otherwise(F.col("config_hash"))
    )
    return state.resume_conflicts(runs, wanted).select("state", "latest_hash")


@query(
    "latest_run_per_shard",
    "SELECT CAST(user_id % 8 AS INTEGER) AS shard, concat('/runs/', arg_max(event_id, ts)) AS path FROM events GROUP BY 1",
)
def _(spark, sf_dir):
    return state.latest_run_per_shard(run(spark, sf_dir, _RUNS)).select("shard", "path")


@query(
    "run_starts",
    """
SELECT concat('run', event_id) AS run_id, CASE WHEN event_type = 'error' THEN 'restarted' ELSE event_type END AS state,
  CASE WHEN event_id = 7 THEN 'done' ELSE 'processing' END AS status, CASE WHEN event_id = 7 THEN 't9' END AS finished_at FROM events
""",
)
def _(spark, sf_dir):
    runs = run(spark, sf_dir, _RUNS)
    again = runs.filter(F.col("state") == "error").withColumn("state", F.lit("restarted"))
    done = state.finish_run(state.start_run(runs, again), "run7", "done", "t9")
    return done.select("run_id", "state", "status", "finished_at")


@query(
    "append_errors",
    """
SELECT event_id AS seq, 'r3' AS run_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fetch' END AS stage, CASE WHEN event_id % 3 = 0 THEN 'now' ELSE CAST(event_id AS VARCHAR) END AS timestamp,
  concat('m', event_id) AS error_message FROM events
""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("stage"),
        F.lit("fetch").alias("type"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("ts"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("error"),
    )
    empty = spark.createDataFrame([], state.ERROR_STATE)
    done = state.append_errors(empty, rows, "r3", "now")
    return done.select("seq", "run_id", "stage", "timestamp", "error_message")


@query(
    "stable_ids",
    f"SELECT concat('/X', o_orderkey) AS url, concat('C', lpad(CAST(row_number() OVER (ORDER BY lower(concat('/X', o_orderkey))) + {_MAX_ID} AS VARCHAR), 7, '0')) AS haendler_id FROM orders",
)
def _(spark, sf_dir):
    urls = run(spark, sf_dir, f"SELECT concat('/X', {s('o_orderkey')}) AS url FROM orders")
    return state.assign_vendor_ids(run(spark, sf_dir, _STATE), urls, "url")


@query(
    "cap_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey) AS rn FROM lineitem) WHERE rn <= 30",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return ordered.cap_per_group(lines, ["l_suppkey"], ["l_linenumber", "l_orderkey", "l_partkey"], 30)


@query("shard_assign", "SELECT page_id, CAST(CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 4 AS INTEGER) AS shard FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ordered.shard_of(F.col("url"), 4).alias("shard"))


# -- the event stream --------------------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    """A new folder under the session's checkpoint folder."""
    import uuid

    from lotwise.operators.durable import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_files(spark, sf_dir, files: int = 6):
    """The given events as a folder of several files, read as a stream of two files a micro-batch."""
    folder = _scratch(spark, "events")
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)


# Events of vendors (clicks), vehicles and neither; a quarter belongs to another run.
_LIVE = f"""
SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN (CASE WHEN event_id % 3 = 0 THEN 'vendor_failed' ELSE 'vendor_done' END)
         WHEN {_KIND} = 'other' THEN 'error' ELSE concat('vehicle_', {_KIND}) END AS kind,
       CASE WHEN event_type = 'click' THEN concat('v', {s('user_id % 90')}) ELSE concat('u', {s('user_id')}) END AS url, {_RUN} AS run_id,
       concat('H', {s('event_id % 7')}) AS haendler_id, {s('event_id')} AS payload, concat('e', {s('event_id')}) AS error,
       CASE WHEN event_id % 2 = 0 THEN 'page' END AS stage, 500 AS status_code, '' AS error_type, {s('event_id')} AS ts
FROM {{events}}
"""
_LIVE_JOBS = f"SELECT * FROM ({_USER_JOBS}) WHERE CAST(substr(vehicle_url, 2) AS BIGINT) % 4 <> 3"
_LIVE_VENDORS = f"""
SELECT DISTINCT concat('v', {s('user_id % 60')}) AS normalized_vendor_url, CASE WHEN user_id % 2 = 0 THEN 'r2' ELSE 'r1' END AS run_id, 'C1' AS haendler_id,
       '' AS dealer_json, 'old' AS vendor_json, 'queued' AS status, CAST(NULL AS STRING) AS last_error, 't0' AS updated_at FROM events
"""
_LIVE_VEHICLES = f"""
SELECT DISTINCT concat('u', {s('user_id')}) AS vehicle_url, 'r0' AS run_id, 'H' AS haendler_id, 'old' AS data_json, 'done' AS status, 't0' AS updated_at
FROM events WHERE user_id % 5 = 0
"""
_FOLD_SQL = """SELECT {key} AS key, arg_max(kind, seq) AS kind, count(*) FILTER (WHERE kind LIKE '%processing') AS starts, arg_max(ts, seq) AS ts,
  arg_max(error, seq) FILTER (WHERE kind LIKE '%failed') AS error, arg_max(payload, seq) FILTER (WHERE kind LIKE '%done') AS payload
FROM ev JOIN {table} t ON ev.url = t.{key} AND (ev.run_id = '' OR ev.run_id = t.run_id) WHERE kind <> 'error' GROUP BY 1"""


@query(
    "stream_state",
    f"""
WITH ev AS ({_LIVE.format(events='events')}), jobs AS ({_LIVE_JOBS}), vendors AS ({_LIVE_VENDORS}), vehicles AS ({_LIVE_VEHICLES}),
j AS ({_FOLD_SQL.format(key='vehicle_url', table='jobs')}), v AS ({_FOLD_SQL.format(key='normalized_vendor_url', table='vendors')}),
d AS (SELECT url, arg_max(payload, seq) AS payload, arg_max(run_id, seq) AS run_id, arg_max(haendler_id, seq) AS hid, max(seq) AS seq FROM ev WHERE kind = 'vehicle_done' GROUP BY url)
SELECT 'vehicle_jobs' AS tbl, vehicle_url AS key, coalesce(split_part(kind, '_', 2), status) AS status, attempts + coalesce(starts, 0) AS attempts, error AS detail, coalesce(ts, updated_at) AS updated_at
FROM jobs LEFT JOIN j ON vehicle_url = key
UNION ALL SELECT 'vendors', normalized_vendor_url, coalesce(split_part(kind, '_', 2), status), CAST(NULL AS BIGINT), concat_ws('|', coalesce(payload, vendor_json), error), coalesce(ts, updated_at)
FROM vendors LEFT JOIN v ON normalized_vendor_url = key
UNION ALL SELECT 'vehicles', coalesce(url, vehicle_url), 'done', CAST(NULL AS BIGINT), concat_ws('|', coalesce(d.run_id, vehicles.run_id), coalesce(hid, haendler_id), coalesce(payload, data_json)), coalesce(CAST(seq AS VARCHAR), updated_at)
FROM vehicles FULL JOIN d ON url = vehicle_url
UNION ALL SELECT 'errors', url, CASE WHEN kind = 'error' THEN coalesce(stage, 'pipeline') ELSE split_part(kind, '_', 1) END, seq, concat_ws('|', 'r2', error), ts FROM ev WHERE kind LIKE '%failed' OR kind = 'error'
""",
)
def _(spark, sf_dir):
    folder = _scratch(spark, "stream-state")
    event_files(spark, sf_dir).createOrReplaceTempView("live_events")
    first = {"vehicle_jobs": run(spark, sf_dir, _LIVE_JOBS), "vendors": run(spark, sf_dir, _LIVE_VENDORS), "vehicles": run(spark, sf_dir, _LIVE_VEHICLES)}
    rows = spark.sql(_LIVE.format(events="live_events"))
    stream.write_state(rows, f"{folder}/state", f"{folder}/progress", "r2", "now", first).awaitTermination()
    got = stream.load_state(spark, f"{folder}/state")

    def part(name, key, status, attempts, details, updated):
        detail = F.concat_ws("|", *details) if len(details) > 1 else F.col(details[0])
        return got[name].select(F.lit(name).alias("tbl"), F.col(key).alias("key"), F.col(status).alias("status"), F.expr(attempts).cast("bigint").alias("attempts"), detail.alias("detail"), F.col(updated).alias("updated_at"))

    return (
        part("vehicle_jobs", "vehicle_url", "status", "attempts", ["last_error"], "updated_at")
        .unionByName(part("vendors", "normalized_vendor_url", "status", "null", ["vendor_json", "last_error"], "updated_at"))
        .unionByName(part("vehicles", "vehicle_url", "status", "null", ["run_id", "haendler_id", "data_json"], "updated_at"))
        .unionByName(part("errors", "url", "stage", "seq", ["run_id", "error_message"], "timestamp"))
    )


@query(
    "stream_errors",
    "SELECT event_id AS seq, 'vehicle' AS stage, concat('u', user_id) AS url FROM events WHERE event_type = 'error'",
)
def _(spark, sf_dir):
    empty = {n: spark.createDataFrame([], x) for n, x in stream._EMPTY.items()}
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit("vehicle_failed")).otherwise(F.lit("vehicle_done")).alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.lit("r1").alias("run_id"),
        F.lit("C1").alias("haendler_id"), F.lit("p").alias("payload"), F.lit("boom").alias("error"),
        F.lit(None).cast("string").alias("stage"), F.lit("t").alias("ts"),
    )
    after = stream.apply_batch(empty["vendors"], empty["vehicle_jobs"], empty["vehicles"], empty["errors"], rows, "r1", "now")
    return after["errors"].select("seq", "stage", "url")
