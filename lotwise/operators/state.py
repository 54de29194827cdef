"""Run state as tables: queueing, status changes, exports.

Five tables take the part of a state store: runs, vendors, vehicle jobs, vehicles
and errors.  Every change is a pure function from the old snapshot and a batch to
the new snapshot; :mod:`lotwise.streaming.events` writes the snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.functions import urls as U
from lotwise.operators.dedupe import keep_best, keep_last
from lotwise.operators.ordered import global_rank
from lotwise.site import DEFAULT_SITE, Marketplace

VENDOR_STATE = (
    "normalized_vendor_url string, run_id string, haendler_id string, dealer_json string, "
    "vendor_json string, status string, last_error string, updated_at string"
)
JOB_STATE = (
    "vehicle_url string, run_id string, normalized_vendor_url string, haendler_id string, "
    "vendor_info_json string, fallback_json string, status string, attempts long, "
    "last_error string, updated_at string, first_seq long"
)
VEHICLE_STATE = (
    "vehicle_url string, run_id string, haendler_id string, data_json string, "
    "status string, updated_at string"
)
ERROR_STATE = (
    "run_id string, timestamp string, stage string, url string, status_code int, "
    "fetch_strategy string, browser string, attempt int, error_type string, "
    "error_message string, screenshot_path string, html_dump_path string, seq long"
)


def vendor_id(number: Column) -> Column:
    """Running number to an id of the form C0000001; longer numbers keep all digits."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 7, digits).otherwise(F.lpad(digits, 7, "0"))
    return F.concat(F.lit("C"), padded)


def assign_vendor_ids(state: DataFrame, urls: DataFrame, url: str) -> DataFrame:
    """Ids for new URLs, in lower-case URL order after the highest id so far."""
    known = state.select(F.col("normalized_vendor_url").alias(url))
    new = urls.select(url).distinct().join(known, url, "left_anti")
    number = F.when(
        F.col("haendler_id").rlike(r"^C\d+$"), F.expr("substring(haendler_id, 2)").cast("bigint")
    )
    highest = state.agg(F.coalesce(F.max(number), F.lit(0).cast("bigint")).alias("n")).scalar()
    ranked = global_rank(new, [F.lower(url), F.col(url)], "__rank")
    return ranked.select(url, vendor_id(highest + F.col("__rank")).alias("haendler_id"))


def queue_vendors(
    state: DataFrame,
    dealers: DataFrame,
    order: str,
    run_id: str,
    now: str,
    site: Marketplace = DEFAULT_SITE,
) -> DataFrame:
    """State after queueing dealers; ``queued`` marks the jobs that need work.

    Known vendors keep their id.  A new run resets their record, the same run
    leaves finished vendors alone.
    """
    rows = dealers.withColumn("url", U.dealer_url("url", site)).filter(F.col("url") != "")
    incoming = keep_last(rows, ["url"], order).select(
        F.col("url").alias("__url"), F.col("dealer_json").alias("__dealer")
    )
    ids = assign_vendor_ids(state, incoming, "__url").withColumnRenamed("haendler_id", "__new_id")
    joined = state.join(
        incoming, F.col("normalized_vendor_url") == F.col("__url"), "full_outer"
    ).join(ids, "__url", "left")
    came = F.col("__url").isNotNull()
    same_run = F.coalesce(F.col("run_id") == run_id, F.lit(False))
    finished = same_run & (F.col("status") == "done")
    touched = came & ~finished
    return joined.select(
        F.coalesce("normalized_vendor_url", "__url").alias("normalized_vendor_url"),
        F.when(touched, F.lit(run_id)).otherwise(F.col("run_id")).alias("run_id"),
        F.coalesce("haendler_id", "__new_id").alias("haendler_id"),
        F.when(touched, F.col("__dealer")).otherwise(F.col("dealer_json")).alias("dealer_json"),
        F.when(touched & ~same_run, F.lit(None)).otherwise(F.col("vendor_json")).alias("vendor_json"),
        F.when(touched, F.lit("queued")).otherwise(F.col("status")).alias("status"),
        F.when(~touched, F.col("last_error")).alias("last_error"),
        F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        touched.alias("queued"),
    )


def queue_vehicles(
    jobs: DataFrame, entries: DataFrame, order: str, run_id: str, now: str
) -> DataFrame:
    """Job table after queueing listing entries; attempts start over in a new run."""
    incoming = keep_best(
        entries.filter(T.is_filled(F.col("vehicle_url"))),
        ["vehicle_url"],
        F.col(order),
        F.min(order).alias("__first"),
    ).select(
        F.col("vehicle_url").alias("__url"),
        F.col("normalized_vendor_url").alias("__vendor"),
        F.col("haendler_id").alias("__hid"),
        F.col("vendor_info_json").alias("__info"),
        F.col("fallback_json").alias("__fallback"),
        "__first",
    )
    joined = jobs.join(incoming, F.col("vehicle_url") == F.col("__url"), "full_outer")
    same_run = F.coalesce(F.col("run_id") == run_id, F.lit(False))
    touched = F.col("__url").isNotNull() & ~(same_run & (F.col("status") == "done"))

    def pick(new: str, old: str) -> Column:
        return F.when(touched, F.col(new)).otherwise(F.col(old)).alias(old)

    return joined.select(
        F.coalesce("vehicle_url", "__url").alias("vehicle_url"),
        F.when(touched, F.lit(run_id)).otherwise(F.col("run_id")).alias("run_id"),
        pick("__vendor", "normalized_vendor_url"),
        pick("__hid", "haendler_id"),
        pick("__info", "vendor_info_json"),
        pick("__fallback", "fallback_json"),
        F.when(touched, F.lit("queued")).otherwise(F.col("status")).alias("status"),
        F.when(touched & ~same_run, F.lit(0).cast("bigint"))
        .otherwise(F.coalesce("attempts", F.lit(0).cast("bigint")))
        .alias("attempts"),
        F.when(~touched, F.col("last_error")).alias("last_error"),
        F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("first_seq", "__first").alias("first_seq"),
        touched.alias("queued"),
    )


# -- events -------------------------------------------------------------------

# Event kind -> job status.
_STATUS = {"processing": "processing", "done": "done", "failed": "failed"}


def fold_status_events(events: DataFrame, key: str) -> DataFrame:
    """Per key and run: last status, number of starts, last payload and error.

    ``events`` holds ``seq``, ``kind`` (processing, done, failed), the key,
    ``run_id``, ``payload``, ``error`` and ``ts``.  Only aggregates that combine on
    the map side are used, so a key with most of the events is no hot spot.
    """
    is_done, is_failed = F.col("kind") == "done", F.col("kind") == "failed"
    return events.filter(F.col("kind").isin(list(_STATUS))).groupBy(key, "run_id").agg(
        F.max("seq").alias("last_seq"),
        F.max_by("kind", "seq").alias("last_status"),
        F.count_if(F.col("kind") == "processing").alias("starts"),
        F.max(F.when(is_done, F.struct("seq", "payload"))).alias("payload"),
        F.max(F.when(is_failed, F.struct("seq", "error"))).alias("error"),
        F.max_by("ts", "seq").alias("ts"),
    )


def _apply(state: DataFrame, key: str, events: DataFrame, payload: str | None) -> DataFrame:
    """Status events onto a state table.  Events of another run do not apply; events
    without a run apply to any."""
    folded = fold_status_events(events.withColumn("run_id", T.text("run_id")), key).select(
        F.col(key).alias("__key"), F.col("run_id").alias("__run"),
        *[F.col(c).alias(f"__{c}") for c in ("last_seq", "last_status", "starts", "payload", "error", "ts")],
    )
    matching = state.select(F.col(key).alias("__k"), F.col("run_id").alias("__r")).join(
        folded,
        (F.col("__k") == F.col("__key")) & ((F.col("__run") == "") | (F.col("__run") == F.col("__r"))),
    )
    # At most two rows per key are left: the state's own run and the empty run.
    latest = matching.groupBy("__k").agg(
        F.max_by("__last_status", "__last_seq").alias("__status"),
        F.sum("__starts").alias("__starts"),
        F.max("__payload").alias("__payload"),
        F.max("__error").alias("__error"),
        F.max_by("__ts", "__last_seq").alias("__ts"),
    )
    joined = state.join(latest, F.col(key) == F.col("__k"), "left")
    changes = {
        "status": F.coalesce("__status", "status"),
        "last_error": F.coalesce(F.col("__error.error"), F.col("last_error")),
        "updated_at": F.coalesce(F.col("__ts").cast("string"), F.col("updated_at")),
    }
    if payload:
        changes[payload] = F.coalesce(F.col("__payload.payload"), F.col(payload))
    if "attempts" in state.columns:
        changes["attempts"] = F.col("attempts") + F.coalesce("__starts", F.lit(0))
    return joined.withColumns(changes).select(*state.columns)


def apply_vendor_events(state: DataFrame, events: DataFrame) -> DataFrame:
    return _apply(state, "normalized_vendor_url", events, "vendor_json")


def apply_job_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    return _apply(jobs, "vehicle_url", events, None)


def upsert_vehicles(vehicles: DataFrame, done: DataFrame) -> DataFrame:
    """Finished vehicles by URL, the last result wins.

    ``done`` holds ``seq``, ``vehicle_url``, ``run_id``, ``haendler_id``,
    ``payload`` and ``ts``.
    """
    new = done.select(
        "vehicle_url",
        T.text("run_id").alias("run_id"),
        T.text("haendler_id").alias("haendler_id"),
        F.col("payload").alias("data_json"),
        F.lit("done").alias("status"),
        F.col("ts").cast("string").alias("updated_at"),
        F.col("seq").alias("__seq"),
    )
    both = vehicles.withColumn("__seq", F.lit(-1).cast("bigint")).unionByName(new)
    return keep_last(both, ["vehicle_url"], "__seq").drop("__seq")


def error_rows(events: DataFrame, run_id: str, now: str) -> DataFrame:
    """Failed and error events as error rows, defaults filled."""
    have = set(events.columns)

    def own(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    return events.select(
        F.lit(run_id).alias("run_id"),
        T.first_filled(own("ts"), F.lit(now)).alias("timestamp"),
        T.first_filled(own("stage"), own("type")).alias("stage"),
        T.text(own("url")).alias("url"),
        own("status_code").try_cast("int").alias("status_code"),
        T.text(own("fetch_strategy")).alias("fetch_strategy"),
        T.text(own("browser")).alias("browser"),
        own("attempt").try_cast("int").alias("attempt"),
        T.text(own("error_type")).alias("error_type"),
        T.first_filled(own("error_message"), own("error")).alias("error_message"),
        T.text(own("screenshot_path")).alias("screenshot_path"),
        T.text(own("html_dump_path")).alias("html_dump_path"),
        F.col("seq").cast("bigint").alias("seq"),
    )


def append_errors(errors: DataFrame, events: DataFrame, run_id: str, now: str) -> DataFrame:
    """The error table with the rows of failed and error events."""
    return errors.unionByName(error_rows(events, run_id, now))


# -- reads ----------------------------------------------------------------------


def _in_run(run_id: str) -> Column:
    return F.lit(True) if not run_id else F.col("run_id") == run_id


def requeue_interrupted(state: DataFrame, run_id: str = "") -> DataFrame:
    """Rows left in processing go back to queued."""
    stuck = (F.col("status") == "processing") & _in_run(run_id)
    return state.withColumn("status", F.when(stuck, F.lit("queued")).otherwise(F.col("status")))


def pending(state: DataFrame, order: str, run_id: str = "", limit: int = 0) -> DataFrame:
    """Queued and failed rows in order."""
    rows = state.filter(F.col("status").isin("queued", "failed") & _in_run(run_id)).orderBy(order)
    return rows.limit(limit) if limit > 0 else rows


def status_counts(state: DataFrame, run_id: str = "") -> DataFrame:
    return state.filter(_in_run(run_id)).groupBy("status").agg(F.count("*").alias("count"))


def export_vendors(state: DataFrame, run_id: str = "") -> DataFrame:
    done = (F.col("status") == "done") & F.col("vendor_json").isNotNull() & _in_run(run_id)
    return (
        state.filter(done)
        .select("haendler_id", "normalized_vendor_url", "vendor_json")
        .orderBy("haendler_id")
    )


def export_vehicles(vehicles: DataFrame, run_id: str = "") -> DataFrame:
    return vehicles.filter((F.col("status") == "done") & _in_run(run_id)).orderBy(
        "haendler_id", "vehicle_url"
    )


def export_errors(errors: DataFrame, run_id: str = "") -> DataFrame:
    return errors.filter(_in_run(run_id)).orderBy("seq")


# -- run ledger --------------------------------------------------------------------


def start_run(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Started runs replace rows of the same run id."""
    return runs.join(started.select("run_id"), "run_id", "left_anti").unionByName(started)


def finish_run(runs: DataFrame, run_id: str, status: str, now: str) -> DataFrame:
    hit = F.col("run_id") == run_id
    return runs.withColumns(
        {
            "finished_at": F.when(hit, F.lit(now)).otherwise(F.col("finished_at")),
            "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
        }
    )


def latest_config(runs: DataFrame) -> DataFrame:
    """Config hash of the latest run of every state."""
    return runs.groupBy("state").agg(F.max_by("config_hash", "started_at").alias("config_hash"))


def resume_conflicts(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """States whose latest run had another configuration than the wanted one."""
    latest = latest_config(runs).withColumnRenamed("config_hash", "latest_hash")
    return wanted.join(latest, "state").filter(F.col("latest_hash") != F.col("config_hash"))


def latest_run_per_shard(runs: DataFrame) -> DataFrame:
    """Newest run folder of every shard."""
    return runs.groupBy("shard").agg(
        F.max_by("path", F.struct("started_at", "path")).alias("path"),
        F.max("started_at").alias("started_at"),
    )
