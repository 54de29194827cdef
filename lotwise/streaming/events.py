"""The event queue as a stream: state tables, the circuit breaker, and progress while it runs."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lotwise.operators import state as S
from lotwise.operators.dedupe import keep_last
from lotwise.sources.sinks import Checkpoints
from lotwise.streaming import keyed

EVENT_SCHEMA = (
    "seq long, kind string, url string, run_id string, haendler_id string, payload string, "
    "error string, stage string, status_code int, error_type string, ts string"
)


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    )


def _status(events: DataFrame, entity: str, key: str) -> DataFrame:
    """Events of one entity with ``kind`` reduced to the status it sets."""
    prefix = f"{entity}_"
    return events.filter(F.col("kind").startswith(prefix)).select(
        "seq",
        F.expr(f"substring(kind, {len(prefix) + 1})").alias("kind"),
        F.col("url").alias(key),
        "run_id",
        "payload",
        "error",
        "ts",
    )


def failures(events: DataFrame) -> DataFrame:
    """Failed and error events with the stage they happened in."""
    own = F.coalesce("stage", F.lit("pipeline"))
    return events.filter(F.col("kind").isin("vendor_failed", "vehicle_failed", "error")).withColumn(
        "stage", F.when(F.col("kind") == "error", own).otherwise(F.substring_index("kind", "_", 1))
    )


def apply_batch(
    vendors: DataFrame,
    jobs: DataFrame,
    vehicles: DataFrame,
    errors: DataFrame,
    events: DataFrame,
    run_id: str,
    now: str,
) -> dict[str, DataFrame]:
    """All state tables after one batch of events."""
    done = events.filter(F.col("kind") == "vehicle_done").select(
        "seq", F.col("url").alias("vehicle_url"), "run_id", "haendler_id", "payload", "ts"
    )
    failed = failures(events)
    return {
        "vendors": S.apply_vendor_events(vendors, _status(events, "vendor", "normalized_vendor_url")),
        "vehicle_jobs": S.apply_job_events(jobs, _status(events, "vehicle", "vehicle_url")),
        "vehicles": S.upsert_vehicles(vehicles, done),
        "errors": S.append_errors(errors, failed, run_id, now),
    }


_EMPTY = {
    "vendors": S.VENDOR_STATE,
    "vehicle_jobs": S.JOB_STATE,
    "vehicles": S.VEHICLE_STATE,
    "errors": S.ERROR_STATE,
}


def load_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables: the first ones with the newest change of every URL laid over them."""
    store = Checkpoints(spark, folder)
    first = {name: store.load(name) for name in _EMPTY}
    tables = {n: spark.createDataFrame([], _EMPTY[n]) if df is None else df for n, df in first.items()}
    if _written(spark, f"{folder}/errors"):
        tables["errors"] = tables["errors"].unionByName(spark.read.parquet(f"{folder}/errors"))
    if not _written(spark, f"{folder}/changes"):
        return tables
    log = spark.read.parquet(f"{folder}/changes")
    newest = keep_last(log, ["entity", "url"], "version")

    def changed(table: str, key: str, entity: str, taken: dict[str, str]) -> DataFrame:
        rows = newest.filter((F.col("entity") == entity) & F.col("known")).select(F.col("url").alias("__url"), *[F.col(c).alias(f"__{c}") for c in taken.values()])
        joined = tables[table].join(rows, F.col(key) == F.col("__url"), "left")
        new = {c: F.when(F.col("__url").isNotNull(), F.col(f"__{n}")).otherwise(F.col(c)) for c, n in taken.items()}
        return joined.withColumns(new).select(*tables[table].columns)

    state = {"status": "status", "last_error": "last_error", "updated_at": "updated_at"}
    results = newest.filter((F.col("entity") == "vehicle") & F.col("result")).select(
        F.col("url").alias("vehicle_url"), "run_id", "haendler_id", "data_json", F.lit("done").alias("status"), F.col("done_at").alias("updated_at")
    )
    kept = tables["vehicles"].join(results.select("vehicle_url"), "vehicle_url", "left_anti")
    return {
        "vendors": changed("vendors", "normalized_vendor_url", "vendor", {**state, "vendor_json": "payload"}),
        "vehicle_jobs": changed("vehicle_jobs", "vehicle_url", "vehicle", {**state, "attempts": "attempts"}),
        "vehicles": kept.select(*tables["vehicles"].columns).unionByName(results),
        "errors": tables["errors"],
    }


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_spark_metadata")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Streams:
    """Streams that belong together."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802 (as Spark names it)
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to a table, each micro-batch once, until the input is used up."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_state(
    events: DataFrame, folder: str, checkpoint: str, run_id: str, now: str, first: Mapping[str, DataFrame] | None = None
) -> Streams:
    """Starts the streams that keep the state, until the input is used up.

    ``first`` has the tables as they stand (``vendors``, ``vehicle_jobs``, ``vehicles``, ``errors``);
    they are kept as they are, and only what events change is appended.  A folder that has
    them already goes on from there.
    """
    spark = events.sparkSession
    store = Checkpoints(spark, folder)
    for name, df in (first or {}).items():
        if not store.exists(name):
            store.save(name, df)
    held = {n: df if (df := store.load(n)) is not None else spark.createDataFrame([], schema) for n, schema in _EMPTY.items()}
    keyed.use_rocksdb(spark)
    failed = failures(events)
    errors = S.error_rows(failed, run_id, now)
    log = keyed.changes(events, held["vendors"], held["vehicle_jobs"])
    return Streams(_append(log, f"{folder}/changes", f"{checkpoint}/changes"), _append(errors, f"{folder}/errors", f"{checkpoint}/errors"))


def write_breaker(
    attempts: DataFrame, folder: str, checkpoint: str, method: str, order: str, blocked: str, **limits
) -> StreamingQuery:
    """Appends the state of every method's circuit breaker after each attempt, until the input is used up."""
    keyed.use_rocksdb(attempts.sparkSession)
    return _append(keyed.breaker(attempts, method, order, blocked, **limits), folder, checkpoint)


class Progress(StreamingQueryListener):
    """Rate, mean seconds and remaining time after every micro-batch of a stream.

    The stream carries the figures itself (:func:`observed`); nothing is read again.
    """

    NAME = "lotwise_progress"

    def __init__(self, started: float, expected: int = 0):
        self.started, self.expected = started, expected
        self.done, self.marks = 0, []

    def wait(self, marks: int, seconds: float = 60.0) -> None:
        """Until so many micro-batches have been heard of; Spark tells of them a little later."""
        end = time.monotonic() + seconds
        while len(self.marks) < marks and time.monotonic() < end:
            time.sleep(0.05)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.NAME)
        if seen is None or not seen["done"]:
            return
        self.done += seen["done"]
        elapsed = seen["last"] / 1e6 - self.started
        per_hour = self.done / elapsed * 3600 if elapsed > 0 else 0.0
        left = max(0, self.expected - self.done)
        eta = left / (per_hour / 3600) if self.expected and per_hour > 0 else 0.0
        self.marks.append({"done": self.done, "elapsed": elapsed, "per_hour": per_hour, "avg_seconds": elapsed / self.done, "eta_seconds": eta})


def observed(rows: DataFrame, finished: Column, ts: Column) -> DataFrame:
    """A stream whose micro-batches say how many rows were finished, and when the last one was."""
    return rows.observe(
        Progress.NAME, F.count_if(finished).alias("done"), F.max(F.when(finished, F.unix_micros(ts))).alias("last")
    )
