"""Run state as keyed streaming state.

Events are folded where they are read (one row per URL, run and batch of rows, so a URL
with most of the events reaches its reducer as a few rows), grouped by URL and met there
by the URL's state.  A URL that a micro-batch touches gives one row of a change log;
nothing else is read or written, so a batch costs what it holds.  The tables are the
first tables with the newest change of each URL laid over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Status events of one URL and run, folded: what was last, and how often work began.
FOLDED = (
    "entity string, url string, run_id string, starts long, seq long, status string, ts string, error_seq long, error string, "
    "done_seq long, payload string, haendler_id string, done_ts string"
)
_JOB = "run_id string, seq long, status string, ts string, attempts long, error_seq long, error string, done_seq long, payload string, version long"
_RESULT = "done_seq long, run_id string, haendler_id string, payload string, ts string, version long"
#: One row per URL that a micro-batch touched; ``known`` if a table had it before.
CHANGE = (
    "entity string, url string, known boolean, status string, updated_at string, attempts long, last_error string, payload string, "
    "result boolean, run_id string, haendler_id string, data_json string, done_at string, version long"
)
_CHANGE = [c.split()[0] for c in CHANGE.split(", ")]

_STATUSES = ["processing", "done", "failed"]


def use_rocksdb(spark) -> None:
    """Keyed state of several values needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _last(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return rows.drop_duplicates(keys, keep="last").set_index(keys)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["entity", "url", "run_id"]
    for rows in batches:
        rows = rows.fillna({"run_id": ""})
        if rows.empty:
            continue
        rows = rows.sort_values("seq", kind="stable")
        out = (rows["kind"] == "processing").groupby([rows[k] for k in keys]).sum().astype("int64").to_frame("starts")
        last = _last(rows, keys)
        failed, done = _last(rows[rows["kind"] == "failed"], keys), _last(rows[rows["kind"] == "done"], keys)
        out = out.join(last[["seq", "kind", "ts"]].rename(columns={"kind": "status"}))
        out = out.join(failed[["seq", "error"]].rename(columns={"seq": "error_seq"}))
        out = out.join(done[["seq", "payload", "haendler_id", "ts"]].rename(columns={"seq": "done_seq", "ts": "done_ts"}))
        out[["error_seq", "done_seq"]] = out[["error_seq", "done_seq"]].astype("Int64")
        yield out.reset_index()


def folded(events: DataFrame) -> DataFrame:
    """Status events of vendors and vehicles, folded within every batch of rows read."""
    parts = F.split("kind", "_", 2)
    rows = events.select(
        parts[0].alias("entity"), "url", F.trim(F.coalesce("run_id", F.lit(""))).alias("run_id"), "seq", parts[1].alias("kind"), "payload", "haendler_id", "error", F.col("ts").cast("string").alias("ts")
    ).filter(F.col("entity").isin("vendor", "vehicle") & F.col("kind").isin(_STATUSES) & F.col("url").isNotNull())
    return rows.mapInPandas(_fold, FOLDED)


class UrlState(StatefulProcessor):
    """State of one vendor or vehicle: its job row, if a table knows it, and its last result.

    An event applies where it is the newest so far by ``seq``, so the order in which
    micro-batches bring the events does not matter.  Events of another run than the row's
    don't apply to it; events without a run apply to any.

    A URL costs one call of the state store for what it reads and one for what it changes; the
    greater version of the two values is the URL's.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", _JOB)
        self.result = handle.getValueState("result", _RESULT)
        self.begun = None

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        row, first = initialState, self.begun != key
        self.begun = key  # of several rows of a URL, which come one after the other, the first counts
        if first and row["known"]:
            self.job.update((row["run_id"], -1, row["status"], row["updated_at"], row["attempts"] or 0, -1, row["last_error"], -1, row["payload"], 0))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        entity, url = key
        job, result = self.job.get(), self.result.get() if entity == "vehicle" else None
        job, result = job and list(job), result and list(result)
        applied = finished = False
        for r in rows:
            if job and r["run_id"] in ("", job[0]):
                applied = True
                job[4] += r["starts"]
                if r["seq"] > job[1]:
                    job[1:4] = [r["seq"], r["status"], r["ts"] if r["ts"] is not None else job[3]]
                if r["error_seq"] is not None and r["error_seq"] > job[5]:
                    job[5:7] = [r["error_seq"], r["error"] if r["error"] is not None else job[6]]
                if r["done_seq"] is not None and r["done_seq"] > job[7]:
                    job[7:9] = [r["done_seq"], r["payload"] if r["payload"] is not None else job[8]]
            if entity == "vehicle" and r["done_seq"] is not None and (result is None or r["done_seq"] > result[0]):
                finished = True
                result = [r["done_seq"], r["run_id"], r["haendler_id"] or "", r["payload"], r["done_ts"], result[5] if result else 0]
        if not applied and not finished:
            return
        version = max(job[9] if job else 0, result[5] if result else 0) + 1
        if applied:
            self.job.update((*job[:9], version))
        if finished:
            self.result.update((*result[:5], version))
        j, d = job or [None] * 10, result or [None] * 6
        yield Row(*_CHANGE)(entity, url, bool(job), j[2], j[3], j[4], j[6], j[8], bool(result), d[1], d[2], d[3], d[4], version)

    def close(self) -> None:
        pass


def known(vendors: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of the first tables as the state of their URLs."""
    row = lambda df, entity, url, attempts, payload: df.select(
        F.lit(entity).alias("entity"), F.col(url).alias("url"), F.lit(True).alias("known"), "run_id", "status", "updated_at", F.expr(attempts).cast("bigint").alias("attempts"), "last_error", F.expr(payload).alias("payload")
    )
    return row(vendors, "vendor", "normalized_vendor_url", "0", "vendor_json").unionByName(row(jobs, "vehicle", "vehicle_url", "attempts", "cast(null as string)"))


def changes(events: DataFrame, vendors: DataFrame, jobs: DataFrame) -> DataFrame:
    """The change log of a stream of events over the first tables."""
    first = known(vendors, jobs).groupBy("entity", "url")
    return folded(events).groupBy("entity", "url").transformWithState(
        statefulProcessor=UrlState(), outputStructType=CHANGE, outputMode="append", timeMode="none", initialState=first
    )


_BREAKER = "attempts long, blocked_total long, streak long, opened long"
#: One row per attempt, and one without ``seq`` when a cool-down is over.
BREAKER_ROW = "method string, seq long, blocked boolean, attempts long, blocked_total long, blocked_streak long, breaker string, trip_reason string"


class Breaker(StatefulProcessor):
    """Circuit breaker of one method; four numbers are kept, whatever the log's length.

    The attempts of a micro-batch are put in order by ``seq``; a micro-batch's size is bounded by
    its source.  ``cooldown_seconds`` sets a timer at the streak's limit, and the timer's end is a
    row of its own.
    """

    def __init__(self, streak_limit: int = 0, cooldown: bool = False, cooldown_seconds: float = 0.0, total_limit: int = 0, rate_limit: float = 0.0):
        self.streak_limit, self.cooldown, self.cooldown_seconds = streak_limit, cooldown, cooldown_seconds
        self.total_limit, self.rate_limit = total_limit, rate_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _BREAKER)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempts, total, streak, opened = self.kept.get() if self.kept.exists() else (0, 0, 0, None)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        hit = batch["blocked"].fillna(False).astype(bool).to_numpy()
        out = pd.DataFrame({"method": key[0], "seq": batch["seq"].to_numpy(), "blocked": hit})
        out["attempts"] = range(attempts + 1, attempts + 1 + len(hit))
        out["blocked_total"] = total + hit.cumsum()
        streaks, states, reasons = [], [], []
        cooled = False
        for seq, blocked, tried, blocks in zip(out["seq"], hit, out["attempts"], out["blocked_total"]):
            streak = streak + 1 if blocked else 0
            if self.cooldown and self.streak_limit and streak > self.streak_limit:
                streak = 1  # it started over at the limit
            full = bool(blocked and self.streak_limit and streak >= self.streak_limit)
            reason = "streak" if full else "total" if blocked and self.total_limit and blocks >= self.total_limit else None
            reason = reason or ("rate" if blocked and self.rate_limit and blocks / tried > self.rate_limit else None)
            cooling = full and self.cooldown
            state, why = "cooldown" if cooling else "closed", None
            if opened is not None:
                state = "skipped"
            elif reason and not cooling:
                state, why, opened = "tripped", reason, int(seq)
            cooled = cooled or state == "cooldown"
            streaks.append(streak)
            states.append(state)
            reasons.append(why)
        out["blocked_streak"], out["breaker"], out["trip_reason"] = streaks, states, reasons
        if cooled and self.cooldown_seconds:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.cooldown_seconds))
        self.kept.update((attempts + len(hit), int(total + hit.sum()), streak, opened))
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        attempts, total, streak, opened = self.kept.get()
        row = (key[0], None, None, attempts, total, streak, "skipped" if opened is not None else "resumed", None)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in BREAKER_ROW.split(", ")])

    def close(self) -> None:
        pass


def breaker(attempts: DataFrame, method: str, order: str, blocked: str, **limits) -> DataFrame:
    """The state of every method's breaker after each attempt of a stream.

    With ``cooldown_seconds`` the stream wakes for its timers, so it needs a trigger by time; without,
    it ends where its input does.
    """
    rows = attempts.select(F.col(method).cast("string").alias("method"), F.col(order).cast("bigint").alias("seq"), F.col(blocked).alias("blocked"))
    return rows.groupBy("method").transformWithStateInPandas(
        statefulProcessor=Breaker(**limits), outputStructType=BREAKER_ROW, outputMode="append", timeMode="processingTime" if limits.get("cooldown_seconds") else "none"
    )
