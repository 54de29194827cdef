"""Operators that depend on row order: running totals, streaks, stops, ranks.

A window over a whole group puts that group into one task, and one group may hold
a third of the table.  :func:`scan` therefore ranks the rows by key and order, cuts
the ranks into chunks, scans inside the chunks, scans the chunk totals (one row per
chunk and key), and adds the two.  Ranks are dense, so a chunk holds ``width`` rows
however far the order numbers lie apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import materialize

CHUNK_WIDTH = 1_000_000


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(right[f"__r_{n}"]) for n in names]
    )


def chunked(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Rows with their dense rank by key and order (``__pos``) and its chunk (``__chunk``)."""
    ranked = global_rank(df, [*keys, order], "__pos")
    return ranked.withColumn("__chunk", F.floor((F.col("__pos") - 1) / F.lit(width)))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    streaks: Mapping[str, Column] | None = None,
    width: int = CHUNK_WIDTH,
) -> DataFrame:
    """Running sums and streak lengths, up to and including each row.

    ``sums`` maps a new column to the number it adds up; ``streaks`` maps a new
    column to a flag, and counts the flagged rows since the last unflagged one.
    Rows of one key with equal ``order`` (or none, which comes first) are taken in any
    order, but in one and the same throughout.
    """
    sums, streaks = dict(sums or {}), dict(streaks or {})
    keys = list(keys)
    flags = {name: F.coalesce(flag, F.lit(False)) for name, flag in streaks.items()}
    adds = {**sums, **{f"__hits_{n}": flag.cast("bigint") for n, flag in flags.items()}}

    parts = [*keys, "__chunk"]
    in_chunk = (
        Window.partitionBy(*parts)
        .orderBy("__pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = chunked(df, keys, order, width)
    rows = rows.withColumns({f"__flag_{n}": flag for n, flag in flags.items()})
    local = rows.withColumns({f"__run_{n}": F.sum(c).over(in_chunk) for n, c in adds.items()})
    local = local.withColumns(
        {
            f"__base_{n}": F.max(
                F.when(~F.col(f"__flag_{n}"), F.col(f"__run___hits_{n}"))
            ).over(in_chunk)
            for n in flags
        }
    )

    totals = local.groupBy(*parts).agg(
        *[F.max_by(f"__run_{n}", "__pos").alias(f"__tot_{n}") for n in adds],
        *[F.max(f"__base_{n}").alias(f"__last_{n}") for n in flags],
    )
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.withColumns(
        {f"__off_{n}": F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)) for n in adds}
    )
    carried = carried.withColumns(
        {
            f"__offbase_{n}": F.max(
                F.col(f"__last_{n}") + F.col(f"__off___hits_{n}")
            ).over(before)
            for n in flags
        }
    ).select(
        *[F.col(p).alias(f"__r_{p}") for p in parts],
        *[f"__off_{n}" for n in adds],
        *[f"__offbase_{n}" for n in flags],
    )
    joined = local.join(carried, _same(local, carried, parts), "left")
    result = {name: F.col(f"__off_{name}") + F.col(f"__run_{name}") for name in sums}
    for n in flags:
        hits = F.col(f"__off___hits_{n}") + F.col(f"__run___hits_{n}")
        base = F.greatest(
            F.coalesce(F.col(f"__offbase_{n}"), F.lit(0)),
            F.coalesce(F.col(f"__base_{n}") + F.col(f"__off___hits_{n}"), F.lit(0)),
        )
        result[n] = F.when(F.col(f"__flag_{n}"), hits - base).otherwise(F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in result.items()])


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Dense position 1..n over the whole table without a single-task window.

    The range-sorted rows are materialised, so the numbers stay the same however
    often a lost task is run again; only one row per partition is windowed.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__part", part)
        .join(offsets, "__part")
        .withColumn(name, F.col("__off") + inside + 1)
        .drop("__part", "__off", "__place")
    )


def cap_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, spread: int = 64
) -> DataFrame:
    """First ``n`` rows of every group; no cap for ``n`` of 0.

    Rows compete inside ``spread`` slices of their group first, so at most
    ``spread * n`` rows of a hot group meet in one task.
    """
    if n <= 0:
        return df
    salted = df.withColumn("__slice", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(spread)))
    first = Window.partitionBy(*keys, "__slice").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("__rn", F.row_number().over(first))
        .filter(F.col("__rn") <= n)
        .withColumn("__rn", F.row_number().over(last))
        .filter(F.col("__rn") <= n)
        .drop("__rn", "__slice")
    )


def shard_of(c: Column, shards: int) -> Column:
    """Stable shard number of a URL, the same in any engine: its MD5's first eight digits by the number of shards."""
    return (F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


# -- crawl guards ------------------------------------------------------------


def pages_with_new_keys(entries: DataFrame, run: str, page: str, key: str) -> DataFrame:
    """Per run and page, how many keys appear there for the first time."""
    firsts = entries.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(run, key).agg(
        F.min(page).alias(page)
    )
    fresh = firsts.groupBy(run, page).agg(F.count("*").alias("new_count"))
    pages = entries.select(run, page).distinct()
    return pages.join(fresh, [run, page], "left").withColumn(
        "new_count", F.coalesce("new_count", F.lit(0))
    )


def _until(df: DataFrame, keys: Sequence[str], order: str, stop: Column, inclusive: bool) -> DataFrame:
    """Rows up to the first row that satisfies ``stop``, per group."""
    ends = df.groupBy(*keys).agg(F.min(F.when(stop, F.col(order))).alias("stop_at"))
    limit = F.col("stop_at")
    inside = (F.col(order) <= limit) if inclusive else (F.col(order) < limit)
    return df.join(ends, list(keys)).filter(limit.isNull() | inside)


def stop_on_empty_pages(pages: DataFrame, run: str, page: str, limit: int = 3) -> DataFrame:
    """Pages a crawl visits when it stops after ``limit`` pages without a new key."""
    marked = scan(pages, [run], page, streaks={"empty_streak": F.col("new_count") == 0})
    return _until(marked, [run], page, F.col("empty_streak") >= limit, True)


def stop_on_fallbacks(
    pages: DataFrame, run: str, page: str, strategy: str, limit: int = 3, prefix: str = "playwright"
) -> DataFrame:
    """Pages read before ``limit`` fallback fetches in a row; the last is not read."""
    marked = scan(pages, [run], page, streaks={"fallback_streak": F.col(strategy).startswith(prefix)})
    return _until(marked, [run], page, F.col("fallback_streak") >= limit, False)


def block_breaker(
    attempts: DataFrame,
    method: str,
    order: str,
    blocked: str,
    *,
    streak_limit: int = 0,
    cooldown: bool = False,
    total_limit: int = 0,
    rate_limit: float = 0.0,
    width: int = CHUNK_WIDTH,
) -> DataFrame:
    """State of a per-method circuit breaker after every attempt.

    ``breaker`` is ``closed``, ``cooldown`` (the streak limit is met and the streak
    starts over), ``tripped`` (first row that opens it) or ``skipped`` (later rows).
    """
    hit = F.coalesce(F.col(blocked), F.lit(False))
    rows = scan(
        attempts,
        [method],
        order,
        sums={"attempts": F.lit(1).cast("bigint"), "blocked_total": hit.cast("bigint")},
        streaks={"blocked_streak": hit},
        width=width,
    )
    no = F.lit(False)
    streak = F.col("blocked_streak")
    if cooldown and streak_limit:
        streak = F.when(hit, (streak - 1) % streak_limit + 1).otherwise(F.lit(0))
        rows = rows.withColumn("blocked_streak", streak)
        streak = F.col("blocked_streak")
    by_streak = hit & (streak >= streak_limit) if streak_limit else no
    by_total = hit & (F.col("blocked_total") >= total_limit) if total_limit else no
    by_rate = (
        hit & (F.col("blocked_total") / F.col("attempts") > rate_limit) if rate_limit else no
    )
    cooling = by_streak if cooldown else no
    reason = (
        F.when(by_streak, F.lit("streak"))
        .when(by_total, F.lit("total"))
        .when(by_rate, F.lit("rate"))
    )
    rows = rows.withColumns({"__cool": cooling, "__reason": reason})
    opens = F.col("__reason").isNotNull() & ~F.col("__cool")
    ends = rows.groupBy(method).agg(F.min(F.when(opens, F.col(order))).alias("__open"))
    joined = rows.join(ends, method, "left")
    after = F.coalesce(F.col(order) > F.col("__open"), no)
    at = F.coalesce(F.col(order) == F.col("__open"), no)
    return joined.withColumns(
        {
            "breaker": F.when(after, F.lit("skipped"))
            .when(at, F.lit("tripped"))
            .when(F.col("__cool"), F.lit("cooldown"))
            .otherwise(F.lit("closed")),
            "trip_reason": F.when(at, F.col("__reason")),
        }
    ).drop("__cool", "__reason", "__open")


def disable_after_failures(
    rows: DataFrame, run: str, order: str, failed: str, limit: int, width: int = CHUNK_WIDTH
) -> DataFrame:
    """Marks rows whose details are no longer requested after ``limit`` failures."""
    bad = F.coalesce(F.col(failed), F.lit(False)).cast("bigint")
    marked = scan(rows, [run], order, sums={"failures": bad}, width=width)
    before = F.col("failures") - bad
    off = (before >= limit) if limit > 0 else F.lit(False)
    return marked.withColumn("details_disabled", off)


def progress_marks(
    done: DataFrame,
    run: str,
    order: str,
    ts: str,
    started: str,
    every: int,
    expected: int = 0,
    width: int = CHUNK_WIDTH,
) -> DataFrame:
    """Rate, mean seconds and remaining time at every ``every``-th finished row."""
    counted = scan(done, [run], order, sums={"done": F.lit(1).cast("bigint")}, width=width)
    elapsed = F.unix_micros(ts) / F.lit(1e6) - F.unix_micros(started) / F.lit(1e6)
    marks = counted.filter(F.col("done") % every == 0).withColumn("elapsed", elapsed)
    rate = F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed") * 3600).otherwise(0.0)
    left = F.greatest(F.lit(0), F.lit(expected) - F.col("done"))
    return marks.withColumn("per_hour", rate).withColumns(
        {
            "avg_seconds": F.col("elapsed") / F.col("done"),
            "eta_seconds": F.when(
                (F.lit(expected) > 0) & (F.col("per_hour") > 0),
                left / (F.col("per_hour") / 3600),
            ).otherwise(0.0),
        }
    )


def traversal_report(
    entries: DataFrame, vendor: str, category: str, place: str, key: str, cap: int = 0
) -> DataFrame:
    """Per vendor and category: visited or skipped, why, and how many new listings.

    A listing is new in the first category that shows it; categories after the one
    that fills the vendor's cap are skipped.  The window runs over at most a dozen
    category rows per vendor, never over listings.
    """
    firsts = entries.groupBy(vendor, key).agg(F.min(place).alias(place))
    fresh = firsts.groupBy(vendor, place).agg(F.count("*").alias("__new"))
    shown = entries.select(vendor, category, place).distinct()
    rows = shown.join(fresh, [vendor, place], "left").withColumn(
        "__new", F.coalesce("__new", F.lit(0))
    )
    so_far = Window.partitionBy(vendor).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__new").over(so_far), F.lit(0)))
    full = (F.col("__before") + F.col("__new") >= cap) if cap else F.lit(False)
    rows = rows.withColumn(
        "__full",
        F.min_by(F.when(full, F.col(category)), F.when(full, F.col(place))).over(
            Window.partitionBy(vendor)
        ),
    )
    visited = (F.col("__before") < cap) if cap else F.lit(True)
    taken = F.least(F.col("__new"), F.lit(cap) - F.col("__before")) if cap else F.col("__new")
    return rows.select(
        vendor,
        category,
        visited.alias("visited"),
        (~visited).alias("skipped"),
        F.when(visited, F.lit(""))
        .otherwise(F.concat(F.lit("max_cars_per_vendor reached after "), F.col("__full")))
        .alias("skip_reason"),
        F.when(visited, taken).otherwise(F.lit(0)).cast("bigint").alias("vehicle_count"),
    )
