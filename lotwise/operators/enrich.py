"""Offline enrichment of vehicle records from cached and saved detail pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import predicates as P
from lotwise.functions import text as T
from lotwise.functions import urls as U
from lotwise.operators.dedupe import keep_last
from lotwise.operators.merge import merge_detail
from lotwise.operators.ordered import scan

# Other spellings of method names.
METHOD_ALIASES = {
    "host_chrome_cdp": "host-chrome-cdp",
    "host_cdp": "host-chrome-cdp",
    "manual_html": "manual-html",
    "original_url": "original-url",
    "original": "original-url",
}
# Detail status that an offline method leaves.
OFFLINE_STATUS = {"cache": "cached_detail_page", "manual-html": "manual_html"}


def method_chain(spec: str) -> list[str]:
    """Methods of a comma list, each once, the cache always first."""
    named = [part.strip().lower() for part in spec.split(",")]
    known = [METHOD_ALIASES.get(name, name) for name in named if name]
    return list(dict.fromkeys(["cache", *known]))


def vehicle_id(df: DataFrame) -> Column:
    """Listing id of either URL, empty where neither holds one."""
    urls = [c for c in ("Vehicle_URL", "source_vehicle_url") if c in df.columns]
    return F.coalesce(*[F.nullif(U.listing_id(F.col(c)), F.lit("")) for c in urls], F.lit(""))


def candidates(
    vehicles: DataFrame,
    order: str,
    *,
    fields: Sequence[str] | None = None,
    cap: int = 0,
    width: int = 1_000_000,
) -> DataFrame:
    """Decision per record: complete, duplicate, over the cap, or chosen.

    Records without a listing id count as their own id, so none is a duplicate of
    another.  The cap counts chosen records in order.
    """
    rows = vehicles.withColumns(
        {
            "vehicle_id": vehicle_id(vehicles),
            "missing": F.size(P.missing_fields(list(fields or fixed.ENRICHMENT_FIELDS))),
        }
    )
    rows = rows.withColumn(
        "vehicle_id",
        F.when(F.col("vehicle_id") != "", F.col("vehicle_id")).otherwise(
            F.concat(F.lit("row-"), F.col(order).cast("string"))
        ),
    )
    open_rows = rows.filter(F.col("missing") > 0)
    firsts = open_rows.groupBy("vehicle_id").agg(F.min(order).alias("__first"))
    marked = rows.join(firsts, "vehicle_id", "left")
    first = F.coalesce((F.col("missing") > 0) & (F.col(order) == F.col("__first")), F.lit(False))
    marked = marked.withColumns({"__first_open": first, "__all": F.lit(0)})
    counted = scan(marked, ["__all"], order, sums={"__nth": first.cast("bigint")}, width=width)
    over = (F.col("__nth") - F.col("__first_open").cast("bigint") >= cap) if cap else F.lit(False)
    return counted.withColumn(
        "decision",
        F.when(F.col("missing") == 0, F.lit("already_complete"))
        .when(over, F.lit("skipped_by_limit"))
        .when(F.col("__first_open"), F.lit("candidate"))
        .otherwise(F.lit("skipped_duplicate_id")),
    ).drop("__first", "__first_open", "__all", "__nth")


def first_source(
    vehicles: DataFrame, sources: Sequence[tuple[str, DataFrame]], on: str, fields: Sequence[str]
) -> DataFrame:
    """For every id, the parsed fields of the first method that has any.

    Each source holds the id and parsed fields, one row per id.  Sources are
    unioned with their place in the chain and reduced with one aggregate, so the
    chain costs one shuffle, not one join per method.
    """
    parts = None
    for place, (method, df) in enumerate(sources):
        values = F.struct(
            *[
                (T.text(T.field(f)) if f in df.columns else F.lit("")).alias(f)
                for f in fields
            ]
        )
        has_any = F.lit(False)
        for f in fields:
            if f in df.columns:
                has_any = has_any | T.has_clean_value(T.field(f))
        part = df.filter(has_any).select(
            F.col(on), F.lit(place).alias("__p"), F.lit(method).alias("method"), values.alias("__v")
        )
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy(on).agg(F.min_by(F.struct("method", "__v"), "__p").alias("__b"))
    return best.select(on, F.col("__b.method").alias("method"), "__b.__v.*")


def enrich(
    vehicles: DataFrame,
    sources: Sequence[tuple[str, DataFrame]],
    on: str,
    order: str,
    *,
    fields: Sequence[str] | None = None,
    cap: int = 0,
) -> DataFrame:
    """Fills chosen records from the first offline source that knows their id.

    Adds the merge columns, the status columns of the winning method, and
    ``missing_before``/``missing_after``.
    """
    fields = list(fields or fixed.ENRICHMENT_FIELDS)
    chosen = candidates(vehicles, order, fields=fields, cap=cap)
    found = first_source(vehicles, sources, on, fields)
    usable = found.select(on, "method", *[T.field(f) for f in fields])
    joined_ids = chosen.filter(F.col("decision") == "candidate").select(on, order).join(usable, on)
    details = joined_ids.drop(on)
    merged = merge_detail(
        chosen, details, order, fields, F.lit(None).cast("string"), offline=True
    )
    method = details.select(
        order,
        F.col("method").alias("__method"),
        sum(
            (T.has_clean_value(T.field(f)).cast("int") for f in fixed.DETAIL_TARGET_FIELDS if f in fields),
            F.lit(0),
        ).alias("__targets"),
    )
    rows = merged.join(method, order, "left")
    used = F.col("__method").isNotNull()
    rows = rows.withColumns(
        {
            **{
                f"{f}_source": F.when(
                    F.array_contains("filled_fields", f), F.col("__method")
                )
                for f in fields
                if f in vehicles.columns
            },
            "missing_before": F.col("missing"),
            "missing_after": F.size(P.missing_fields([f for f in fields if f in vehicles.columns])),
        }
    )
    return rows.withColumns(
        {
            "detail_target_fields_extracted_count": F.when(
                used & (F.col("__targets") > 0), F.col("__targets")
            ),
            "detail_data_source": F.col("__method"),
            "detail_strategy_used": F.col("__method"),
            "detail_status": F.when(F.col("__method") == "cache", F.lit("cached_detail_page")).when(
                F.col("__method") == "manual-html", F.lit("manual_html")
            ),
            "vehicle_data_source": F.when(
                used, F.concat(F.lit("detail_page_"), F.replace(F.col("__method"), F.lit("-"), F.lit("_")))
            ).otherwise(
                F.col("vehicle_data_source")
                if "vehicle_data_source" in vehicles.columns
                else F.lit(None).cast("string")
            ),
            "parse_status": F.when(used, F.lit("ok")).otherwise(
                F.col("parse_status")
                if "parse_status" in vehicles.columns
                else F.lit(None).cast("string")
            ),
        }
    ).drop("__method", "__targets", "missing")


def append_filled(previous: Column, filled: Column) -> Column:
    """Comma list of filled fields, each once, earlier ones first."""
    before = F.filter(
        F.transform(F.split(T.clean_text(previous), ","), lambda x: F.trim(x)), lambda x: x != ""
    )
    return F.array_join(F.array_distinct(F.concat(before, filled)), ", ")


def _coverage(rows: DataFrame, fields: Sequence[str], before: bool) -> Column:
    """Per cent of all cells of the fields that hold a value; before enrichment, those it filled don't count."""
    held = F.lit(0)
    for f in fields:
        if f in rows.columns:
            present = T.has_clean_value(T.field(f))
            if before:
                present = present & ~F.coalesce(F.array_contains("filled_fields", f), F.lit(False))
            held = held + present.cast("int")
    return F.coalesce(F.round(F.try_divide(F.sum(held) * 100.0, F.count("*") * len(fields)), 2), F.lit(0.0))


def enrichment_summary(rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Counts over the enriched records in one aggregate row, coverage before and after among them.

    ``failures`` is the run's failed attempts; blocked ones are counted.
    """
    tried = F.col("decision") == "candidate"
    hit = tried & F.col("detail_data_source").isNotNull()
    improved = F.greatest(F.col("missing_before") - F.col("missing_after"), F.lit(0))
    sections = {"technical": fixed.TECHNICAL_FIELDS, "financing": fixed.FINANCING_FIELDS}
    blocked = F.lit(0).cast("bigint")
    if failures is not None:
        blocked = attempt_counts(failures).agg(F.coalesce(F.sum("blocked_count"), F.lit(0)).alias("n")).scalar()
    return rows.agg(
        F.count_if(F.col("decision") == "already_complete").alias("already_complete_count"),
        F.count_if(F.col("decision") == "skipped_by_limit").alias("skipped_by_limit_count"),
        F.count_if(F.col("decision") == "skipped_duplicate_id").alias("skipped_duplicate_id_count"),
        F.count_if(tried).alias("attempted"),
        F.count_if(hit).alias("success"),
        F.count_if(tried & ~F.coalesce(hit, F.lit(False))).alias("failed"),
        F.count_if(hit & (F.col("detail_data_source") == "cache")).alias("cache_hit"),
        F.count_if(hit & (improved > 0)).alias("vehicles_improved_count"),
        F.count_if(hit & (improved == 0)).alias("successful_without_new_fields_count"),
        F.coalesce(F.sum(F.when(hit, improved)), F.lit(0)).alias("fields_improved_count"),
        F.coalesce(F.sum(F.when(hit, F.size("filled_fields"))), F.lit(0)).alias("fields_filled_count"),
        F.coalesce(F.sum(F.when(tried, F.col("missing_before"))), F.lit(0)).alias("missing_field_total_before"),
        F.coalesce(F.sum(F.when(tried, F.col("missing_after"))), F.lit(0)).alias("missing_field_total_after"),
        F.count_if(tried & (F.col("missing_after") > 0)).alias("still_missing_vehicle_count"),
        *[
            _coverage(rows, fields, when == "before").alias(f"{name}_coverage_{when}_pct")
            for name, fields in sections.items()
            for when in ("before", "after")
        ],
    ).withColumn("blocked", blocked)


def failed_attempts(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Failed-attempt ledger: the last row of every (vehicle, URL, method)."""
    late = existing.withColumn("__late", F.lit(0)).unionByName(
        new.withColumn("__late", F.lit(1)), allowMissingColumns=True
    )
    keyed = late.withColumns({c: T.clean_text(c) for c in ("vehicle_id", "url", "method")})
    keyed = keyed.withColumn("__rank", F.struct("__late", order))
    return keep_last(keyed, ["vehicle_id", "url", "method"], "__rank").drop("__rank", "__late")


def attempt_counts(failures: DataFrame) -> DataFrame:
    """Failed and blocked attempts per method."""
    blocked = P.attempt_blocked(
        [F.col(c) for c in ("reason", "classification", "detail_status")], F.col("status_code")
    )
    return failures.groupBy("method").agg(
        F.count("*").alias("failed_count"), F.count_if(blocked).alias("blocked_count")
    )


def latest_page_cache(cache: DataFrame, buckets: int = 64) -> DataFrame:
    """Newest cached fields per vehicle id, with the partition bucket of the id."""
    newest = keep_last(cache, ["vehicle_id"], "cached_at_utc")
    return newest.withColumn("bucket", F.pmod(F.xxhash64("vehicle_id"), F.lit(buckets)).cast("int"))
