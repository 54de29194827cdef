"""Field coverage, compliance, error counts and run metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.functions import urls as U
from lotwise.site import DEFAULT_SITE, Marketplace


def percent(present: Column, total: Column) -> Column:
    """Share in percent, two digits, 0 for an empty table."""
    return F.coalesce(F.round(F.try_divide(present, total) * 100, 2), F.lit(0.0))


def field_coverage(
    df: DataFrame, columns: Sequence[str], *, samples: bool = False, order: Column | str | None = None
) -> DataFrame:
    """Filled rows, all rows and percent per field: one pass, one aggregate row.

    With ``samples`` each field also gets its first filled value in ``order``, or the
    smallest one without it.
    """
    first = F.col(order) if isinstance(order, str) else order
    names = list(dict.fromkeys(columns))
    have = set(df.columns)
    aggs = [F.count("*").alias("__n")]
    for i, name in enumerate(names):
        present = T.has_value(T.field(name)) if name in have else F.lit(False)
        aggs.append(F.count_if(present).alias(f"__c{i}"))
        if samples:
            value = T.field(name).cast("string") if name in have else F.lit(None).cast("string")
            place = F.when(present, value if first is None else first)
            aggs.append(F.min_by(value, place).alias(f"__s{i}"))
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(name).alias("field"),
                F.col(f"__c{i}").alias("non_empty_count"),
                F.col("__n").alias("total_count"),
                *([F.coalesce(F.col(f"__s{i}"), F.lit("")).alias("sample")] if samples else []),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        one.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("coverage_pct", percent(F.col("non_empty_count"), F.col("total_count")))
    )


def coverage_table(vendor_coverage: DataFrame, vehicle_coverage: DataFrame) -> DataFrame:
    cols = ["field", "non_empty_count", "total_count", "coverage_pct"]
    return (
        vendor_coverage.select(F.lit("vendors").alias("dataset"), *cols)
        .unionByName(vehicle_coverage.select(F.lit("vehicles").alias("dataset"), *cols))
    )


def group_coverage(coverage: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Filled and possible values per group of fields.

    A field that the table lacks counts as empty in every row; the input is the
    field coverage (one row per field), so this never touches the data again.
    """
    members = F.filter(
        F.array(
            *[
                F.when(F.col("field").isin(list(fields)), F.lit(name))
                for name, fields in groups.items()
            ]
        ),
        lambda g: g.isNotNull(),
    )
    sums = (
        coverage.withColumn("group", F.explode(members))
        .groupBy("group")
        .agg(F.sum("non_empty_count").alias("present"), F.max("total_count").alias("rows"))
    )
    sizes = F.create_map(*[F.lit(x) for n, f in groups.items() for x in (n, len(f))])
    return sums.withColumn("total", F.col("rows") * sizes[F.col("group")]).select(
        "group", "present", "total", percent(F.col("present"), F.col("total")).alias("pct")
    )


REQUIRED_GROUPS = {
    "vehicle_basic_fields_coverage_pct": fixed.BASIC_FIELDS,
    "vehicle_technical_fields_coverage_pct": fixed.TECHNICAL_FIELDS,
    "financing_fields_coverage_pct": fixed.FINANCING_FIELDS,
    "classification_fields_coverage_pct": fixed.CLASSIFICATION_FIELDS,
}


def required_coverage(
    vendors: DataFrame, vehicles: DataFrame, site: Marketplace = DEFAULT_SITE
) -> DataFrame:
    """The six required-coverage metrics; the last pools counts, not percents."""
    vendor_groups = group_coverage(
        field_coverage(vendors, site.vendor_fields),
        {"vendor_required_fields_coverage_pct": site.vendor_fields},
    )
    fields = [f for group in REQUIRED_GROUPS.values() for f in group]
    vehicle_groups = group_coverage(field_coverage(vehicles, fields), REQUIRED_GROUPS)
    both = vendor_groups.unionByName(vehicle_groups)
    final = both.agg(F.sum("present").alias("present"), F.sum("total").alias("total")).select(
        F.lit("final_required_fields_coverage_pct").alias("group"),
        "present",
        "total",
        percent(F.col("present"), F.col("total")).alias("pct"),
    )
    return both.unionByName(final)


# -- compliance -------------------------------------------------------------------


def compliance_status(column_exists: Column, pct: Column) -> Column:
    return (
        F.when(~column_exists, F.lit("missing"))
        .when(pct == 0, F.lit("schema_only"))
        .when(pct < 50, F.lit("weak"))
        .when(pct < 85, F.lit("partially_satisfied"))
        .otherwise(F.lit("satisfied"))
    )


def risk_level(name: Column, status: Column) -> Column:
    scarce = name.isin(fixed.LOW_COVERAGE_FIELDS)
    return (
        F.when(status.isin("missing", "schema_only"), F.lit("high"))
        .when((status == "weak") & scarce, F.lit("high"))
        .when(status.isin("weak", "partially_satisfied"), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def _current_source(dataset: Column, name: Column) -> Column:
    return (
        F.when((dataset == "vendors") & (name == "Händler ID"), F.lit("derived"))
        .when((dataset == "vendors") & (name == "Bundesland"), F.lit("vendor_address_or_region"))
        .when(dataset == "vendors", F.lit("vendor_page"))
        .when(dataset == "financing", F.lit("listing_payload_financePlans_or_detail_page"))
        .when(dataset == "classification", F.lit("derived_processing"))
        .when(name.isin("Händler ID", "Händlername", "PLZ"), F.lit("derived_from_vendor"))
        .when(name.isin(fixed.LOW_COVERAGE_FIELDS), F.lit("listing_payload_attribute_or_detail_page"))
        .otherwise(F.lit("listing_payload_or_detail_page"))
    )


def _notes(dataset: Column, name: Column, status: Column, audited: bool, detail_status: str, domain: str) -> Column:
    scarce = (
        "Extractor exists, but returned source coverage is low. Source audit/detail matrix "
        f"status={detail_status or 'completed'}; values are not guessed."
        if audited
        else "Extractor exists, but current source coverage is low; values are not guessed "
        f"when {domain} does not expose them."
    )
    return (
        F.when(
            name == "Bundesland",
            F.lit(
                "Actual vendor state/region; target search state is kept separately as "
                "search_state/Run_Summary target_state."
            ),
        )
        .when(name.isin(fixed.LOW_COVERAGE_FIELDS), F.lit(scarce))
        .when(
            dataset == "financing",
            F.lit(f"Populated only when {domain} exposes a financing offer for the listing."),
        )
        .when(
            dataset == "classification",
            F.lit("Derived from scraped vehicle type/manufacturer according to task rules."),
        )
        .when(
            status == "partially_satisfied",
            F.lit("Column and extractor exist; this run had sparse source values."),
        )
        .when(
            status == "weak",
            F.lit("Column and extractor exist; this run had very sparse source values."),
        )
        .otherwise(F.lit("Column and extractor are present."))
    )


def requirements(site: Marketplace = DEFAULT_SITE) -> list[tuple[str, str]]:
    """The 51 required (dataset, field) pairs in report order."""
    listed = [
        ("vendors", site.vendor_fields),
        ("vehicles", fixed.REQUIRED_FIELDS),
        ("financing", fixed.FINANCING_FIELDS),
        ("classification", fixed.CLASSIFICATION_FIELDS),
    ]
    return [(dataset, f) for dataset, fields in listed for f in fields]


def field_compliance(
    vendors: DataFrame,
    vehicles: DataFrame,
    site: Marketplace = DEFAULT_SITE,
    *,
    order: Column | str | None = None,
    audited: bool = False,
    detail_status: str = "",
) -> DataFrame:
    """Compliance row of every required field: two one-row aggregates in all."""
    wanted = requirements(site)
    vendor_fields = [f for d, f in wanted if d == "vendors"]
    vehicle_fields = [f for d, f in wanted if d != "vendors"]
    covered = field_coverage(vendors, vendor_fields, samples=True, order=order).withColumn(
        "of", F.lit("vendors")
    ).unionByName(
        field_coverage(vehicles, vehicle_fields, samples=True, order=order).withColumn(
            "of", F.lit("vehicles")
        )
    )
    have = {"vendors": set(vendors.columns), "vehicles": set(vehicles.columns)}
    table = [
        (i, d, f, "vendors" if d == "vendors" else "vehicles",
         f in have["vendors" if d == "vendors" else "vehicles"])
        for i, (d, f) in enumerate(wanted)
    ]
    spec = vendors.sparkSession.createDataFrame(
        table, "place int, dataset string, field string, of string, column_exists boolean"
    )
    rows = spec.join(covered, ["of", "field"], "left")
    pct = F.coalesce("coverage_pct", F.lit(0.0))
    status = compliance_status(F.col("column_exists"), pct)
    name, dataset = F.col("field"), F.col("dataset")
    rows = rows.withColumn("status", status)
    return rows.select(
        "place",
        name.alias("field_name"),
        "dataset",
        F.lit("yes").alias("required_by_task"),
        F.when(F.col("column_exists"), F.lit("yes")).otherwise(F.lit("no")).alias("final_excel_column_exists"),
        F.lit("yes").alias("extractor_exists"),
        _current_source(dataset, name).alias("current_source"),
        pct.alias("current_coverage_pct"),
        F.coalesce("sample", F.lit("")).alias("sample_present_value"),
        F.greatest(F.col("total_count") - F.col("non_empty_count"), F.lit(0)).alias("missing_count"),
        risk_level(name, F.col("status")).alias("risk_level"),
        "status",
        _notes(dataset, name, F.col("status"), audited, detail_status, site.domain).alias("notes"),
    )


# Dashboard requirement, the tables it needs, where it is shown.
_DASHBOARD_REQUIREMENTS = [
    ("Top and Least vendors", ["vendor_summary"], "Vendor_Summary/Dashboard"),
    ("Best and worst deals", ["best_deals", "worst_deals"], "Best_Deals/Worst_Deals"),
    ("Efficient Vehicles", ["efficient_vehicles"], "Efficient_Vehicles"),
    (
        "Highest and lowest manufacturers and top-selling categories",
        ["manufacturer_summary", "category_manufacturer_summary"],
        "Manufacturer_Summary/Category_By_Manufacturer",
    ),
    ("Excel output", [], "workbook"),
    ("Word report", [], "word_report"),
]


def dashboard_compliance(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Compliance rows of the dashboard: whether its tables hold any row."""
    names = sorted({k for _, keys, _ in _DASHBOARD_REQUIREMENTS for k in keys})
    spark = next(iter(tables.values())).sparkSession
    filled = None
    for name in names:
        if name in tables:
            one = tables[name].limit(1).agg((F.count("*") > 0).alias("filled"))
            one = one.select(F.lit(name).alias("name"), "filled")
        else:
            one = spark.createDataFrame([(name, False)], "name string, filled boolean")
        filled = one if filled is None else filled.unionByName(one)
    spec = spark.createDataFrame(
        [
            (51 + i, title, key, source)
            for i, (title, keys, source) in enumerate(_DASHBOARD_REQUIREMENTS)
            for key in (keys or [None])
        ],
        "place int, field_name string, name string, current_source string",
    )
    rows = spec.join(filled, "name", "left").groupBy("place", "field_name", "current_source").agg(
        F.coalesce(F.bool_and(F.col("filled") | F.col("name").isNull()), F.lit(True)).alias("ok")
    )
    return _requirement_rows(
        rows.withColumns(
            {
                "dataset": F.lit("dashboard"),
                "sample": F.lit(""),
                "notes": F.when(
                    F.col("ok"),
                    F.lit("Dashboard requirement is generated in the workbook/report."),
                ).otherwise(F.lit("Dashboard input was empty in this run.")),
            }
        )
    )


def audit_compliance(summary: DataFrame) -> DataFrame:
    """Compliance rows of the source audit, from the long run summary."""
    one = summary.agg(
        *[
            F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit("")).alias(m)
            for m in (
                "source_audit_completed", "source_audit_dir", "detail_strategy_status",
                "detail_strategy_matrix_path",
            )
        ]
    )
    status = F.col("detail_strategy_status")
    audited = F.lower("source_audit_completed") == "true"
    done = (status != "") & ~status.startswith("failed")
    rows = one.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit(57).alias("place"),
                    F.lit("source_audit_completed").alias("field_name"),
                    F.lit("source_audit").alias("dataset"),
                    F.lit("source_audit").alias("current_source"),
                    F.col("source_audit_dir").alias("sample"),
                    audited.alias("ok"),
                    F.when(audited, F.lit("Bounded source audit evidence saved."))
                    .otherwise(F.lit("Source audit was not run for this workbook."))
                    .alias("notes"),
                ),
                F.struct(
                    F.lit(58).alias("place"),
                    F.lit("detail_strategy_matrix_completed").alias("field_name"),
                    F.lit("detail_strategy").alias("dataset"),
                    F.lit("detail_strategy_matrix").alias("current_source"),
                    F.col("detail_strategy_matrix_path").alias("sample"),
                    done.alias("ok"),
                    F.concat(
                        F.lit("Detail strategy status: "),
                        F.when(status != "", status).otherwise(F.lit("not_run")),
                        F.lit("."),
                    ).alias("notes"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    return _requirement_rows(rows)


def _requirement_rows(rows: DataFrame) -> DataFrame:
    ok = F.col("ok")
    return rows.select(
        "place",
        "field_name",
        "dataset",
        F.lit("yes").alias("required_by_task"),
        F.lit("yes").alias("final_excel_column_exists"),
        F.lit("yes").alias("extractor_exists"),
        "current_source",
        F.when(ok, F.lit(100.0)).otherwise(F.lit(0.0)).alias("current_coverage_pct"),
        F.col("sample").alias("sample_present_value"),
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("missing_count"),
        F.when(ok, F.lit("low")).otherwise(F.lit("medium")).alias("risk_level"),
        F.when(ok, F.lit("satisfied")).otherwise(F.lit("schema_only")).alias("status"),
        "notes",
    )


def compliance_table(
    vendors: DataFrame,
    vehicles: DataFrame,
    tables: Mapping[str, DataFrame],
    summary: DataFrame,
    site: Marketplace = DEFAULT_SITE,
    **options,
) -> DataFrame:
    """All 59 compliance rows, in ``place`` order."""
    return (
        field_compliance(vendors, vehicles, site, **options)
        .unionByName(dashboard_compliance(tables))
        .unionByName(audit_compliance(summary))
        .orderBy("place")
    )


def mean_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("dataset").agg(F.round(F.avg("coverage_pct"), 1).alias("mean_pct"))


def low_coverage_fields(coverage: DataFrame, below: float = 25.0) -> DataFrame:
    """The scarce fields below the limit, as one line."""
    rows = coverage.filter(
        F.col("field").isin(fixed.LOW_COVERAGE_FIELDS) & (F.col("coverage_pct") < below)
    )
    item = F.struct("field", F.format_string("%s (%.1f%%)", "field", "coverage_pct").alias("t"))
    # At most four rows, one per scarce field.
    return rows.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", "
        ).alias("fields")
    )


# -- run summary ---------------------------------------------------------------------


def error_flags() -> dict[str, Column]:
    """Conditions behind the error counts, over normalised error rows."""
    code = F.col("status_code").cast("string")
    message = T.first_filled(F.col("error_message"), F.col("error"))
    stage = T.first_filled(F.col("stage"), F.col("type"))
    detail = stage == "vehicle_detail_fetch_failed"
    by_403 = F.coalesce(code == "403", F.lit(False)) | message.contains("HTTP 403")
    by_503 = F.coalesce(code == "503", F.lit(False)) | message.contains("HTTP 503")
    return {
        "error_count": F.lit(True),
        "detail_fetch_failed_count": detail,
        "detail_fetch_403_count": detail & by_403,
        "detail_fetch_503_count": detail & by_503,
        "detail_site_blocked_or_503_count": detail
        & (by_403 | by_503 | (T.text("error_type") == "detail_site_blocked_or_503")),
        "headless_blocked_count": T.first_filled(F.col("type"), F.col("stage")) == "headless_blocked",
        "browser_403_count": F.coalesce(code == "403", F.lit(False))
        & (T.strip("browser") != ""),
    }


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.agg(*[F.count_if(c).alias(name) for name, c in error_flags().items()])


def run_summary(
    run: DataFrame,
    vendors: DataFrame,
    vehicles: DataFrame,
    errors: DataFrame,
    site: Marketplace = DEFAULT_SITE,
) -> DataFrame:
    """One wide row of run metrics.

    ``run`` is the one-row run ledger entry with ``run_id``, ``started_at``,
    ``finished_at`` and the run settings; all inputs meet as one-row aggregates.
    """
    key = F.lit(0).alias("__k")
    fallback = (
        F.col("vehicle_data_source").isin("listing_fallback", "listing_payload")
        if "vehicle_data_source" in vehicles.columns
        else F.lit(False)
    )
    seen = vehicles.agg(
        F.count("*").alias("extracted_vehicle_count"),
        F.count_if(fallback).alias("listing_fallback_used_count"),
    )
    crawled = vendors.agg(F.count("*").alias("processed_vendor_count"))
    covered = required_coverage(vendors, vehicles, site)
    names = ["vendor_required_fields_coverage_pct", *REQUIRED_GROUPS, "final_required_fields_coverage_pct"]
    wide = covered.agg(
        *[F.coalesce(F.max(F.when(F.col("group") == n, F.col("pct"))), F.lit(0.0)).alias(n) for n in names]
    )
    row = run.select("*", key)
    for part in (seen, crawled, error_counts(errors), wide):
        row = row.join(part.select("*", key), "__k")
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) / F.lit(1e6) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    ) / F.lit(1e6)
    n = F.col("extracted_vehicle_count")
    row = row.withColumn("__sec", seconds)
    per_hour = F.when(F.col("__sec") > 0, n / F.col("__sec") * 3600).otherwise(F.lit(0.0))
    row = row.withColumn("__rate", per_hour).withColumns(
        {
            "duration_seconds": F.round("__sec", 2),
            "avg_seconds_per_vehicle": F.round(
                F.coalesce(F.try_divide(F.col("__sec"), n), F.lit(0.0)), 2
            ),
            "vehicles_per_hour": F.round("__rate", 2),
            "estimated_hours_for_20000_vehicles": F.round(
                F.coalesce(F.try_divide(F.lit(20000.0), F.col("__rate")), F.lit(0.0)), 2
            ),
            "warning_count": F.col("detail_fetch_failed_count"),
            "detail_failed_count": F.col("detail_fetch_failed_count"),
            "discovered_vendor_count": F.coalesce(
                F.col("regional_discovered_count"), F.col("processed_vendor_count")
            )
            if "regional_discovered_count" in run.columns
            else F.col("processed_vendor_count"),
        }
    )
    headless = (
        F.col("browser_mode") == "headless" if "browser_mode" in run.columns else F.lit(False)
    )
    row = row.withColumn(
        "strict_headless_blocked",
        (F.col("headless_blocked_count") > 0) | (headless & (F.col("browser_403_count") > 0)),
    )
    if "state" in run.columns:
        row = row.withColumns(
            {
                "target_state_slug": F.col("state"),
                "target_state": U.state_label("state"),
                "search_state": U.state_label("state"),
            }
        )
    return row.drop("__k", "__sec", "__rate", "headless_blocked_count", "browser_403_count")


def summary_long(wide: DataFrame) -> DataFrame:
    """The wide summary row as (metric, value) rows, in column order."""
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(c).alias("metric"),
                T.field(c).cast("string").alias("value"),
            )
            for i, c in enumerate(wide.columns)
        ]
    )
    return wide.select(F.explode(items).alias("r")).select("r.*")


def summary_map(long: DataFrame) -> DataFrame:
    """The (metric, value) rows as one map; the last value of a metric wins.

    A run summary has a few dozen metrics, a bound set by its schema.
    """
    last = long.groupBy("metric").agg(F.max_by("value", "place").alias("value"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("summary"))
