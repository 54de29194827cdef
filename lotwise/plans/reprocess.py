"""Whole jobs: reprocess records into a report, merge runs, enrich offline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.operators import clean, coverage, dedupe, enrich, merge, report, specs, validate
from lotwise.operators.classify import classify_vehicles
from lotwise.operators.contract import ensure_columns, error_shape, require_columns
from lotwise.operators.durable import store, written_order
from lotwise.site import DEFAULT_SITE, Marketplace
from lotwise.sources import records, sinks


def processed_vehicles(
    raw: DataFrame, run_id: str, now: str, *, compose: bool = True
) -> DataFrame:
    """Raw vehicle records to classified rows: projections only."""
    rows = merge.finalize_records(raw, run_id, F.lit(now))
    rows = classify_vehicles(clean.clean_vehicles(rows, compose=compose))
    return clean.overwrite_finanzierung(rows)


def report_tables(
    vendors_raw: DataFrame,
    vehicles_raw: DataFrame,
    errors: DataFrame,
    run: DataFrame,
    run_id: str,
    now: str,
    site: Marketplace = DEFAULT_SITE,
) -> dict[str, DataFrame]:
    """The 19 report tables.

    The cleaned tables feed about a dozen aggregates, so they are stored once;
    every table after that reads the stored Parquet with only the columns it needs.
    """
    vendors = store(clean.clean_vendors(vendors_raw, site))
    vehicles = store(processed_vehicles(vehicles_raw, run_id, now))
    errors = merge.normalize_errors(errors, run_id, F.lit(now))
    require_columns(vendors, site.vendor_fields, "vendors")
    require_columns(vehicles, fixed.VEHICLE_FIELDS, "vehicles")
    tables = report.dashboard_tables(vendors, vehicles, site)
    summary = coverage.summary_long(coverage.run_summary(run, vendors, vehicles, errors, site))
    vendor_cov = coverage.field_coverage(vendors, site.vendor_fields)
    vehicle_cov = coverage.field_coverage(vehicles, vehicles.columns)
    return {
        "Vendors": vendors,
        "Vehicles": vehicles,
        "Vendors_Raw": vendors,
        "Cars_Raw": clean.alias_finanzierung(vehicles_raw),
        "Cars_Processed": vehicles,
        "Run_Summary": summary.select("metric", "value"),
        "Data_Coverage": coverage.coverage_table(vendor_cov, vehicle_cov),
        "Requirements_Compliance": coverage.compliance_table(
            vendors, vehicles, tables, summary, site, order=written_order()
        ).drop("place"),
        "Errors": error_shape(errors),
        "Vendor_Summary": tables["vendor_summary"],
        "Manufacturer_Summary": tables["manufacturer_summary"],
        "Category_Summary": tables["category_summary"],
        "Best_Deals": tables["best_deals"],
        "Worst_Deals": tables["worst_deals"],
        "Efficient_Vehicles": tables["efficient_vehicles"],
        "Classification_Summary": report.classification_summary(vehicles),
        "Category_By_Manufacturer": tables["category_manufacturer_summary"],
        "Origin_Summary": tables["origin_summary"],
        "Dashboard": report.dashboard_sheet(report.dashboard_extracts(tables)),
    }


def reprocess(
    spark: SparkSession,
    folder: str,
    out: str,
    run: DataFrame,
    run_id: str,
    now: str,
    site: Marketplace = DEFAULT_SITE,
) -> Mapping[str, DataFrame]:
    """Existing raw records to a written and validated report bundle."""
    vendors, vehicles = records.read_existing(spark, folder, site)
    errors = spark.createDataFrame([], ", ".join(f"{c} string" for c in fixed.ERROR_FIELDS))
    tables = report_tables(vendors, vehicles, errors, run, run_id, now, site)
    sinks.write_report(tables, out)
    return records.read_report(spark, out)


def merge_runs(spark: SparkSession, runs: Sequence[str], out: str) -> dict[str, int]:
    """Run folders to one folder, the first record of every key."""
    rows, _bad = records.read_runs(spark, runs)
    order = ["run_ord", "layout", "file", "pos"]
    vendors, _ = dedupe.merge_shards(
        rows.filter(F.col("kind") == "vendor"),
        dedupe.vendor_key(F.col("record"), F.col("per_file")),
        order,
    )
    vehicles, skipped = dedupe.merge_shards(
        rows.filter(F.col("kind") == "vehicle"), dedupe.vehicle_key(F.col("record")), order
    )
    return sinks.write_merged(spark, vendors, vehicles, skipped, out)


def enrich_offline(
    spark: SparkSession,
    vehicles: DataFrame,
    cache: DataFrame,
    saved_pages: DataFrame,
    order: str,
    *,
    methods: str = "cache,manual-html",
    cap: int = 0,
) -> DataFrame:
    """Vehicles filled from cached fields and saved pages, in method order."""
    # Stored, as later filters on the parsed fields would run the extraction again.
    parsed = store(specs.detail_records(saved_pages, "vehicle_id"))
    offline = {"cache": cache, "manual-html": parsed}
    chain = [(m, offline[m]) for m in enrich.method_chain(methods) if m in offline]
    shaped = ensure_columns(vehicles, [order, *fixed.VEHICLE_FIELDS])
    shaped = shaped.withColumn(
        "source_vehicle_url", T.first_filled("source_vehicle_url", "Vehicle_URL")
    )
    return enrich.enrich(shaped, chain, "vehicle_id", order, cap=cap)


def valid(tables: Mapping[str, DataFrame], **limits) -> DataFrame:
    """One row that says whether a report bundle passes all checks."""
    return validate.validate_report(tables, **limits).agg(
        F.bool_and("ok").alias("valid"), F.count_if(~F.col("ok")).alias("failed_checks")
    )


