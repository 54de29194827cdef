"""Checks over the report tables, as one table of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.operators.contract import missing_columns
from lotwise.site import DEFAULT_SITE, Marketplace

_SCHEMA = "check string, subject string, ok boolean, detail string"


def _row_check(df: DataFrame, name: str, minimum: int, expected: int | None) -> DataFrame:
    n = F.col("n")
    ok = n >= minimum
    if expected is not None:
        ok = ok & (n == expected)
    return df.agg(F.count("*").alias("n")).select(
        F.lit("rows").alias("check"),
        F.lit(name).alias("subject"),
        ok.alias("ok"),
        n.cast("string").alias("detail"),
    )


def _not_empty(df: DataFrame, name: str) -> DataFrame:
    return df.limit(1).agg(F.count("*").alias("n")).select(
        F.lit("not_empty").alias("check"),
        F.lit(name).alias("subject"),
        (F.col("n") > 0).alias("ok"),
        F.lit("").alias("detail"),
    )


def class_value_checks(vehicles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Disallowed class words per column, without regard to case.  One pass."""
    present = [c for c in columns if c in vehicles.columns]
    one = vehicles.agg(
        *[
            F.array_sort(
                F.collect_set(
                    F.when(
                        F.lower(T.strip(T.field(c))).isin(fixed.DISALLOWED_CLASS_VALUES),
                        F.lower(T.strip(T.field(c))),
                    )
                )
            ).alias(c)
            for c in present
        ]
    )
    items = F.array(
        *[
            F.struct(
                F.lit("class_values").alias("check"),
                F.lit(c).alias("subject"),
                (F.size(T.field(c)) == 0).alias("ok"),
                F.array_join(T.field(c), ",").alias("detail"),
            )
            for c in present
        ]
    )
    return one.select(F.explode(items).alias("r")).select("r.*")


def validate_report(
    tables: Mapping[str, DataFrame],
    *,
    min_vendors: int = 1,
    min_vehicles: int = 1,
    expected_vendors: int | None = None,
    expected_vehicles: int | None = None,
    site: Marketplace = DEFAULT_SITE,
) -> DataFrame:
    """All checks of a report bundle; the bundle is valid if every row is ok.

    Missing tables end the checks, as no later check could run.
    """
    spark = next(iter(tables.values())).sparkSession
    vehicle_table = next((n for n in fixed.VEHICLE_TABLE_CANDIDATES if n in tables), "")
    static = [("table", n, n in tables, "") for n in fixed.REQUIRED_CONTROL_TABLES]
    static.append(("table", "vehicles", bool(vehicle_table), vehicle_table))
    if not all(ok for _, _, ok, _ in static):
        return spark.createDataFrame(static, _SCHEMA)
    vendors, vehicles = tables["Vendors"], tables[vehicle_table]
    needed = [
        ("Vendors", vendors, site.vendor_fields),
        (
            vehicle_table,
            vehicles,
            list(dict.fromkeys([*fixed.REQUIRED_FIELDS, *fixed.FINANCING_FIELDS])),
        ),
        (vehicle_table + " classes", vehicles, fixed.CLASSIFICATION_FIELDS),
    ]
    for name, df, fields in needed:
        missing = missing_columns(df, fields)
        static.append(("columns", name, not missing, ", ".join(missing)))
    checks = spark.createDataFrame(static, _SCHEMA)
    checks = checks.unionByName(_row_check(vendors, "Vendors", min_vendors, expected_vendors))
    checks = checks.unionByName(
        _row_check(vehicles, vehicle_table, min_vehicles, expected_vehicles)
    )
    for name in ("Run_Summary", "Data_Coverage", "Requirements_Compliance"):
        checks = checks.unionByName(_not_empty(tables[name], name))
    if any(c in vehicles.columns for c in fixed.CLASSIFICATION_FIELDS):
        checks = checks.unionByName(class_value_checks(vehicles, fixed.CLASSIFICATION_FIELDS))
    return checks
