"""Registry of queries, and the inputs they derive from the given tables.

Inputs are plain SQL that Spark and DuckDB read alike: listings, vendors, events
and pages are *rendered* from the numbers of the given tables, so the oracle can
state the expected values from those very numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """SQL over the given tables.

    ``spread`` deals the line items out anew first.  A file is read by as many tasks as it has row groups, and what
    is made of its rows stays there; that is too few where a row becomes a page, however small the table is.  The
    number of tasks is the session's, as rows are small when they are dealt out and would be put together by bytes.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            rows = table(spark, sf_dir, name)
            rows = rows.repartition(tasks, "l_orderkey", "l_linenumber") if spread and name == "lineitem" else rows
            rows.createOrReplaceTempView(name)
    return spark.sql(sql)


# -- SQL pieces that both engines read alike ---------------------------------------


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def grouped(x: str, mark: str = ".") -> str:
    """Whole number below a million with a thousands mark."""
    return (
        f"CASE WHEN {x} >= 1000 THEN concat({s(f'CAST(floor({x} / 1000) AS BIGINT)')}, '{mark}', "
        f"lpad({s(f'{x} % 1000')}, 3, '0')) ELSE {s(x)} END"
    )


def two(x: str) -> str:
    return f"lpad({s(x)}, 2, '0')"


def pick(x: str, values: list[str]) -> str:
    """Text by remainder."""
    n = len(values)
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST(({x}) % {n} AS INT) {cases} END"


BRANDS = [
    "BMW", "VW Nutzfahrzeuge", "Hyundai", "Alfa Romeo", "Toyota", "Peugeot", "Tesla", "",
    "Mercedes-Benz", "Škoda", "KGM", "DS Automobiles", "Unbekannt", "Kia", "Ford",
]
TYPES = [
    "Kleinwagen", "Kastenwagen", "Kombi", "SomethingXyz", "", "Auflieger", "Enduro",
    "Kombi Kasten", "Wohnwagen", "Limousine",
]
SOURCES = ["Car", "VanUpTo7500", "", "ForkliftTruck", "Motorhome", "Unknown", "Trailer"]
MODELS = ["Golf", "320 Touring", "i30", "Giulia", "Corolla", "208", "Model 3"]

# Numbers behind a listing; one row per line item.
BASE = f"""
SELECT concat({s('l_orderkey')}, '-', {s('l_linenumber')}, '-', {s('l_partkey')}, '-',
              {s('l_suppkey')}, '-', {s('CAST(floor(l_extendedprice * 100) AS BIGINT)')}) AS lkey,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       10000000 + l_orderkey * 10 + l_linenumber AS listing,
       CAST(floor(l_extendedprice) AS BIGINT) AS price,
       CAST(floor(l_quantity) AS BIGINT) AS cents,
       (l_orderkey * 37 + l_linenumber * 1013) % 300000 AS km,
       p_size * 5 + 30 AS kw, p_size * 7 + 41 AS ps, 90 + p_size * 3 AS co2,
       900 + p_size * 61 AS ccm,
       year(l_shipdate) AS yr, month(l_shipdate) AS mon,
       CAST(floor(l_discount * 100) AS BIGINT) * 100 + l_linenumber * 11 AS rate,
       12 * l_linenumber AS months, p_size,
       {pick('l_partkey', BRANDS)} AS brand, {pick('l_partkey + l_linenumber', MODELS)} AS model,
       {pick('l_orderkey + l_partkey', TYPES)} AS vtype,
       {pick('l_orderkey + l_linenumber', SOURCES)} AS source,
       (l_orderkey + l_linenumber) % 6 AS v
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# Listings as the marketplace shows them: German text, some of it missing.
LISTINGS = f"""
SELECT b.*,
       concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', {s('listing')}) AS url,
       CASE v WHEN 0 THEN concat({grouped('price')}, ' €')
              WHEN 1 THEN concat({grouped('price')}, ' € (Brutto)')
              WHEN 2 THEN concat('€', {grouped('price', ',')}, ' (Net)')
              WHEN 3 THEN concat({grouped('price')}, ',', {two('cents')}, ' €')
              WHEN 4 THEN '' ELSE 'nan' END AS preis,
       CASE WHEN v = 2 THEN '' ELSE concat({grouped('km')}, ' km') END AS kilometer,
       CASE WHEN v = 5 THEN concat({s('kw')}, ' kW') WHEN v = 4 THEN concat({s('ps')}, ' PS')
            ELSE concat({s('kw')}, ' kW (', {s('ps')}, ' PS)') END AS leistung,
       CASE WHEN v = 1 THEN 'None' ELSE concat({two('mon')}, '/', {s('yr')}) END AS ez,
       CASE WHEN v = 0 THEN '' ELSE concat({s('co2')}, ' g/km') END AS co2_text,
       concat({grouped('ccm')}, ' cm³') AS hubraum,
       concat({s('rate / 100 - rate % 100 / 100.0')}, '') AS unused,
       concat({s('CAST(floor(rate / 100) AS BIGINT)')}, ',', {two('rate % 100')}, '%') AS zins,
       concat({s('months')}, ' Monate') AS laufzeit
FROM ({BASE}) b
"""
LISTINGS = re.sub(r"\n\s+concat\([^\n]*AS unused,", "", LISTINGS)

# Contract names of the listing columns.
CONTRACT = {
    "brand": "Markes", "model": "Models", "vtype": "Fahrzeugtyp", "source": "source_category",
    "url": "Vehicle_URL", "preis": "Preis", "kilometer": "Kilometerstand",
    "leistung": "Leistung", "ez": "Erstzulassung", "co2_text": "CO₂-Emissionen",
    "hubraum": "Hubraum", "zins": "Fester Sollzins p.a.", "laufzeit": "Laufzeit",
}


def listings(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Rendered listings under their contract names, plus the named base columns."""
    df = run(spark, sf_dir, LISTINGS)
    return df.select(
        "lkey", *extra, *[df[old].alias(new) for old, new in CONTRACT.items()]
    )


# Expected numbers of the rendered texts.
EXPECTED = {
    "price_eur": "CASE WHEN v IN (0, 1, 2) THEN CAST(price AS DOUBLE) WHEN v = 3 THEN "
    "CAST(concat(CAST(price AS STRING), '.', lpad(CAST(cents AS STRING), 2, '0')) AS DOUBLE) END",
    "mileage_km": "CASE WHEN v <> 2 THEN CAST(km AS DOUBLE) END",
    "power_kw": "CASE WHEN v <> 4 THEN CAST(kw AS DOUBLE) END",
    "power_ps": "CASE WHEN v <> 5 THEN CAST(ps AS DOUBLE) END",
    "first_registration_year": "CASE WHEN v <> 1 THEN CAST(yr AS BIGINT) END",
    "first_registration_month": "CASE WHEN v <> 1 THEN CAST(mon AS BIGINT) END",
    "co2_g_km": "CASE WHEN v <> 0 THEN CAST(co2 AS DOUBLE) END",
    "displacement_cc": "CAST(ccm AS DOUBLE)",
    "borrowing_rate_pct": "CAST(concat(CAST(CAST(floor(rate / 100) AS BIGINT) AS STRING), '.', "
    "lpad(CAST(rate % 100 AS STRING), 2, '0')) AS DOUBLE)",
    "duration_months": "CAST(months AS BIGINT)",
}

# White space as the cleaner sees it, for a regex engine without Unicode classes.
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANKS}', ' ', 'g'))"


def present_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND trim({x}) NOT IN ('', 'nan', 'None', 'NaN', '<NA>'))"
