"""Queries over summaries, scores, coverage, compliance and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.operators import audit, clean, coverage, report, validate
from lotwise.operators.classify import classify_vehicles
from lotwise.operators.durable import store
from lotwise.plans import reprocess
from lotwise.queries.base import BASE, EXPECTED, LISTINGS, listings, pick, present_sql, query, run, s, table
from lotwise.queries.q_dedupe import _ERRORS, _NORMAL_ERRORS
from lotwise.site import DEFAULT_SITE

LINK = DEFAULT_SITE.link_field

# -- inputs ----------------------------------------------------------------------------

_VENDORS = """
SELECT s_suppkey, concat('S', CAST(s_suppkey AS STRING)) AS hid, s_name, CAST(s_nationkey AS STRING) AS plz,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_suppkey * 7 % 900 AS STRING) END AS declared
FROM supplier
"""


def vendors(spark, sf_dir):
    """Suppliers as raw vendor records."""
    rows = run(spark, sf_dir, _VENDORS)
    return rows.select(
        F.col("hid").alias("Händler ID"), F.col("s_name").alias("Händlername"), F.col("plz").alias("PLZ"),
        F.concat(F.lit("/v"), F.col("hid")).alias(LINK), F.col("declared").alias(fixed.VENDOR_COUNT_FIELD),
    )


def raw_cars(spark, sf_dir):
    """Rendered listings as raw vehicle records with their vendor."""
    rows = listings(spark, sf_dir, "l_suppkey")
    return rows.withColumn(
        "Händler ID", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    ).drop("l_suppkey")


def cars(spark, sf_dir):
    """The same, cleaned; the row key stands in for the URL, which repeats."""
    rows = clean.clean_vehicles(raw_cars(spark, sf_dir), compose=False)
    return rows.withColumn("Vehicle_URL", F.col("lkey"))


def scored_cars(spark, sf_dir):
    """The columns that scores read, stored once: bounds and scores both scan them."""
    metrics = dict.fromkeys(m.source for m in [*report.DEAL_METRICS, *report.EFFICIENCY_METRICS])
    return store(cars(spark, sf_dir).select("Vehicle_URL", *metrics))


_CARS = f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in EXPECTED.items())} FROM ({LISTINGS})"

# -- shares and summaries -------------------------------------------------------------------


@query(
    "value_share_brand",
    "SELECT p_brand AS brand, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM part GROUP BY p_brand",
)
def _(spark, sf_dir):
    done = report.value_share(table(spark, sf_dir, "part").select("p_brand"), "p_brand", "brand")
    return done.withColumnsRenamed({"Count": "count", "Share": "share"})


@query(
    "value_share_listing",
    f"SELECT coalesce(nullif(brand, ''), 'Andere') AS manufacturer, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM ({BASE}) GROUP BY 1",
)
def _(spark, sf_dir):
    done = report.value_share(run(spark, sf_dir, BASE).select("brand"), "brand", "manufacturer")
    return done.withColumnsRenamed({"Count": "count", "Share": "share"})


@query(
    "vendor_summary",
    f"""
SELECT hid, s_name AS name, plz, coalesce(CAST(nullif(declared, '') AS DOUBLE), n) AS total, n AS scraped
FROM (SELECT v.*, count(l_orderkey) AS n FROM ({_VENDORS}) v LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
""",
)
def _(spark, sf_dir):
    done = report.vendor_summary(vendors(spark, sf_dir), raw_cars(spark, sf_dir).select("Händler ID"))
    return done.select(
        F.col("Händler ID").alias("hid"), F.col("Händlername").alias("name"), F.col("PLZ").alias("plz"),
        F.col("Total_Vehicle_Count").alias("total"), F.col("Scraped_Vehicle_Count").alias("scraped"),
    )


@query(
    "maker_by_category",
    "SELECT p_brand AS manufacturer, p_type AS category, count(*) AS count FROM part GROUP BY 1, 2",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("Markes"), F.col("p_type").alias("vehicle_category"))
    done = report.category_by_manufacturer(rows)
    return done.select(*[F.col(c).alias(c.lower()) for c in done.columns])


@query(
    "classification_summary",
    """
SELECT 'p_brand' AS classification_field, p_brand AS value, count(*) AS count FROM part GROUP BY 2
UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
""",
)
def _(spark, sf_dir):
    return report.classification_summary(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


# -- scores ----------------------------------------------------------------------------------

_DEAL = [
    ("price_eur", True), ("mileage_km", True), ("first_registration_year", False), ("price_per_kw", True), ("co2_g_km", True),
]
_EFFICIENT = [("co2_g_km", True), ("mileage_km", True), ("price_eur", True), ("first_registration_year", False)]


def _scored(metrics) -> str:
    bounds = ", ".join(f"min({m}) AS lo{i}, max({m}) AS hi{i}" for i, (m, _) in enumerate(metrics))
    parts = []
    for i, (m, lower) in enumerate(metrics):
        x = f"CASE WHEN hi{i} = lo{i} THEN 0.5 ELSE ({m} - lo{i}) / (hi{i} - lo{i}) END"
        parts.append(f"CASE WHEN {m} IS NOT NULL THEN {x if lower else f'1.0 - {x}'} END AS s{i}")
    n = len(metrics)
    total = " + ".join(f"coalesce(s{i}, 0.0)" for i in range(n))
    count = " + ".join(f"(s{i} IS NOT NULL)::INT" for i in range(n))
    return f"""
(WITH c AS (SELECT lkey, price_eur, mileage_km, CAST(first_registration_year AS DOUBLE) AS first_registration_year, co2_g_km, price_eur / power_kw AS price_per_kw FROM ({_CARS})),
b AS (SELECT {bounds} FROM c), p AS (SELECT c.*, {', '.join(parts)} FROM c, b)
SELECT *, {count} AS metric_count, ({total}) / ({count}) AS score FROM p)"""


def _ranked(metrics, order: str) -> str:
    return f"""
SELECT lkey, round(score, 9) AS score, CAST(metric_count AS INTEGER) AS metric_count, round(metric_count / {len(metrics)}.0, 2) AS confidence
FROM {_scored(metrics)} WHERE metric_count >= 2 ORDER BY score {order}, lkey LIMIT 20"""


def _top(df, score, metrics):
    return df.select(
        F.col("Vehicle_URL").alias("lkey"), F.round(score, 9).alias("score"), F.col("Metric_Count").alias("metric_count"),
        F.col("score_confidence").alias("confidence"),
    )


@query("deal_top20", _ranked(_DEAL, "ASC"))
def _(spark, sf_dir):
    return _top(report.best_deals(scored_cars(spark, sf_dir)), "Deal_Score", _DEAL)


@query("deal_bottom20", _ranked(_DEAL, "DESC"))
def _(spark, sf_dir):
    return _top(report.worst_deals(scored_cars(spark, sf_dir)), "Deal_Score", _DEAL)


@query("efficient_top20", _ranked(_EFFICIENT, "ASC"))
def _(spark, sf_dir):
    return _top(report.efficient_vehicles(scored_cars(spark, sf_dir)), "Efficiency_Score", _EFFICIENT)


@query(
    "scores",
    f"SELECT lkey, round(s0, 9) AS price_score, round(s1, 9) AS mileage_score, round(s2, 9) AS age_score, round(s4, 9) AS co2_score, CAST(metric_count AS INTEGER) AS metric_count FROM {_scored(_DEAL)}",
)
def _(spark, sf_dir):
    done = report.with_scores(scored_cars(spark, sf_dir), report.DEAL_METRICS)
    return done.select(
        F.col("Vehicle_URL").alias("lkey"),
        *[F.round(c, 9).alias(c) for c in ("price_score", "mileage_score", "age_score", "co2_score")],
        F.col("Metric_Count").alias("metric_count"),
    )


# -- coverage -------------------------------------------------------------------------------------

_FIELDS = {"preis": "Preis", "kilometer": "Kilometerstand", "ez": "Erstzulassung", "co2_text": "CO₂-Emissionen", "brand": "Markes", "hubraum": "Hubraum"}


def _coverage_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{new}' AS field, count(*) FILTER (WHERE {present_sql(old)}) AS non_empty_count, count(*) AS total_count FROM ({source})"
        for old, new in _FIELDS.items()
    ) + f" UNION ALL SELECT 'Bank', 0, count(*) FROM ({source})"


_COVERAGE = f"SELECT *, round(non_empty_count / total_count * 100, 2) AS coverage_pct FROM ({_coverage_sql(LISTINGS)})"


def _coverage(spark, sf_dir):
    return coverage.field_coverage(listings(spark, sf_dir), [*_FIELDS.values(), "Bank"])


@query("field_coverage", _COVERAGE)
def _(spark, sf_dir):
    return _coverage(spark, sf_dir).drop("ord")


@query(
    "label_coverage",
    "SELECT 'quality' AS field, count(quality) AS non_empty_count, count(*) AS total_count, round(count(quality) / count(*) * 100, 2) AS coverage_pct FROM documents LEFT JOIN labels USING (doc_id) "
    "UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang <> ''), count(*), round(count(*) FILTER (WHERE lang <> '') / count(*) * 100, 2) FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage.field_coverage(rows, ["quality", "lang"]).drop("ord")


@query(
    "coverage_samples",
    f"SELECT 'Preis' AS field, arg_min(preis, lkey) FILTER (WHERE {present_sql('preis')}) AS sample FROM ({LISTINGS}) "
    f"UNION ALL SELECT 'Erstzulassung', arg_min(ez, lkey) FILTER (WHERE {present_sql('ez')}) FROM ({LISTINGS}) UNION ALL SELECT 'Bank', ''",
)
def _(spark, sf_dir):
    done = coverage.field_coverage(listings(spark, sf_dir), ["Preis", "Erstzulassung", "Bank"], samples=True, order="lkey")
    return done.select("field", "sample")


_GROUPS = {"basic": ["Preis", "Kilometerstand", "Erstzulassung", "Markes"], "technical": ["CO₂-Emissionen", "Hubraum", "Getriebe"]}


@query(
    "group_coverage",
    f"""
WITH c AS ({_COVERAGE})
SELECT g AS "group", CAST(sum(non_empty_count) AS BIGINT) AS present, max(total_count) * n AS total, round(sum(non_empty_count) / (max(total_count) * n) * 100, 2) AS pct
FROM (SELECT *, CASE WHEN field IN ('Preis', 'Kilometerstand', 'Erstzulassung', 'Markes') THEN 'basic' WHEN field IN ('CO₂-Emissionen', 'Hubraum') THEN 'technical' END AS g,
  CASE WHEN field IN ('Preis', 'Kilometerstand', 'Erstzulassung', 'Markes') THEN 4 ELSE 3 END AS n FROM c) WHERE g IS NOT NULL GROUP BY g, n
""",
)
def _(spark, sf_dir):
    return coverage.group_coverage(_coverage(spark, sf_dir), _GROUPS)


def _present_count(cols, source):
    return " + ".join(f"count(*) FILTER (WHERE {present_sql(c)})" for c in cols) if cols else "0"


_REQUIRED = f"""
WITH c AS (SELECT count(*) AS n, {_present_count(['brand', 'model', 'vtype', 'ez', 'kilometer', 'preis', 'leistung'], 0)} + count(*) AS basic,
  {_present_count(['co2_text', 'hubraum'], 0)} AS technical, {_present_count(['zins', 'laufzeit'], 0)} AS financing FROM ({LISTINGS})),
v AS (SELECT count(*) AS n, 4 * count(*) + count(*) FILTER (WHERE declared <> '') AS present FROM ({_VENDORS})),
g AS (SELECT 'vendor_required_fields_coverage_pct' AS "group", present, n * 15 AS total FROM v
  UNION ALL SELECT 'vehicle_basic_fields_coverage_pct', basic, n * 12 FROM c
  UNION ALL SELECT 'vehicle_technical_fields_coverage_pct', technical, n * 10 FROM c
  UNION ALL SELECT 'financing_fields_coverage_pct', financing, n * 12 FROM c
  UNION ALL SELECT 'classification_fields_coverage_pct', n * 2, n * 2 FROM c)
SELECT "group", present, total, round(present / total * 100, 2) AS pct FROM g
UNION ALL SELECT 'final_required_fields_coverage_pct', CAST(sum(present) AS BIGINT), CAST(sum(total) AS BIGINT), round(sum(present) / sum(total) * 100, 2) FROM g
"""


@query("required_coverage", _REQUIRED)
def _(spark, sf_dir):
    rows = classify_vehicles(raw_cars(spark, sf_dir))
    return coverage.required_coverage(vendors(spark, sf_dir), rows)


_VENDOR_FIELDS = {"hid": "Händler ID", "s_name": "Händlername", "plz": "PLZ", "declared": fixed.VENDOR_COUNT_FIELD}
_VENDOR_COVERAGE = " UNION ALL ".join(
    f"SELECT round(count(*) FILTER (WHERE {present_sql(old)}) / count(*) * 100, 2) AS coverage_pct FROM ({_VENDORS})" for old in _VENDOR_FIELDS
)


@query(
    "coverage_report",
    f"""
WITH c AS ({_COVERAGE})
SELECT 'vendors' AS dataset, round(avg(coverage_pct), 1) AS mean_pct, NULL AS low_fields FROM ({_VENDOR_COVERAGE})
UNION ALL SELECT 'vehicles' AS dataset, round(avg(coverage_pct), 1) AS mean_pct, (SELECT string_agg(concat(field, ' (', printf('%.1f', coverage_pct), '%)'), ', ' ORDER BY field) FROM c
  WHERE field IN ('CO₂-Emissionen', 'Baureihe') AND coverage_pct < 90) AS low_fields FROM c
""",
)
def _(spark, sf_dir):
    sellers = coverage.field_coverage(vendors(spark, sf_dir), list(_VENDOR_FIELDS.values()))
    both = coverage.coverage_table(sellers, _coverage(spark, sf_dir))
    low = coverage.low_coverage_fields(both, below=90.0).withColumnRenamed("fields", "low_fields")
    return coverage.mean_coverage(both).join(low.withColumn("dataset", F.lit("vehicles")), "dataset", "left")


# -- compliance -------------------------------------------------------------------------------------

_STATUS = (
    "CASE WHEN NOT col THEN 'missing' WHEN pct = 0 THEN 'schema_only' WHEN pct < 50 THEN 'weak' WHEN pct < 85 THEN 'partially_satisfied' ELSE 'satisfied' END"
)


@query(
    "compliance_status",
    f"""
WITH c AS ({_COVERAGE}),
r(place, field) AS (VALUES (18, 'Markes'), (23, 'Erstzulassung'), (24, 'Kilometerstand'), (26, 'CO₂-Emissionen'), (27, 'Preis'), (34, 'Hubraum'), (38, 'Bank')),
x AS (SELECT place, r.field, coalesce(coverage_pct, 0.0) AS pct, r.field <> 'Bank' AS col, total_count - non_empty_count AS missing FROM r JOIN c ON r.field = c.field),
y AS (SELECT *, {_STATUS} AS status FROM x)
SELECT field AS field_name, pct AS coverage, missing AS missing_count, status,
  CASE WHEN status IN ('missing', 'schema_only') THEN 'high' WHEN status = 'weak' THEN CASE WHEN field = 'CO₂-Emissionen' THEN 'high' ELSE 'medium' END
       WHEN status = 'partially_satisfied' THEN 'medium' ELSE 'low' END AS risk
FROM y
""",
)
def _(spark, sf_dir):
    done = coverage.field_compliance(vendors(spark, sf_dir), listings(spark, sf_dir))
    wanted = [*_FIELDS.values(), "Bank"]
    return done.filter(F.col("field_name").isin(wanted)).select(
        "field_name", F.col("current_coverage_pct").alias("coverage"), "missing_count", "status",
        F.col("risk_level").alias("risk"),
    )


@query(
    "compliance_rows",
    "SELECT dataset, n FROM (VALUES ('vendors', 15), ('vehicles', 22), ('financing', 12), ('classification', 2), ('dashboard', 6), ('source_audit', 1), ('detail_strategy', 1)) t(dataset, m), "
    "LATERAL (SELECT CAST(m AS BIGINT) AS n WHERE (SELECT count(*) FROM supplier) > 0)",
)
def _(spark, sf_dir):
    rows = cars(spark, sf_dir)
    tables = {
        "vendor_summary": report.vendor_summary(vendors(spark, sf_dir), rows),
        "manufacturer_summary": report.value_share(rows, "Markes", "Manufacturer"),
        "category_manufacturer_summary": report.value_share(rows, "Fahrzeugtyp", "Category"),
        "best_deals": rows.select("lkey"), "worst_deals": rows.select("lkey"), "efficient_vehicles": rows.select("lkey"),
    }
    summary = spark.createDataFrame([("source_audit_completed", "true")], "metric string, value string")
    done = coverage.compliance_table(vendors(spark, sf_dir), rows, tables, summary)
    return done.groupBy("dataset").agg(F.count("*").alias("n"))


# -- run summary -----------------------------------------------------------------------------------



@query(
    "error_counts",
    f"""
SELECT count(*) AS error_count, count(*) FILTER (WHERE d) AS detail_fetch_failed_count,
  count(*) FILTER (WHERE d AND (coalesce(status_code = 403, false) OR contains(error, 'HTTP 403'))) AS detail_fetch_403_count,
  count(*) FILTER (WHERE d AND (coalesce(status_code = 503, false) OR contains(error, 'HTTP 503'))) AS detail_fetch_503_count,
  count(*) FILTER (WHERE d AND (coalesce(status_code IN (403, 503), false) OR contains(error, 'HTTP 403') OR contains(error, 'HTTP 503'))) AS detail_site_blocked_or_503_count
FROM (SELECT *, event_id % 2 = 0 AS d FROM ({_NORMAL_ERRORS}))
""",
)
def _(spark, sf_dir):
    rows = _run_errors(spark, sf_dir)
    return coverage.error_counts(rows).drop("headless_blocked_count", "browser_403_count")


def _run_errors(spark, sf_dir):
    from lotwise.operators import merge

    rows = merge.normalize_errors(run(spark, sf_dir, _ERRORS), "r9", F.lit("2024"))
    stage = F.when(F.col("event_id") % 2 == 0, F.lit("vehicle_detail_fetch_failed")).otherwise(F.lit("other"))
    return rows.withColumns({"stage": stage, "type": stage})


@query(
    "run_summary",
    f"""
SELECT CAST(count(*) AS BIGINT) AS extracted_vehicle_count, count(*) FILTER (WHERE v < 2) AS listing_fallback_used_count,
  (SELECT count(*) FROM supplier) AS processed_vendor_count, (SELECT count(*) FROM events) AS error_count,
  7200.0::DOUBLE AS duration_seconds, round(7200.0 / count(*), 2) AS avg_seconds_per_vehicle, round(count(*) / 7200.0 * 3600, 2) AS vehicles_per_hour,
  round(20000.0 / (count(*) / 7200.0 * 3600), 2) AS estimated_hours_for_20000_vehicles, 'Nordrhein-Westfalen' AS target_state,
  (SELECT pct FROM ({_REQUIRED}) WHERE "group" = 'final_required_fields_coverage_pct') AS final_pct
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = classify_vehicles(listings(spark, sf_dir, "v", "l_suppkey"))
    rows = rows.withColumns(
        {
            "Händler ID": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
            "vehicle_data_source": F.when(F.col("v") == 0, F.lit("listing_fallback"))
            .when(F.col("v") == 1, F.lit("listing_payload"))
            .otherwise(F.lit("detail_page")),
        }
    )
    one = spark.createDataFrame(
        [("r1", "2024-01-01 00:00:00", "2024-01-01 02:00:00", "nordrhein-westfalen")],
        "run_id string, started_at string, finished_at string, state string",
    )
    wide = coverage.run_summary(one, vendors(spark, sf_dir), rows, _run_errors(spark, sf_dir))
    return wide.select(
        "extracted_vehicle_count", "listing_fallback_used_count", "processed_vendor_count", "error_count", "duration_seconds",
        "avg_seconds_per_vehicle", "vehicles_per_hour", "estimated_hours_for_20000_vehicles", "target_state",
        F.col("final_required_fields_coverage_pct").alias("final_pct"),
    )


@query(
    "summary_long",
    "SELECT 'event_count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events UNION ALL SELECT 'user_count', CAST(count(DISTINCT user_id) AS VARCHAR) FROM events "
    "UNION ALL SELECT 'summary_size', '2'",
)
def _(spark, sf_dir):
    wide = table(spark, sf_dir, "events").agg(F.count("*").alias("event_count"), F.countDistinct("user_id").alias("user_count"))
    long = coverage.summary_long(wide)
    size = coverage.summary_map(long).select(F.lit("summary_size").alias("metric"), F.size("summary").cast("string").alias("value"))
    return long.select("metric", "value").unionByName(size)


# -- dashboard ----------------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    rows = run(spark, sf_dir, f"SELECT lkey, concat('S', {s('l_suppkey')}) AS hid, brand, vtype, model FROM ({BASE})").select(
        F.col("hid").alias("Händler ID"), F.col("brand").alias("Markes"), F.col("vtype").alias("vehicle_category"),
        F.col("model").alias("Models"), F.col("lkey").alias("Vehicle_URL"),
    )
    return {
        "vendor_summary": report.vendor_summary(vendors(spark, sf_dir), rows),
        "manufacturer_summary": report.value_share(rows, "Markes", "Manufacturer"),
        "category_summary": report.value_share(rows, "vehicle_category", "Category"),
        "category_manufacturer_summary": report.category_by_manufacturer(rows),
    }


_VS = f"""(SELECT s_name AS name, coalesce(CAST(nullif(declared, '') AS DOUBLE), n) AS total, n FROM (SELECT v.*, count(l_orderkey) AS n FROM ({_VENDORS}) v LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL))"""
_MK = f"(SELECT coalesce(nullif(brand, ''), 'Andere') AS name, count(*) AS n FROM ({BASE}) GROUP BY 1)"
_CT = f"(SELECT coalesce(nullif(vtype, ''), 'Andere') AS name, count(*) AS n FROM ({BASE}) GROUP BY 1)"
_MC = f"(SELECT coalesce(nullif(brand, ''), 'Andere') AS name, coalesce(nullif(vtype, ''), 'Andere') AS part, count(*) AS n FROM ({BASE}) GROUP BY 1, 2)"


def _extract(section, source, order, n, value, part="NULL"):
    return (
        f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, name, CAST({part} AS VARCHAR) AS part, CAST({value} AS DOUBLE) AS count "
        f"FROM {source} QUALIFY place <= {n}"
    )


@query(
    "dashboard_extracts",
    " UNION ALL ".join(
        f"({x})"
        for x in (
            _extract("Top Vendors", _VS, "total DESC, n DESC, name", 10, "total"),
            _extract("Least Vendors", _VS, "total, name", 10, "total"),
            _extract("Top Manufacturers", _MK, "n DESC, name", 15, "n"),
            _extract("Vehicle Categories", _CT, "n DESC, name", 10, "n"),
            _extract("Most Listed Categories by Manufacturer", _MC, "name, n DESC, part", 20, "n", "part"),
        )
    ),
)
def _(spark, sf_dir):
    return report.dashboard_sheet(report.dashboard_extracts(_tables(spark, sf_dir)))


@query(
    "key_findings",
    f"""
SELECT (SELECT name FROM {_VS} ORDER BY total DESC, n DESC, name LIMIT 1) AS top_vendor, (SELECT name FROM {_VS} ORDER BY total, name LIMIT 1) AS least_vendor,
  (SELECT name FROM {_MK} ORDER BY n DESC, name LIMIT 1) AS high_manufacturer, (SELECT name FROM {_MK} ORDER BY n, name DESC LIMIT 1) AS low_manufacturer,
  (SELECT name FROM {_CT} ORDER BY n DESC, name LIMIT 1) AS top_category
""",
)
def _(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    tables["best_deals"] = run(spark, sf_dir, BASE).select(
        F.col("brand").alias("Markes"), F.col("model").alias("Models"), F.col("lkey").alias("Vehicle_URL"),
        F.col("price").cast("double").alias("Deal_Score"),
    )
    tables["efficient_vehicles"] = tables["best_deals"].withColumnRenamed("Deal_Score", "Efficiency_Score")
    return report.key_findings(tables).select("top_vendor", "least_vendor", "high_manufacturer", "low_manufacturer", "top_category")


# -- strategies ----------------------------------------------------------------------------------------

_TRIES = """
SELECT event_id, event_type AS strategy, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 200 END AS status_code,
       user_id % 5 = 0 AS edge_error, user_id % 7 = 0 AS timeout, event_id % 2 = 0 AS detail_loaded, value AS seconds,
       CASE WHEN event_type = 'view' THEN '110 g/km' WHEN event_type = 'click' THEN 'F30' ELSE '' END AS found
FROM events
"""


def _tries(spark, sf_dir):
    rows = run(spark, sf_dir, _TRIES)
    return rows.withColumn(
        "extracted",
        F.create_map(F.when(F.col("strategy") == "view", F.lit("CO₂-Emissionen")).otherwise(F.lit("Baureihe")), F.col("found")),
    )


_MATRIX = f"""
SELECT strategy, count(*) AS attempted_vehicles, count(*) FILTER (WHERE detail_loaded AND found <> '') AS detail_success_count,
  count(*) FILTER (WHERE NOT (detail_loaded AND found <> '')) AS detail_failed_count, count(*) FILTER (WHERE status_code = 403) AS http_403_count,
  count(*) FILTER (WHERE coalesce(status_code = 503, false) OR edge_error) AS http_503_edgesuite_count, count(*) FILTER (WHERE timeout) AS timeout_count,
  round(sum(seconds) / count(*), 2) AS avg_seconds_per_detail, CASE WHEN strategy IN ('view', 'click') THEN 1 ELSE 0 END AS fields_extracted_count,
  CASE strategy WHEN 'view' THEN 'CO₂-Emissionen' WHEN 'click' THEN 'Baureihe' ELSE '' END AS extracted_fields,
  CASE WHEN strategy IN ('view', 'click') THEN 'candidate' ELSE 'no_target_field_gain' END AS recommendation
FROM ({_TRIES}) GROUP BY strategy
"""


@query("strategy_matrix", _MATRIX)
def _(spark, sf_dir):
    return audit.strategy_matrix(_tries(spark, sf_dir)).drop("missing_target_fields")


@query(
    "best_strategy",
    f"SELECT strategy, concat('Use ', strategy, ' for missing target fields.') AS recommendation FROM ({_MATRIX}) WHERE fields_extracted_count > 0 ORDER BY fields_extracted_count DESC, avg_seconds_per_detail LIMIT 1",
)
def _(spark, sf_dir):
    return audit.best_strategy(audit.strategy_matrix(_tries(spark, sf_dir)))


_HITS = f"SELECT lkey, {pick('l_orderkey', ['CO₂-Emissionen', 'Baureihe', 'Farbe'])} AS field, co2_text, model, l_orderkey FROM ({LISTINGS})"


@query(
    "target_evidence",
    f"""
SELECT field, count(*) AS keyword_hits_in_returned_sources, count(*) FILTER (WHERE field = 'Baureihe' OR co2_text <> '') > 0 AS parsed_from_listing_payload,
  field = 'Baureihe' AS parsed_from_detail_strategy,
  count(DISTINCT CASE WHEN field = 'Baureihe' THEN model ELSE nullif(co2_text, '') END) AS value_count
FROM ({_HITS}) WHERE field <> 'Farbe' GROUP BY field
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _HITS)
    value = F.when(F.col("field") == "CO₂-Emissionen", F.col("co2_text")).otherwise(F.col("model"))
    found = rows.select("field", value.alias("value"))
    evidence, _values = audit.target_evidence(rows, found, found.filter(F.col("field") == "Baureihe"))
    return evidence


# -- validation ------------------------------------------------------------------------------------------


@query(
    "validate_bundle",
    """
SELECT "check", subject, ok, detail FROM (
  SELECT 'rows' AS "check", 'Vehicles' AS subject, count(*) >= 1 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM lineitem
  UNION ALL SELECT 'rows', 'Vendors', false, CAST(count(*) AS VARCHAR) FROM supplier
  UNION ALL SELECT 'not_empty', 'Run_Summary', true, '' UNION ALL SELECT 'not_empty', 'Data_Coverage', true, '' UNION ALL SELECT 'not_empty', 'Requirements_Compliance', true, ''
  UNION ALL SELECT 'class_values', 'vehicle_category', false, 'unknown' UNION ALL SELECT 'class_values', 'manufacturer_origin', true, ''
  UNION ALL SELECT 'columns', 'Vendors', false, 'Standort, Städte, Bundesland, Land, Telephone Number, 2. Telephone Number, MobilTelefon, Fax Number, Email ID, Hauptseite'
  UNION ALL SELECT 'columns', 'Vehicles', true, '' UNION ALL SELECT 'columns', 'Vehicles classes', true, ''
  UNION ALL SELECT 'table', t, true, '' FROM (VALUES ('Vendors'), ('Run_Summary'), ('Data_Coverage'), ('Requirements_Compliance'), ('Dashboard'), ('Errors')) x(t)
  UNION ALL SELECT 'table', 'vehicles', true, 'Vehicles')
""",
)
def _(spark, sf_dir):
    from lotwise.operators.contract import ensure_columns

    rows = ensure_columns(classify_vehicles(listings(spark, sf_dir, "v")), fixed.VEHICLE_FIELDS)
    rows = rows.withColumn(
        "vehicle_category", F.when(F.col("v") == 0, F.lit(" Unknown ")).otherwise(F.col("vehicle_category"))
    )
    some = table(spark, sf_dir, "part")
    tables = {
        "Vendors": vendors(spark, sf_dir), "Vehicles": rows, "Run_Summary": some, "Data_Coverage": some,
        "Requirements_Compliance": some, "Dashboard": some, "Errors": some,
    }
    return validate.validate_report(tables, expected_vendors=3)


# -- the whole report ---------------------------------------------------------------------------------------


@query(
    "report_rows",
    """
SELECT 'Vendors' AS name, count(*) AS rows FROM supplier UNION ALL SELECT 'Vehicles', count(*) FROM lineitem
UNION ALL SELECT 'Best_Deals', 20 UNION ALL SELECT 'Efficient_Vehicles', 20 UNION ALL SELECT 'Vendor_Summary', count(*) FROM supplier
UNION ALL SELECT 'Requirements_Compliance', 59 UNION ALL SELECT 'Errors', count(*) FROM events
""",
)
def _(spark, sf_dir):
    one = spark.createDataFrame(
        [("r1", "2024-01-01 00:00:00", "2024-01-01 02:00:00", "bayern")],
        "run_id string, started_at string, finished_at string, state string",
    )
    tables = reprocess.report_tables(
        vendors(spark, sf_dir), raw_cars(spark, sf_dir), run(spark, sf_dir, _ERRORS), one, "r1", "2024"
    )
    parts = None
    for name in ("Vendors", "Vehicles", "Best_Deals", "Efficient_Vehicles", "Vendor_Summary", "Requirements_Compliance", "Errors"):
        part = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts
