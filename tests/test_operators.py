"""Operators on small tables, and properties that must hold for any order or split."""

import random

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.operators import clean, coverage, dedupe, enrich, merge, ordered, report, state, validate
from lotwise.operators.classify import classify_vehicles
from lotwise.operators.contract import ensure_columns
from lotwise.site import DEFAULT_SITE


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_contract_sizes():
    assert len(fixed.VEHICLE_FIELDS) == 56 and len(set(fixed.VEHICLE_FIELDS)) == 56
    assert (len(fixed.REQUIRED_FIELDS), len(fixed.BASIC_FIELDS), len(fixed.TECHNICAL_FIELDS)) == (22, 12, 10)
    assert len(DEFAULT_SITE.vendor_fields) == 15 and len(fixed.REPORT_TABLES) == 19
    assert len(coverage.requirements()) == 51 and len(fixed.ENRICHMENT_FIELDS) == 23


def test_clean_row(spark):
    row = {
        "Preis": "4.284 €", "Kilometerstand": "381.753 km", "Leistung": "75 kW (102 PS)", "Hubraum": "1.496 cm³",
        "Fester Sollzins p.a.": "5,83%", "Effektiver Jahreszins": "5,99%", "Gesamtzins": "1.413,72 €",
        "Laufzeit": "48 Monate", "Erstzulassung": "03/2024", "Bank": "Santander", "Financing": "99 €",
    }
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    got = clean.clean_vehicles(raw).first().asDict()
    assert (got["price_eur"], got["mileage_km"], got["power_kw"], got["power_ps"]) == (4284.0, 381753.0, 75.0, 102.0)
    assert (got["displacement_cc"], got["borrowing_rate_pct"], got["annual_interest_pct"]) == (1496.0, 5.83, 5.99)
    assert (got["total_interest_eur"], got["duration_months"]) == (1413.72, 48)
    assert (got["first_registration_month"], got["first_registration_year"], got["Financing_Available"]) == (3, 2024, "Yes")
    assert got["Finanzierung"] == "99 €" and list(got)[:56] == fixed.VEHICLE_FIELDS


def test_empty_input_keeps_the_schema(spark):
    empty = ensure_columns(spark.createDataFrame([], "Markes string"), fixed.VEHICLE_FIELDS)
    done = classify_vehicles(clean.clean_vehicles(empty))
    assert done.count() == 0 and "manufacturer_origin_rule" in done.columns


def test_scores_with_missing_values(spark):
    rows = spark.createDataFrame(
        [("a", 10.0, 5.0, 2020), ("b", 20.0, None, 2010), ("c", None, None, None)],
        "Vehicle_URL string, Preis_EUR double, Kilometerstand_km double, EZ_Jahr int",
    )
    rows = rows.withColumns({"Preis_pro_kW": F.lit(None).cast("double"), "CO2_gkm": F.lit(None).cast("double")})
    got = {r["Vehicle_URL"]: r["Deal_Score"] for r in report.best_deals(rows).collect()}
    # A constant metric scores one half; a row needs two metrics.
    assert got == {"a": (0.0 + 0.5 + 0.0) / 3, "b": 1.0}


def _left_fold(sightings):
    state_ = {}
    for s in sightings:
        s = {k: v for k, v in s.items() if v}
        if not state_:
            state_ = dict(s)
            continue
        merged = {**s, **state_}
        if sum(bool(v.strip()) for v in s.values()) > sum(bool(v.strip()) for v in state_.values()):
            merged = {**state_, **s}
        state_ = merged
    return state_


def test_fold_equals_the_left_fold_on_random_input(spark):
    rng = random.Random(7)
    fields = ["a", "b", "c", "d", "e"]
    data, expected = [], {}
    for key in range(40):
        sightings = []
        for o in range(rng.randint(1, 12)):
            s = {f: (f"{f}{key}.{o}" if rng.random() < 0.4 else rng.choice(["", None, "  "])) for f in fields}
            sightings.append(s)
            data.append((key, o, *s.values()))
        expected[key] = _left_fold(sightings)
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "k int, o int, " + ", ".join(f"{f} string" for f in fields)).repartition(7)
    got = {
        r["k"]: {f: r[f] for f in fields if r[f]}
        for r in merge.fold_sightings(rows, ["k"], "o", fields).collect()
    }
    assert got == {k: v for k, v in expected.items() if v}


def test_scan_matches_plain_loops_across_chunks(spark):
    rng = random.Random(3)
    data = [(o, "hot" if rng.random() < 0.7 else "cold", rng.random() < 0.6, rng.randint(0, 9)) for o in range(300)]
    rows = spark.createDataFrame(data, "o long, k string, hit boolean, n long").repartition(5)
    done = ordered.scan(rows, ["k"], "o", sums={"total": F.col("n")}, streaks={"streak": F.col("hit")}, width=16)
    got = {r["o"]: (r["total"], r["streak"]) for r in done.collect()}
    total, streak = {}, {}
    for o, k, hit, n in data:
        total[k] = total.get(k, 0) + n
        streak[k] = streak.get(k, 0) + 1 if hit else 0
        assert got[o] == (total[k], streak[k])


def test_scan_fills_chunks_when_order_numbers_are_sparse(spark):
    """Order numbers far apart: chunks of full width, so few totals meet in a window."""
    rows = spark.range(400).select(F.lit("hot").alias("k"), (F.col("id") * 10**9).alias("o")).repartition(5)
    chunks = ordered.chunked(rows, ["k"], "o", 50).groupBy("__chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [50] * 8
    done = ordered.scan(rows, ["k"], "o", sums={"n": F.lit(1)}, width=50)
    assert sorted((r["o"], r["n"]) for r in done.collect()) == [(i * 10**9, i + 1) for i in range(400)]


def test_global_rank_is_dense_and_sorted(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("x")).repartition(13)
    done = ordered.global_rank(rows, ["x"]).orderBy("rank").collect()
    assert [r["rank"] for r in done] == list(range(1, 5001))
    assert [r["x"] for r in done] == sorted(f"k{i}" for i in range(5000))


def test_vendor_ids_are_stable(spark):
    empty = spark.createDataFrame([], state.VENDOR_STATE)

    def dealers(*names):
        return spark.createDataFrame([(i, n, "{}") for i, n in enumerate(names)], "ord int, url string, dealer_json string")

    first = state.queue_vendors(empty, dealers("/beta", "/alpha"), "ord", "r1", "t")
    ids = {r["normalized_vendor_url"][-5:]: r["haendler_id"] for r in first.collect()}
    assert ids == {"ALPHA": "C0000001", "/BETA": "C0000002"}
    second = state.queue_vendors(first.drop("queued"), dealers("/alpha", "/gamma", "/beta"), "ord", "r2", "t")
    ids = {r["normalized_vendor_url"][-5:]: (r["haendler_id"], r["queued"]) for r in second.collect()}
    assert ids == {"ALPHA": ("C0000001", True), "/BETA": ("C0000002", True), "GAMMA": ("C0000003", True)}


def test_upsert_keeps_positions_and_keyless_rows(spark):
    old = spark.createDataFrame([(0, "a", "1"), (1, "", "2"), (2, "b", "3")], "ord int, url string, v string")
    new = spark.createDataFrame([(0, "b", "4"), (1, "c", "5"), (2, "", "6"), (3, "c", "7")], "ord int, url string, v string")
    done = dedupe.upsert_rows(old, new, "url", "ord").orderBy("position").collect()
    assert [r["v"] for r in done] == ["1", "2", "4", "7", "6"]


def test_dedupe_does_not_depend_on_order_or_copies(spark):
    rows = spark.createDataFrame(
        [(i, f"/d{i % 5}", "x" * (i % 3), "y" if i % 2 else "") for i in range(60)], "ord int, link string, a string, b string"
    )
    base = rows_of(dedupe.fullest_vendors(rows, "ord", link="link"))
    again = rows_of(dedupe.fullest_vendors(rows.union(rows).repartition(9), "ord", link="link"))
    assert base == again and len(base) == 5


def test_fill_only_merge_with_conflicts(spark):
    left = spark.createDataFrame(
        [(1, "10.000 €", "", "", None, "")],
        "id int, Preis string, Baureihe string, Ausstattungslinie string, Financing string, Finanzierung string",
    )
    right = spark.createDataFrame(
        [(1, "11.000 €", "F30", "Sport Line", "149 €")],
        "id int, Preis string, Baureihe string, Ausstattungslinie string, Financing string",
    )
    fields = ["Preis", "Baureihe", "Ausstattungslinie", "Financing"]
    got = merge.merge_detail(left, right, "id", fields, "cache", offline=True).first()
    assert got["Preis"] == "10.000 €" and got["filled_fields"] == fields[1:]
    assert got["conflicts"] == '{"Preis": {"detail": "11.000 €", "existing": "10.000 €"}}'
    assert got["Baureihe_source"] == "cache" and got["Preis_source"] is None


def test_method_chain_puts_the_cache_first():
    assert enrich.method_chain("manual_html, listing,cache,manual-html") == ["cache", "manual-html", "listing"]


def test_empty_page_guard(spark):
    pages = spark.createDataFrame(
        [("r", p, n) for p, n in enumerate([2, 0, 0, 1, 0, 0, 0, 5])], "run string, page long, new_count long"
    )
    kept = [r["page"] for r in ordered.stop_on_empty_pages(pages, "run", "page").orderBy("page").collect()]
    assert kept == [0, 1, 2, 3, 4, 5, 6]


def test_compliance_of_an_empty_field(spark):
    vehicles = ensure_columns(
        spark.createDataFrame([("BMW", "320")], "Markes string, Models string"), fixed.VEHICLE_FIELDS
    )
    vendors = ensure_columns(spark.createDataFrame([("C1",)], "`Händler ID` string"), DEFAULT_SITE.vendor_fields)
    got = {r["field_name"]: r for r in coverage.field_compliance(vendors, vehicles).collect()}
    assert (got["Baureihe"]["status"], got["Baureihe"]["risk_level"]) == ("schema_only", "high")
    assert got["Markes"]["status"] == "satisfied" and got["Markes"]["sample_present_value"] == "BMW"
    assert got["vehicle_category"]["status"] == "missing"


def test_error_counts_by_code_and_text(spark):
    rows = spark.createDataFrame(
        [("vehicle_detail_fetch_failed", 503, "final_status=HTTP 403")], "stage string, status_code int, error string"
    )
    got = coverage.error_counts(merge.normalize_errors(rows, "r", F.lit("t"))).first()
    assert (got["detail_fetch_403_count"], got["detail_fetch_503_count"]) == (1, 1)


def test_validation(spark):
    vendors = ensure_columns(spark.range(25).select(F.lit("C").alias("Händler ID")), DEFAULT_SITE.vendor_fields)
    vehicles = ensure_columns(
        spark.range(186).select(F.lit("PKW").alias("vehicle_category"), F.lit("Andere").alias("manufacturer_origin")),
        fixed.VEHICLE_FIELDS,
    )
    one = spark.range(1)
    tables = {"Vendors": vendors, "Vehicles": vehicles, **{n: one for n in fixed.REQUIRED_CONTROL_TABLES[1:]}}
    limits = {"expected_vendors": 25, "expected_vehicles": 186}
    assert all(r["ok"] for r in validate.validate_report(tables, **limits).collect())
    missing = {k: v for k, v in tables.items() if k != "Dashboard"}
    assert not all(r["ok"] for r in validate.validate_report(missing).collect())
    bad = {**tables, "Vehicles": vehicles.withColumn("vehicle_category", F.lit("Unknown"))}
    failed = [r["check"] for r in validate.validate_report(bad, **limits).collect() if not r["ok"]]
    assert failed == ["class_values"]


def test_cap_of_a_hot_group_limits_slices_before_the_group(spark):
    """Two window stages, slices first, each with Spark's early limit, give the first rows."""
    key = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.lit("cold")).alias("k")
    rows = spark.range(20_000).select(key, "id")
    got = ordered.cap_per_group(rows, ["k"], ["id"], 5, spread=8)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4, 9, 19, 29, 39, 49]
    limits = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "WindowGroupLimit" in line]
    assert any("__slice" in line and "Partial" in line for line in limits)
    assert any("__slice" not in line for line in limits)


def test_no_python_in_the_cleaning_projection(spark):
    raw = spark.createDataFrame([("1 €",)], "Preis string")
    plan = clean.clean_vehicles(raw, compose=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    composed = clean.clean_vehicles(raw)._jdf.queryExecution().executedPlan().toString()
    assert composed.count("EvalPython") == 1 and "Exchange" not in composed
