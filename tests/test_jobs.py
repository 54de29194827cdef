"""Sources, sinks, whole jobs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.operators import state
from lotwise.plans import reprocess
from lotwise.site import DEFAULT_SITE
from lotwise.sources import records, sinks
from lotwise.streaming import events


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")


def shard(folder, vendors=(), urls=()):
    for v in vendors:
        put(folder, f"raw/vendors/{v}.json", {"haendler_id": v})
    for i, u in enumerate(urls):
        put(folder, f"raw/vehicles/{i}.json", {"url": u})
    return str(folder)


def test_per_file_shards(spark, tmp_path):
    a = shard(tmp_path / "a", ["C0000001", "C0000003"], ["http://A", "http://C"])
    b = shard(tmp_path / "b", ["C0000002", "C0000004"], ["http://B", "http://D"])
    d = shard(tmp_path / "d", ["C0000001"], ["http://A"])
    out = reprocess.merge_runs(spark, [a, b], str(tmp_path / "o1"))
    assert (out["vendors_raw"], out["cars_raw"], out["skipped"]) == (4, 4, 0)
    out = reprocess.merge_runs(spark, [a, d], str(tmp_path / "o2"))
    assert (out["vendors_raw"], out["cars_raw"]) == (2, 2)


def test_list_and_keyed_shards(spark, tmp_path):
    put(tmp_path / "l1", "raw/vendors_raw.json", [{"haendler_id": "C01"}, {"haendler_id": "C02"}])
    put(tmp_path / "l1", "raw/cars_raw.json", [{"url": "U01"}, {"url": "U02"}, {"x": 1}])
    put(tmp_path / "l2", "raw/vendors_raw.json", [{"Händler ID": "C02"}, {"vendor_id": "C03"}])
    put(tmp_path / "l2", "raw/vehicles_raw.json", [{"Vehicle_URL": "U02"}, {"id": 7}])
    out = reprocess.merge_runs(spark, [str(tmp_path / "l1"), str(tmp_path / "l2")], str(tmp_path / "o"))
    assert (out["vendors_raw"], out["cars_raw"], out["skipped"]) == (3, 3, 1)
    put(tmp_path / "k", "raw/vendors_raw.json", {"V1": {"haendler_id": "V1"}, "V2": {"name": "x"}})
    put(tmp_path / "k", "raw/cars_raw.json", {"U1": {"url": "U1"}, "U2": {"Markes": "y"}})
    out = reprocess.merge_runs(spark, [str(tmp_path / "k")], str(tmp_path / "o3"))
    assert (out["vendors_raw"], out["cars_raw"]) == (2, 2)
    keys = {r["merge_key"] for r in spark.read.parquet(str(tmp_path / "o3/raw/cars_raw.parquet")).collect()}
    assert keys == {"U1", "U2"}


def test_bad_files_are_reported_and_empty_runs_fail(spark, tmp_path):
    put(tmp_path / "b", "raw/vendors_raw.json", '"text"')
    put(tmp_path / "b", "raw/cars_raw.json", "{broken")
    _rows, bad = records.read_runs(spark, [str(tmp_path / "b")])
    assert bad.count() == 2
    with pytest.raises(ValueError):
        reprocess.merge_runs(spark, [str(tmp_path / "b")], str(tmp_path / "o"))


def test_strict_list_reader(spark, tmp_path):
    put(tmp_path, "ok.json", [{"Preis": "1 €"}, 5])
    assert [r["Preis"] for r in records.read_json_list(spark, str(tmp_path / "ok.json"), ["Preis"]).collect()] == ["1 €"]
    put(tmp_path, "no.json", {"a": 1})
    with pytest.raises(Exception, match="expected a JSON list"):
        records.read_json_list(spark, str(tmp_path / "no.json")).collect()


def test_reprocess_writes_a_valid_bundle(spark, tmp_path):
    vendors = [{"Händler ID": "C0000001", "Händlername": "A", DEFAULT_SITE.link_field: "/a", "Anzahl der Fahrzeuge": "7"}]
    cars = [
        {"Händler ID": "C0000001", "Markes": "BMW", "Fahrzeugtyp": "Kombi", "Preis": f"{i}.000 €", "Kilometerstand": f"{i} km", "Vehicle_URL": f"u{i}"}
        for i in (3, 1, 2)
    ]
    put(tmp_path / "in", "vendors_raw.json", vendors)
    put(tmp_path / "in", "cars_raw.json", cars)
    run = spark.createDataFrame(
        [("r1", "2024-01-01 00:00:00", "2024-01-01 01:00:00", "bayern")],
        "run_id string, started_at string, finished_at string, state string",
    )
    tables = reprocess.reprocess(spark, str(tmp_path / "in"), str(tmp_path / "out"), run, "r1", "2024")
    assert list(tables) == fixed.REPORT_TABLES
    assert reprocess.valid(tables, expected_vehicles=3).first()["valid"]
    assert tables["Best_Deals"].count() == 3 and tables["Requirements_Compliance"].count() == 59
    samples = tables["Requirements_Compliance"].filter("dataset = 'vehicles' AND field_name = 'Kilometerstand'")
    assert [r["sample_present_value"] for r in samples.collect()] == ["3 km"]  # the first row's, not the smallest
    stored = sinks.write_records(tables["Vehicles"].limit(2), str(tmp_path / "cars"), fixed.VEHICLE_FIELDS)
    assert stored.columns[:56] == fixed.VEHICLE_FIELDS
    assert spark.read.option("header", True).csv(str(tmp_path / "cars.csv")).count() == 2


def test_caches_and_saved_pages(spark, tmp_path):
    put(tmp_path / "cache", "10000001.json", {"vehicle_id": "10000001", "parsed_fields": {"Farbe": "Rot"}})
    put(tmp_path / "cache", "10000002.json", {"Farbe": "Blau"})
    put(tmp_path / "html", "10000003.html", "<dl><dt>Farbe</dt><dd>Grün</dd></dl>")
    put(tmp_path / "html", "10000003.htm", "<dl><dt>Farbe</dt><dd>alt</dd></dl>")
    cache = records.read_cached_json(spark, str(tmp_path / "cache"), fixed.ENRICHMENT_FIELDS)
    pages = records.read_saved_pages(spark, str(tmp_path / "html"))
    cars = spark.createDataFrame(
        [(i, f"/fahrzeuge/details.html?id=1000000{i}", "") for i in range(1, 5)], "ord int, Vehicle_URL string, Farbe string"
    )
    done = reprocess.enrich_offline(spark, cars, cache, pages, "ord")
    got = {r["ord"]: (r["Farbe"], r["detail_data_source"]) for r in done.collect()}
    assert got == {1: ("Rot", "cache"), 2: ("Blau", "cache"), 3: ("Grün", "manual-html"), 4: ("", None)}
    sinks.append_page_cache(
        spark.createDataFrame([("1", "a", "t1"), ("1", "b", "t2")], "vehicle_id string, Farbe string, cached_at_utc string"),
        str(tmp_path / "pc"),
    )
    assert records.read_page_cache(spark, str(tmp_path / "pc")).first()["Farbe"] == "b"


def test_checkpoints_and_manifest(spark, tmp_path):
    store = sinks.Checkpoints(spark, str(tmp_path / "cp"))
    assert store.load("dealers") is None and not store.exists("dealers")
    store.save("dealers", spark.range(3))
    store.save("dealers", store.load("dealers").filter("id > 0"))
    assert store.load("dealers").count() == 2
    store.add_completed("done", spark.createDataFrame([("a",), ("a",)], "id string"))
    assert store.completed("done", "id string").count() == 1
    facts = {"run_id": "r", "shard_index": 0, "shard_count": 4, "max_vendors": None, "max_cars_per_vendor": 3, "config_summary": {"a": 1}}
    sinks.append_manifest(spark, str(tmp_path / "m"), facts)
    assert spark.read.parquet(str(tmp_path / "m")).first()["shard_count"] == 4


def _events(spark):
    rows = [
        (1, "vehicle_processing", "u1", "r1", None, None, None),
        (2, "vehicle_done", "u1", "r1", "C1", "{}", None),
        (3, "vehicle_processing", "u2", "r1", None, None, None),
        (4, "vehicle_failed", "u2", "r1", None, None, "HTTP 403"),
        (5, "error", "u3", "r1", None, None, "x"),
        (6, "vehicle_done", "u1", "r1", "C1", '{"v":2}', None),
    ]
    base = spark.createDataFrame(rows, "seq long, kind string, url string, run_id string, haendler_id string, payload string, error string")
    return base.withColumns(
        {"stage": F.lit(None).cast("string"), "status_code": F.lit(None).cast("int"), "error_type": F.lit(""), "ts": F.col("seq").cast("string")}
    )


def test_stream_equals_batch_and_can_run_again(spark, tmp_path):
    source = tmp_path / "events"
    all_events = _events(spark)
    for lo, hi in ((1, 3), (4, 6)):
        all_events.filter(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(source))
    stream = events.read_events(spark, str(source), per_trigger=1)
    events.write_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "r1", "now").awaitTermination()
    got = events.load_state(spark, str(tmp_path / "state"))
    assert [(r["vehicle_url"], r["data_json"]) for r in got["vehicles"].collect()] == [("u1", '{"v":2}')]
    assert sorted((r["stage"], r["url"]) for r in got["errors"].collect()) == [("pipeline", "u3"), ("vehicle", "u2")]


def test_events_respect_the_run(spark):
    jobs = spark.createDataFrame(
        [("u1", "r1", "v", "C1", "", "", "queued", 0, None, "t", 1), ("u2", "r9", "v", "C1", "", "", "queued", 0, None, "t", 2)],
        state.JOB_STATE,
    )
    kind = F.replace(F.col("kind"), F.lit("vehicle_"), F.lit(""))
    changes = _events(spark).withColumns({"kind": kind, "vehicle_url": F.col("url")})
    got = {r["vehicle_url"]: (r["status"], r["attempts"]) for r in state.apply_job_events(jobs, changes).collect()}
    assert got == {"u1": ("done", 1), "u2": ("queued", 0)}


def test_registered_queries_have_oracles():
    import __spark_entry__ as entry
    from lotwise.queries import ORACLES, QUERIES

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles) and set(oracles) <= set(queries)
    assert len(QUERIES) > 130 and sorted(set(QUERIES) - set(ORACLES)) == ["listing_records"]
