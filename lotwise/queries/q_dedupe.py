"""Queries over deduplication, merging, enrichment and record defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import dedupe, enrich, merge
from lotwise.operators.report import with_listing_counts
from lotwise.queries.base import BASE, LISTINGS, present_sql, query, run, s, table

_HOME = "https://home.marktplatz.example"

# Two spellings of every dealer link; three orders of a customer are one dealer.
_DEALERS = f"""
SELECT o_orderkey AS ord, concat(CASE WHEN o_orderkey % 2 = 0 THEN '/kunde' ELSE '{_HOME}/KUNDE' END, {s('o_custkey')}) AS url,
       o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS plz,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {s('o_orderkey % 100')} END AS city
FROM orders
"""
_DEALER_URL = f"concat('{_HOME}/KUNDE', o_custkey)"


@query(
    "dedupe_last",
    f"SELECT {_DEALER_URL} AS url, arg_max(o_orderpriority, o_orderkey) AS name, max(o_orderkey) AS ord FROM orders GROUP BY 1",
)
def _(spark, sf_dir):
    return dedupe.prepare_dealers(run(spark, sf_dir, _DEALERS), "ord").select("url", "name", "ord")


@query(
    "dealers_capped",
    f"SELECT {_DEALER_URL} AS url, max(o_orderkey) AS ord FROM orders GROUP BY 1 ORDER BY lower({_DEALER_URL}) LIMIT 25",
)
def _(spark, sf_dir):
    return dedupe.prepare_dealers(run(spark, sf_dir, _DEALERS), "ord", cap=25).select("url", "ord")


_SCORE = "(o_orderkey % 3 <> 0)::INT + (o_orderkey % 4 <> 0)::INT"


@query(
    "dedupe_fullest",
    f"SELECT {_DEALER_URL} AS link, min(o_orderkey) AS ord FROM (SELECT *, {_SCORE} AS sc, max({_SCORE}) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE sc = best GROUP BY 1",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DEALERS).withColumnRenamed("url", "link")
    return dedupe.fullest_vendors(rows, "ord", link="link").select("link", "ord")


@query(
    "dedupe_fullest_last",
    f"""
SELECT {_DEALER_URL} AS link, late, max(ord) AS ord FROM (
  SELECT *, max(sc * 2 + late) OVER (PARTITION BY o_custkey) AS best FROM (
    SELECT o_custkey, o_orderkey AS ord, o_orderkey % 2 AS late, {_SCORE} AS sc FROM orders))
WHERE sc * 2 + late = best GROUP BY 1, 2
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DEALERS).withColumnRenamed("url", "link")
    odd = F.col("ord") % 2
    merged = dedupe.merge_vendor_snapshots(rows.filter(odd == 0), rows.filter(odd == 1), "ord", link="link")
    return merged.select("link", (F.col("ord") % 2).alias("late"), "ord")


_EVENT_ROWS = """
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS k,
       event_type, CASE WHEN ts < timestamp '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS late
FROM events
"""


@query(
    "upsert_rows",
    f"""
WITH e AS ({_EVENT_ROWS}),
lo AS (SELECT k, max(event_id) AS last_old FROM e WHERE late = 0 AND k <> '' GROUP BY k),
fn AS (SELECT k, max(event_id) AS last_new, min(event_id) AS first_new FROM e WHERE late = 1 AND k <> '' GROUP BY k)
SELECT k, event_id, late, event_id AS place_ord, late AS place_late FROM e WHERE k = ''
UNION ALL SELECT e.k, event_id, late, event_id, 0 FROM e JOIN lo ON e.k = lo.k WHERE late = 0 AND event_id < last_old
UNION ALL SELECT k, coalesce(last_new, last_old), CASE WHEN last_new IS NULL THEN 0 ELSE 1 END,
  coalesce(last_old, first_new), CASE WHEN last_old IS NULL THEN 1 ELSE 0 END FROM lo FULL JOIN fn USING (k)
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _EVENT_ROWS).withColumns({"ord": F.col("event_id"), "src": F.col("late")})
    old = rows.filter(F.col("late") == 0).select("k", "event_id", "src", "ord")
    new = rows.filter(F.col("late") == 1).select("k", "event_id", "src", "ord")
    done = dedupe.upsert_rows(old, new, "k", "ord")
    return done.select(
        "k", "event_id", F.col("src").alias("late"), F.col("position.ord").alias("place_ord"),
        F.col("position.late").alias("place_late"),
    )


_RECORDS = """
SELECT CAST(event_id % 3 AS INT) AS run_ord, CAST(event_id % 2 AS INT) AS layout, 'f' AS file, CAST(event_id AS INT) AS pos, event_id,
       user_id, event_type FROM events
"""


@query(
    "shard_merge",
    f"""
SELECT merge_key, arg_min(event_id, run_ord * 1000000000 + layout * 100000000 + pos) AS event_id FROM (
  SELECT *, CASE event_type WHEN 'view' THEN concat('http://a/', user_id) WHEN 'click' THEN concat('http://a/', user_id)
     WHEN 'signup' THEN concat('id:', user_id) WHEN 'purchase' THEN concat('id:', user_id) END AS merge_key FROM ({_RECORDS}))
WHERE merge_key IS NOT NULL GROUP BY merge_key
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _RECORDS)
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    url = F.concat(F.lit("http://a/"), user)
    record = F.create_map(
        F.lit("url"), F.when(kind == "view", url),
        F.lit("Vehicle_URL"), F.when(kind == "click", url).otherwise(F.lit("")),
        F.lit("id"), F.when(kind == "signup", user),
        F.lit("Fahrzeug_ID"), F.when(kind == "purchase", user),
    )
    merged, _skipped = dedupe.merge_shards(
        rows.withColumn("record", record), dedupe.vehicle_key(F.col("record")), ["run_ord", "layout", "file", "pos"]
    )
    return merged.select("merge_key", "event_id")


@query(
    "shard_skipped",
    "SELECT event_id FROM events WHERE event_type = 'error'",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _RECORDS)
    hid = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    record = F.create_map(F.lit("haendler_id"), hid)
    _merged, skipped = dedupe.merge_shards(
        rows.withColumn("record", record), dedupe.vendor_key(F.col("record"), F.lit(True)),
        ["run_ord", "layout", "file", "pos"],
    )
    return skipped.select("event_id")


@query(
    "distinct_urls",
    f"""
SELECT lkey, CASE WHEN v = 2 THEN '' ELSE url END AS urls, CASE WHEN v = 2 THEN 0 ELSE 1 END AS n FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    url = F.when(F.col("v") == 2, F.lit("")).otherwise(F.col("url"))
    rows = rows.withColumn("u", dedupe.distinct_in_order(F.array(url, F.lit(None).cast("string"), url)))
    return rows.select("lkey", F.array_join("u", ",").alias("urls"), F.size("u").alias("n"))


@query(
    "first_seen_page",
    "SELECT user_id, event_type, min(event_id) AS first_page, count(*) AS seen FROM events GROUP BY user_id, event_type",
)
def _(spark, sf_dir):
    return dedupe.first_seen_page(
        table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"
    )


# -- folds and fills ---------------------------------------------------------------------

# Blank text fills a field but scores nothing.
_SIGHTINGS = """
SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 11 = 0 THEN '  ' ELSE '' END AS a,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) WHEN event_id % 7 = 0 THEN ' ' END AS b,
       CASE WHEN event_id % 5 = 0 THEN concat('c', CAST(event_id AS STRING)) END AS c,
       CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat('d', CAST(event_id % 7 AS STRING)) END AS d
FROM events
"""


def _left_fold(sightings: str, keys: str, fields: str) -> str:
    """The fold step by step: one recursion per sighting of a key."""
    names = fields.split()
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM f.{k}" for k in keys.split(", "))

    def score(row: str) -> str:
        return " + ".join(f"coalesce(trim({row}.{n}) <> '', false)::INT" for n in names)

    blank = ", ".join(f"nullif({n}, '') AS {n}" for n in names)
    step = ", ".join(f"CASE WHEN {score('s')} > {score('f')} THEN coalesce(s.{n}, f.{n}) ELSE coalesce(f.{n}, s.{n}) END AS {n}" for n in names)
    own = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""
WITH RECURSIVE s AS (SELECT {keys}, {blank}, row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS rn,
    count(*) OVER (PARTITION BY {keys}) AS n_rows FROM ({sightings})),
fold AS (
  SELECT {keys}, rn, n_rows, {', '.join(names)} FROM s WHERE rn = 1
  UNION ALL
  SELECT {own}, s.rn, f.n_rows, {step} FROM fold f JOIN s ON {on} AND s.rn = f.rn + 1)
SELECT {keys}, {', '.join(names)} FROM fold WHERE rn = n_rows
"""


@query("fold_merge", f"SELECT * FROM ({_left_fold(_SIGHTINGS, 'user_id', 'a b c d')}) WHERE coalesce(a, b, c, d) IS NOT NULL")
def _(spark, sf_dir):
    return merge.fold_sightings(run(spark, sf_dir, _SIGHTINGS), ["user_id"], "event_id", ["a", "b", "c", "d"])


# Entries with a link, and entries that only their identity fields tell apart.
_ENTRIES = """
SELECT user_id % 20 AS vendor, event_id,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', CAST(100000 + user_id AS STRING)) END AS "Vehicle_URL",
       concat(' M', CAST(user_id % 3 AS STRING), ' ') AS "Markes", event_type AS "Models", '1' AS "Preis",
       CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '5 km' END AS "Kilometerstand", '' AS "Erstzulassung",
       CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 4 = 0 THEN concat('x', CAST(event_id AS STRING)) ELSE '' END AS farbe
FROM events
"""
_ENTRY_FIELDS = ["Vehicle_URL", "Markes", "Models", "Preis", "Kilometerstand", "Erstzulassung", "farbe"]
_KEYED = f"""
SELECT *, CASE WHEN "Vehicle_URL" <> '' THEN "Vehicle_URL" ELSE concat_ws('|', trim("Markes"), trim("Models"), trim("Preis"), trim("Kilometerstand"), '') END AS entry_key FROM ({_ENTRIES})
"""


@query("category_fold", _left_fold(_KEYED, "vendor, entry_key", " ".join(_ENTRY_FIELDS)))
def _(spark, sf_dir):
    entries = run(spark, sf_dir, _ENTRIES.replace('"', "`"))
    return merge.category_fold(entries, "vendor", "event_id", _ENTRY_FIELDS)


_OLD = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS Preis,
       CASE WHEN o_orderkey % 4 = 0 THEN 'nan' ELSE {s('o_custkey')} END AS Baureihe,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '  A  B ' END AS Farbe
FROM orders
"""
_NEW = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' 1-URGENT ' ELSE '' END AS Preis, {s('o_custkey')} AS Baureihe, 'A B' AS Farbe
FROM orders WHERE o_orderstatus <> 'F'
"""
_PAIRED = f"SELECT o.*, n.Preis AS np, n.Baureihe AS nb, n.Farbe AS nf FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (o_orderkey)"


@query(
    "fill_merge",
    f"""
SELECT o_orderkey, coalesce(nullif(Preis, ''), nullif(np, ''), Preis) AS preis, coalesce(nullif(Baureihe, ''), nb) AS baureihe,
       coalesce(nullif(Farbe, ''), nf) AS farbe FROM ({_PAIRED})
""",
)
def _(spark, sf_dir):
    done = merge.fill_from(run(spark, sf_dir, _OLD), run(spark, sf_dir, _NEW), "o_orderkey", ["Preis", "Baureihe", "Farbe"])
    return done.select(
        "o_orderkey", F.col("Preis").alias("preis"), F.col("Baureihe").alias("baureihe"), F.col("Farbe").alias("farbe")
    )


@query(
    "fill_conflicts",
    f"""
SELECT o_orderkey, coalesce(nullif(Preis, ''), nullif(np, ''), Preis) AS preis,
  concat_ws(',', CASE WHEN coalesce(Preis, '') = '' AND np <> '' THEN 'Preis' END, CASE WHEN Farbe IS NULL AND nf IS NOT NULL THEN 'Farbe' END) AS filled,
  CASE WHEN Farbe IS NULL AND nf IS NOT NULL THEN 'detail' END AS farbe_source,
  CASE WHEN (Baureihe = 'nan' AND nb IS NOT NULL) OR (Preis <> '' AND np <> '' AND Preis <> '1-URGENT') THEN concat('{{', concat_ws(', ',
     CASE WHEN Baureihe = 'nan' AND nb IS NOT NULL THEN concat('"Baureihe": {{"detail": "', nb, '", "listing": "nan"}}') END,
     CASE WHEN Preis <> '' AND np <> '' AND Preis <> '1-URGENT' THEN concat('"Preis": {{"detail": "1-URGENT", "listing": "', Preis, '"}}') END), '}}') END AS conflicts
FROM ({_PAIRED})
""",
)
def _(spark, sf_dir):
    done = merge.merge_detail(
        run(spark, sf_dir, _OLD), run(spark, sf_dir, _NEW), "o_orderkey", ["Preis", "Baureihe", "Farbe"], "detail"
    )
    return done.select(
        "o_orderkey", F.col("Preis").alias("preis"), F.array_join("filled_fields", ",").alias("filled"),
        F.col("Farbe_source").alias("farbe_source"), "conflicts",
    )


@query(
    "offline_merge",
    f"""
SELECT o_orderkey, CASE WHEN {present_sql('Baureihe')} THEN Baureihe ELSE coalesce(nb, Baureihe) END AS baureihe,
  CASE WHEN NOT {present_sql('Baureihe')} AND nb IS NOT NULL THEN 'cache' END AS baureihe_source,
  concat_ws(', ', 'Alt', CASE WHEN NOT {present_sql('Preis')} AND np <> '' THEN 'Preis' END,
     CASE WHEN NOT {present_sql('Baureihe')} AND nb IS NOT NULL THEN 'Baureihe' END,
     CASE WHEN NOT {present_sql('Farbe')} AND nf IS NOT NULL THEN 'Farbe' END) AS filled,
  CASE WHEN Preis <> '' AND np <> '' AND Preis <> '1-URGENT' THEN concat('{{"Preis": {{"detail": "1-URGENT", "existing": "', Preis, '"}}}}') END AS conflicts
FROM ({_PAIRED})
""",
)
def _(spark, sf_dir):
    done = merge.merge_detail(
        run(spark, sf_dir, _OLD), run(spark, sf_dir, _NEW), "o_orderkey", ["Preis", "Baureihe", "Farbe"], "cache", offline=True
    )
    return done.select(
        "o_orderkey", F.col("Baureihe").alias("baureihe"), F.col("Baureihe_source").alias("baureihe_source"),
        enrich.append_filled(F.lit("Alt, , Alt"), F.col("filled_fields")).alias("filled"), "conflicts",
    )


# -- enrichment ----------------------------------------------------------------------------

_VEHICLES = f"""
SELECT o_orderkey AS ord, concat('/fahrzeuge/details.html?id=', {s('10000000 + o_orderkey % 5000')}) AS Vehicle_URL,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'x' END AS Farbe, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'y' END AS Hubraum
FROM orders
"""
_DECISIONS = f"""
WITH v AS (SELECT *, (Farbe = '')::INT + (Hubraum IS NULL)::INT AS missing, 10000000 + ord % 5000 AS vid FROM ({_VEHICLES})),
f AS (SELECT *, min(ord) FILTER (WHERE missing > 0) OVER (PARTITION BY vid) AS first_open FROM v),
n AS (SELECT *, sum((missing > 0 AND ord = first_open)::INT) OVER (ORDER BY ord) - (missing > 0 AND ord = first_open)::INT AS before FROM f)
SELECT ord, vid, missing, Farbe, Hubraum, CASE WHEN missing = 0 THEN 'already_complete' WHEN before >= 2000 THEN 'skipped_by_limit'
  WHEN ord = first_open THEN 'candidate' ELSE 'skipped_duplicate_id' END AS decision FROM n
"""


@query("enrich_candidates", f"SELECT ord, CAST(vid AS VARCHAR) AS vehicle_id, missing, decision FROM ({_DECISIONS})")
def _(spark, sf_dir):
    rows = enrich.candidates(run(spark, sf_dir, _VEHICLES), "ord", fields=["Farbe", "Hubraum"], cap=2000, width=1000)
    return rows.select("ord", "vehicle_id", "missing", "decision")


# Cached fields of some ids; saved pages of others; the cache goes first.
_CACHE = f"SELECT {s('10000000 + o_orderkey')} AS vehicle_id, concat('c', {s('o_orderkey')}) AS Farbe, '' AS Hubraum FROM orders WHERE o_orderstatus = 'F'"
_SAVED = f"SELECT {s('10000000 + o_orderkey')} AS vehicle_id, '' AS Farbe, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE concat('h', {s('o_orderkey')}) END AS Hubraum FROM orders WHERE o_orderpriority <> '5-LOW'"


def _enriched(spark, sf_dir):
    sources = [("cache", run(spark, sf_dir, _CACHE)), ("manual-html", run(spark, sf_dir, _SAVED))]
    return enrich.enrich(
        run(spark, sf_dir, _VEHICLES), sources, "vehicle_id", "ord", fields=["Farbe", "Hubraum"], cap=2000
    )


_ENRICHED = f"""
SELECT d.*, CASE WHEN decision = 'candidate' THEN CASE WHEN c.vehicle_id IS NOT NULL THEN 'cache' WHEN trim(h.Hubraum) <> '' THEN 'manual-html' END END AS method,
  c.Farbe AS cf, h.Hubraum AS hh
FROM ({_DECISIONS}) d LEFT JOIN ({_CACHE}) c ON c.vehicle_id = CAST(vid AS VARCHAR) LEFT JOIN ({_SAVED}) h ON h.vehicle_id = CAST(vid AS VARCHAR)
"""


@query(
    "method_chain",
    f"""
SELECT ord, decision, method AS detail_data_source, CASE WHEN method = 'cache' AND Farbe = '' THEN cf ELSE Farbe END AS farbe,
  CASE WHEN method = 'manual-html' AND Hubraum IS NULL THEN hh ELSE Hubraum END AS hubraum,
  CASE method WHEN 'cache' THEN 'detail_page_cache' WHEN 'manual-html' THEN 'detail_page_manual_html' END AS vehicle_data_source,
  CASE method WHEN 'cache' THEN 'cached_detail_page' WHEN 'manual-html' THEN 'manual_html' END AS detail_status
FROM ({_ENRICHED})
""",
)
def _(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "ord", "decision", "detail_data_source", F.col("Farbe").alias("farbe"), F.col("Hubraum").alias("hubraum"),
        "vehicle_data_source", "detail_status",
    )


_FAILURES = """
SELECT event_id, concat(' ', CAST(user_id AS STRING), ' ') AS vehicle_id, event_type AS url, CASE WHEN event_id % 2 = 0 THEN 'existing' ELSE 'cache' END AS method,
       CASE WHEN event_type = 'error' THEN 'blocked by site' ELSE 'missing' END AS reason, '' AS classification, '' AS detail_status,
       CASE WHEN event_type = 'click' THEN 503 END AS status_code
FROM events
"""


@query(
    "enrich_summary",
    f"""
WITH e AS (SELECT *, CASE WHEN (method = 'cache' AND Farbe = '') OR (method = 'manual-html' AND Hubraum IS NULL) THEN 1 ELSE 0 END AS filled,
  (Farbe <> '')::INT + (Hubraum IS NOT NULL)::INT AS held FROM ({_ENRICHED}))
SELECT count(*) FILTER (WHERE decision = 'already_complete') AS already_complete_count, count(*) FILTER (WHERE decision = 'skipped_by_limit') AS skipped_by_limit_count,
  count(*) FILTER (WHERE decision = 'skipped_duplicate_id') AS skipped_duplicate_id_count, count(*) FILTER (WHERE decision = 'candidate') AS attempted,
  count(*) FILTER (WHERE method IS NOT NULL) AS success, count(*) FILTER (WHERE decision = 'candidate' AND method IS NULL) AS failed,
  count(*) FILTER (WHERE method = 'cache') AS cache_hit, count(*) FILTER (WHERE filled = 1) AS vehicles_improved_count,
  count(*) FILTER (WHERE method IS NOT NULL AND filled = 0) AS successful_without_new_fields_count,
  CAST(sum(filled) AS BIGINT) AS fields_improved_count, CAST(sum(filled) AS BIGINT) AS fields_filled_count,
  CAST(sum(missing) FILTER (WHERE decision = 'candidate') AS BIGINT) AS missing_field_total_before,
  CAST(sum(missing - filled) FILTER (WHERE decision = 'candidate') AS BIGINT) AS missing_field_total_after,
  count(*) FILTER (WHERE decision = 'candidate' AND missing - filled > 0) AS still_missing_vehicle_count,
  round(CAST(sum(held) AS DOUBLE) * 100 / (count(*) * 10), 2) AS technical_coverage_before_pct, round(CAST(sum(held + filled) AS DOUBLE) * 100 / (count(*) * 10), 2) AS technical_coverage_after_pct,
  0.0::DOUBLE AS financing_coverage_before_pct, 0.0::DOUBLE AS financing_coverage_after_pct,
  (SELECT count(*) FROM events WHERE event_type IN ('error', 'click')) AS blocked
FROM e
""",
)
def _(spark, sf_dir):
    return enrich.enrichment_summary(_enriched(spark, sf_dir), run(spark, sf_dir, _FAILURES))


@query(
    "failed_ledger",
    "SELECT CAST(user_id AS VARCHAR) AS vehicle_id, event_type AS url, CASE WHEN event_id % 2 = 0 THEN 'existing' ELSE 'cache' END AS method, "
    "max(CASE WHEN event_id >= 300 THEN 1000000000 ELSE 0 END + event_id) % 1000000000 AS event_id FROM events GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FAILURES)
    done = enrich.failed_attempts(
        rows.filter(F.col("event_id") < 300), rows.filter(F.col("event_id") >= 300), "event_id"
    )
    return done.select("vehicle_id", "url", "method", "event_id")


@query(
    "attempt_counts",
    "SELECT CASE WHEN event_id % 2 = 0 THEN 'existing' ELSE 'cache' END AS method, count(*) AS failed_count, "
    "count(*) FILTER (WHERE event_type IN ('error', 'click')) AS blocked_count FROM events GROUP BY 1",
)
def _(spark, sf_dir):
    return enrich.attempt_counts(run(spark, sf_dir, _FAILURES))


# -- vendors, failures, defaults ---------------------------------------------------------------


@query(
    "vendor_listing_counts",
    "SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return with_listing_counts(
        table(spark, sf_dir, "supplier").select("s_suppkey"), lines.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey", "n"
    )


@query(
    "attach_vendor",
    f"""
SELECT lkey, s_name AS haendlername, CAST(s_nationkey AS VARCHAR) AS plz, concat('/v', s_suppkey) AS source_vendor_url,
  'listing_payload' AS vehicle_data_source, 'r1' AS run_id FROM ({BASE}) JOIN supplier ON l_suppkey = s_suppkey
""",
)
def _(spark, sf_dir):
    vendors = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("Händlername"),
        F.col("s_nationkey").cast("string").alias("PLZ"),
        F.concat(F.lit("/v"), F.col("s_suppkey").cast("string")).alias("link"),
    )
    rows = run(spark, sf_dir, BASE).select("lkey", "l_suppkey")
    done = merge.attach_vendor(rows, vendors, "l_suppkey", "link", "r1")
    return done.select(
        "lkey", F.col("Händlername").alias("haendlername"), F.col("PLZ").alias("plz"), "source_vendor_url",
        "vehicle_data_source", "run_id",
    )


_OUTCOMES = """
SELECT event_id, event_type IN ('error', 'click') AS failed, CASE WHEN event_id % 2 = 0 THEN 'uc-popup' ELSE '' END AS fetch_strategy,
       CAST(403 AS INT) AS fetch_status, 'home_redirect' AS detail_status FROM events WHERE event_type <> 'purchase'
"""


@query(
    "failure_fallback",
    f"""
SELECT e.event_id, CASE WHEN failed THEN 'listing_fallback' ELSE 'listing_payload' END AS vehicle_data_source,
  CASE WHEN failed AND fetch_strategy <> '' THEN fetch_strategy ELSE 'listing' END AS fetch_strategy,
  CASE WHEN failed THEN '403' END AS fetch_status, CASE WHEN failed THEN 'home_redirect' END AS detail_status
FROM events e LEFT JOIN ({_OUTCOMES}) o ON e.event_id = o.event_id
""",
)
def _(spark, sf_dir):
    listings = table(spark, sf_dir, "events").select(
        "event_id", F.lit("listing_payload").alias("vehicle_data_source"), F.lit("listing").alias("fetch_strategy")
    )
    done = merge.listing_after_failure(listings, run(spark, sf_dir, _OUTCOMES), "event_id", "failed")
    return done.select("event_id", "vehicle_data_source", "fetch_strategy", "fetch_status", "detail_status")


_PARTIAL = f"""
SELECT lkey, url AS Vehicle_URL, CASE WHEN v = 0 THEN 'old' END AS run_id, CASE WHEN v = 1 THEN '' END AS fetch_status,
       CASE WHEN v < 2 THEN preis END AS Preis, CASE WHEN v < 3 THEN brand END AS Markes,
       CASE WHEN v = 2 THEN 'curl' END AS fetch_strategy, CASE WHEN v = 3 THEN '9 €' ELSE '' END AS Financing, '' AS Finanzierung, brand, preis, v
FROM ({LISTINGS})
"""


@query(
    "finalize_records",
    f"""
SELECT lkey, CASE WHEN v = 0 THEN 'old' ELSE 'r2' END AS run_id, '' AS fetch_status,
  CASE WHEN v = 2 THEN 'detail_page' ELSE 'listing_payload' END AS vehicle_data_source,
  CASE WHEN v = 2 THEN 'curl' ELSE 'listing_payload' END AS fetch_strategy,
  CASE WHEN 5 + (v < 2 AND preis NOT IN ('', 'nan'))::INT + (v < 3 AND brand <> '')::INT + (v = 3)::INT + (v = 2)::INT > 4 THEN 'ok' ELSE 'partial' END AS parse_status,
  CASE WHEN v = 3 THEN '9 €' ELSE '' END AS finanzierung, url AS source_vehicle_url
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _PARTIAL).drop("brand", "v", "preis")
    done = merge.finalize_records(rows, "r2", F.lit("2024-01-01"))
    return done.select(
        "lkey", "run_id", "fetch_status", "vehicle_data_source", "fetch_strategy", "parse_status",
        F.col("Finanzierung").alias("finanzierung"), "source_vehicle_url",
    )


_ERRORS = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS stage, CASE WHEN event_id % 3 = 0 THEN 'fetch' END AS type,
       CASE WHEN event_id % 5 = 0 THEN 'HTTP 503 x' ELSE '' END AS error_message, CASE WHEN event_id % 7 = 0 THEN 'HTTP 403' END AS error,
       CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'click' THEN 503 END AS status_code,
       CASE WHEN event_id % 11 = 0 THEN 'r0' END AS run_id, props AS extra
FROM events
"""
_NORMAL_ERRORS = f"""
SELECT event_id, coalesce(stage, type, '') AS stage, coalesce(nullif(error_message, ''), error, '') AS error, status_code,
  coalesce(run_id, 'r9') AS run_id, extra FROM ({_ERRORS})
"""


@query("normalize_errors", f"SELECT event_id, stage, stage AS type, error, error AS error_message, status_code, run_id, '2024' AS timestamp, extra FROM ({_NORMAL_ERRORS})")
def _(spark, sf_dir):
    done = merge.normalize_errors(run(spark, sf_dir, _ERRORS), "r9", F.lit("2024"))
    return done.select("event_id", "stage", "type", "error", "error_message", "status_code", "run_id", "timestamp", "extra")


_JOBS = """
SELECT event_id, concat('/fahrzeuge/details.html?id=', CAST(event_id AS STRING)) AS Vehicle_URL, CASE WHEN event_id % 4 = 0 THEN 'a' ELSE '' END AS Markes,
  'b' AS Models, 'c' AS Fahrzeugtyp, 'd' AS Preis, 'e' AS Kilometerstand, 'f' AS Erstzulassung,
  CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'click' THEN 500 ELSE 200 END AS last_status,
  CASE WHEN event_type = 'signup' THEN 'EdgeSuite error' ELSE '' END AS last_error, '' AS fetch_status, 'curl' AS fetch_strategy,
  CASE WHEN event_type = 'view' THEN 'blank_page' ELSE 'real_detail_page' END AS detail_status, '' AS fetch_fallback_reason, '' AS parse_status
FROM events
"""


@query(
    "detail_outcomes",
    """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'skipped' WHEN event_type IN ('error', 'signup') THEN 'blocked'
  WHEN event_type IN ('click', 'view') THEN 'failed' ELSE 'success' END AS outcome,
  CAST(CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'click' THEN 500 ELSE 200 END AS INTEGER) AS status_code FROM events
""",
)
def _(spark, sf_dir):
    return merge.detail_outcomes(run(spark, sf_dir, _JOBS), policy="missing-required").select("event_id", "outcome", "status_code")
