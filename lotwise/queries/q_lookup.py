"""Queries over classification, location, listing rules and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import predicates as P
from lotwise.functions import urls as U
from lotwise.operators import audit, classify, listings as L, location, merge, specs
from lotwise.queries.base import (
    BASE, LISTINGS, listings, pick, present_sql, query, run, s, table,
)


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs)


def _ordered_words(words):
    flat = dict.fromkeys((w.lower(), name) for name, ws in words.items() for w in ws)
    return [(w, name, i) for i, (w, name) in enumerate(flat)]


_TYPE_VALUES = _values(_ordered_words(fixed.TYPE_WORDS))
_ORIGIN_VALUES = _values(_ordered_words(fixed.ORIGIN_WORDS))
_SOURCE_VALUES = _values([(w, c) for c, ws in fixed.SOURCE_CATEGORY_CLASS.items() for w in ws])


def _cascade(kind: str, key: str, source: str) -> str:
    """Type and origin verdicts per distinct input, written with joins and CASE."""
    return f"""
WITH words(w, name, ord) AS (VALUES {_TYPE_VALUES if kind == 'type' else _ORIGIN_VALUES}),
sources(w, name) AS (VALUES {_SOURCE_VALUES}),
inputs AS (SELECT DISTINCT {key} AS raw, {source} AS src FROM ({LISTINGS})),
keyed AS (SELECT raw, src, lower(trim(raw)) AS k FROM inputs),
hits AS (
  SELECT raw, src, k,
         (SELECT any_value(name) FROM words WHERE w = k) AS exact,
         (SELECT any_value(name) FROM sources WHERE w = lower(src)) AS by_source,
         (SELECT arg_min(name, ord) FROM words WHERE contains(k, w) OR contains(w, k)) AS overlap
  FROM keyed)
"""


@query(
    "type_cascade",
    _cascade("type", "vtype", "source")
    + f"""
SELECT l.lkey, CASE WHEN k = 'kastenwagen' AND by_source = 'LKW' THEN 'LKW' WHEN k = '' THEN coalesce(by_source, 'Andere')
       ELSE coalesce(exact, by_source, overlap, 'Andere') END AS category, trim(raw) AS normalized,
       CAST(CASE WHEN k = 'kastenwagen' AND by_source = 'LKW' THEN 0.95 WHEN k = '' AND by_source IS NOT NULL THEN 0.9
            WHEN k = '' THEN 0.0 WHEN exact IS NOT NULL THEN 1.0 WHEN by_source IS NOT NULL THEN 0.9
            WHEN overlap IS NOT NULL THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence,
       CASE WHEN k = 'kastenwagen' AND by_source = 'LKW' THEN 'source_category_override'
            WHEN k = '' AND by_source IS NOT NULL THEN 'source_category_match' WHEN k = '' THEN 'unknown_to_andere'
            WHEN exact IS NOT NULL THEN 'exact_task_match' WHEN by_source IS NOT NULL THEN 'source_category_match'
            WHEN overlap IS NOT NULL THEN 'keyword_fallback' ELSE 'unknown_to_andere' END AS rule
FROM ({LISTINGS}) l JOIN hits ON l.vtype = hits.raw AND l.source = hits.src
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    return rows.select("lkey", classify.vehicle_type("vtype", "source").alias("t")).select("lkey", "t.*")


@query(
    "origin_cascade",
    _cascade("origin", "brand", "''")
    + f"""
SELECT l.lkey, CASE WHEN k = '' THEN 'Andere' ELSE coalesce(exact, overlap, 'Andere') END AS category,
       trim(raw) AS normalized,
       CAST(CASE WHEN k = '' THEN 0.0 WHEN exact IS NOT NULL THEN 1.0 WHEN overlap IS NOT NULL THEN 0.85 ELSE 0.0 END AS DOUBLE) AS confidence,
       CASE WHEN k = '' THEN 'unknown_to_andere' WHEN exact IS NOT NULL THEN 'exact_task_match'
            WHEN overlap IS NOT NULL THEN 'alias_match' ELSE 'unknown_to_andere' END AS rule
FROM ({LISTINGS}) l JOIN hits ON l.brand = hits.raw
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    return rows.select("lkey", classify.manufacturer_origin("brand").alias("t")).select("lkey", "t.*")


@query(
    "classify_listings",
    _cascade("type", "vtype", "CASE WHEN source <> '' THEN source ELSE 'Trailer' END")
    + f""", origin_words(w, name, ord) AS (VALUES {_ORIGIN_VALUES}),
makers AS (SELECT brand, CASE WHEN brand = '' THEN 'Andere' ELSE coalesce(
    (SELECT any_value(name) FROM origin_words WHERE w = lower(brand)),
    (SELECT arg_min(name, ord) FROM origin_words WHERE contains(lower(brand), w) OR contains(w, lower(brand))),
    'Andere') END AS origin FROM (SELECT DISTINCT brand FROM ({LISTINGS})))
SELECT l.lkey, CASE WHEN source <> '' THEN source ELSE 'Trailer' END AS source_category,
       'x' AS source_category_label, '' AS source_category_url, vtype AS raw_vehicle_type,
       CASE WHEN k = 'kastenwagen' AND by_source = 'LKW' THEN 'LKW' WHEN k = '' THEN coalesce(by_source, 'Andere')
            ELSE coalesce(exact, by_source, overlap, 'Andere') END AS vehicle_category,
       origin AS manufacturer_origin, origin AS herkunftsland
FROM ({LISTINGS}) l JOIN hits ON l.vtype = hits.raw AND CASE WHEN l.source <> '' THEN l.source ELSE 'Trailer' END = hits.src
JOIN makers m ON l.brand = m.brand
""",
)
def _(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns(
        {"Vehicle_Category": F.lit("Trailer"), "Vehicle_Category_Label": F.lit("x")}
    )
    done = classify.classify_vehicles(rows)
    return done.select(
        "lkey", "source_category", "source_category_label", "source_category_url", "raw_vehicle_type",
        "vehicle_category", "manufacturer_origin", F.col("Herkunftsland").alias("herkunftsland"),
    )


# -- places ------------------------------------------------------------------------------

_COUNTRIES = ["DE", "germany", "Italia", "FRA", "nl", "Belgien", "OESTERREICH", "Polen", ""]
_NAMES = ["Deutschland", "Deutschland", "Italien", "Frankreich", "Niederlande", "Belgien", "Österreich", "Polen", ""]
_PLACES = f"""
SELECT c_custkey, {pick('c_custkey', _COUNTRIES)} AS country, lpad(CAST(c_custkey * 37 % 100000 AS STRING), 5, '0') AS plz,
       CASE WHEN c_custkey % 2 = 0 THEN 'Bayern' ELSE 'Ligurien' END AS region
FROM customer
"""
_RANGES = _values(fixed.POSTCODE_RANGES)


@query("country_names", f"SELECT c_custkey, {pick('c_custkey', _NAMES)} AS country FROM customer")
def _(spark, sf_dir):
    return run(spark, sf_dir, _PLACES).select("c_custkey", location.country_name("country").alias("country"))


@query(
    "range_lookup",
    f"""
WITH ranges(lo, hi, state) AS (VALUES {_RANGES}),
places AS (SELECT c_custkey, plz, region, {pick('c_custkey', _NAMES)} AS country FROM ({_PLACES}))
SELECT c_custkey, coalesce(state, '') AS state, country AS land,
       CASE WHEN country = 'Deutschland' THEN coalesce(state, region) ELSE region END AS actual_region,
       CASE WHEN country = 'Deutschland' THEN coalesce(state, region)
            WHEN region = 'Bayern' THEN '' ELSE region END AS bundesland
FROM places LEFT JOIN ranges ON CAST(plz AS INT) BETWEEN lo AND hi
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _PLACES).select(
        "c_custkey", F.col("country").alias("Land"), F.col("plz").alias("PLZ"), F.col("region").alias("Bundesland"), "region"
    )
    rows = rows.withColumns(
        {
            "state": location.state_of_postcode("PLZ"),
            "actual_region": location.actual_region(F.col("Land"), F.col("PLZ"), F.col("region")),
        }
    )
    done = location.finalize_location(rows)
    return done.select(
        "c_custkey", "state", F.col("Land").alias("land"), "actual_region", F.col("Bundesland").alias("bundesland")
    )


# -- listing rules ------------------------------------------------------------------------

_BODIES = ["Cabrio", "EstateCar", "BoxSemiTrailer", "Unknown", "", "undefined", "Trike"]
_BODY_LABELS = ["Cabrio/Roadster", "Kombi", "Auflieger", "Unknown", "", "", "Trike"]
_CATS = ["Car", "Trailer", "Motorhome", "", "SemiTrailer"]
_CAT_LABELS = ["PKW", "Anhänger", "Wohnmobil andere", "", "Auflieger"]
_FLAGS = f"""
SELECT lkey, {pick('l_partkey', _BODIES)} AS body, {pick('l_orderkey', _CATS)} AS cat, l_partkey, l_orderkey,
       CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN true WHEN 1 THEN false END AS damage,
       CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN false WHEN 1 THEN true END AS ready
FROM ({BASE})
"""


@query(
    "body_labels",
    f"""
SELECT lkey, {pick('l_partkey', _BODY_LABELS)} AS body_label,
       CASE WHEN cat IN ('Car', 'Motorhome') THEN CASE WHEN {pick('l_partkey', _BODY_LABELS)} <> '' THEN {pick('l_partkey', _BODY_LABELS)} ELSE {pick('l_orderkey', _CAT_LABELS)} END
            WHEN cat = '' THEN {pick('l_partkey', _BODY_LABELS)} ELSE {pick('l_orderkey', _CAT_LABELS)} END AS type,
       CASE WHEN damage THEN 'Beschädigt' WHEN NOT ready THEN 'Nicht fahrtauglich' WHEN NOT damage THEN 'Unfallfrei' ELSE '' END AS condition
FROM ({_FLAGS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FLAGS)
    return rows.select(
        "lkey",
        L.body_label("body").alias("body_label"),
        L.listing_type(F.col("cat"), F.col("body")).alias("type"),
        L.listing_condition(F.lit(None).cast("boolean"), F.col("damage"), F.col("ready")).alias("condition"),
    )


_KINDS = ["Unfallfrei", "BOX", "Kombi", "EZ 03/2014", "12.500 km", "75 kW", "", "Panel Van", "Limousine"]
_CATEGORY_PAGES = f"""
SELECT l_suppkey, {pick('l_suppkey', _CATS)} AS category, {pick('l_suppkey', _CAT_LABELS)} AS own,
       count(*) AS n FROM lineitem GROUP BY l_suppkey
"""


@query(
    "category_fallback",
    f"""
WITH pages2 AS ({_CATEGORY_PAGES})
SELECT lkey, CASE WHEN category = '' THEN vtype2 WHEN l_linenumber % 9 IN (2, 8) THEN vtype2 ELSE own END AS type,
       CASE WHEN l_linenumber % 9 = 1 THEN 'kept' WHEN category = '' THEN NULL ELSE category END AS vehicle_category,
       CASE WHEN category <> '' THEN category END AS source_category,
       CASE WHEN category <> '' THEN own END AS source_category_label,
       CASE WHEN category <> '' THEN CAST(n AS VARCHAR) END AS source_category_count,
       CASE WHEN category <> '' THEN concat('/?vc=', category) END AS source_category_url
FROM (SELECT *, {pick('l_linenumber', _KINDS)} AS vtype2 FROM ({BASE})) b JOIN pages2 USING (l_suppkey)
""",
)
def _(spark, sf_dir):
    pages = run(spark, sf_dir, _CATEGORY_PAGES).select(
        "l_suppkey", "category", F.lit("").alias("label"), F.col("n").alias("count"),
        F.concat(F.lit("/?vc="), "category").alias("url"),
    )
    rows = run(
        spark, sf_dir,
        f"SELECT lkey, l_suppkey, {pick('l_linenumber', _KINDS)} AS Fahrzeugtyp, "
        f"CASE WHEN l_linenumber % 9 = 1 THEN 'kept' END AS Vehicle_Category FROM ({BASE})",
    )
    done = L.apply_category(rows, pages, "l_suppkey")
    return done.select(
        "lkey", F.col("Fahrzeugtyp").alias("type"), F.col("Vehicle_Category").alias("vehicle_category"),
        "source_category", "source_category_label", "source_category_count", "source_category_url",
    )


_LABELS = ["CO2-Emissionen (komb.)", "vorbesitzer:", "FARBE", "Türen", "Line", "Hubraum :", "Anzahl der Türen", "x"]


@query(
    "spec_labels",
    "SELECT p_partkey, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'CO₂-Emissionen' WHEN 1 THEN 'Anzahl der Fahrzeughalter' "
    "WHEN 2 THEN 'Farbe' WHEN 4 THEN 'Ausstattungslinie' WHEN 5 THEN NULL WHEN 6 THEN 'Anzahl der Türen' END AS label FROM part",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, f"SELECT p_partkey, {pick('p_partkey', _LABELS)} AS raw FROM part")
    return rows.select("p_partkey", specs.canonical_label(F.col("raw")).alias("label"))


@query(
    "category_labels",
    f"""
SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'PKW' WHEN 1 THEN 'Anhänger' WHEN 2 THEN 'Busse' ELSE 'Lkw bis 7,5 t' END AS label
FROM part
""",
)
def _(spark, sf_dir):
    texts = ["Alle pkw (3)", "Anhänger gebraucht", "xyz", "Mein LKW bis 7,5 t"]
    codes = ["Car", "Trailer", "Bus", "VanUpTo7500"]
    rows = run(
        spark, sf_dir,
        f"SELECT p_partkey, {pick('p_partkey', texts)} AS t, {pick('p_partkey', codes)} AS code FROM part",
    )
    return rows.select("p_partkey", L.label_in_text("t", F.col("code")).alias("label"))


# -- row predicates ---------------------------------------------------------------------------

_FETCHES = """
SELECT page_id, url, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN concat(html, '<p>Access Denied</p>')
       WHEN 1 THEN concat(html, '<b>Please enable JavaScript</b>') WHEN 2 THEN '<html>kurz</html>'
       WHEN 3 THEN concat('errors.edgesuite.net Reference #18.abc-1 ', html) ELSE html END AS html,
       CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 2 THEN 301 ELSE 200 END AS status,
       CASE WHEN page_id % 11 = 0 THEN 'timeout' ELSE '' END AS error_type,
       CASE WHEN page_id % 22 = 0 THEN 'took too long' ELSE '' END AS error_message
FROM pages
"""


@query(
    "page_valid",
    f"""
SELECT page_id,
       CASE WHEN error_type <> '' THEN CASE WHEN error_message <> '' THEN error_message ELSE error_type END
            WHEN status IS NOT NULL AND (status < 200 OR status >= 400) THEN concat('HTTP ', status)
            WHEN length(trim(html)) < 200 THEN 'static_html_too_short'
            WHEN regexp_matches(lower(html), 'zugriff verweigert|access denied|captcha|aus sicherheitsgründen|error reference') THEN 'static_html_blocked_or_challenge'
            WHEN regexp_matches(lower(html), 'enable javascript|javascript is disabled') THEN 'static_html_requires_browser'
            ELSE '' END AS reason,
       error_type = '' AND html <> '' AND coalesce(status >= 200 AND status < 400, true) AS fetch_ok,
       regexp_matches(lower(html), 'zugriff verweigert|access denied|captcha|aus sicherheitsgründen|error reference') AS blocked,
       regexp_matches(lower(html), 'edgesuite|an error occurred while processing your request') AS edge,
       regexp_extract(html, '(?i)Reference\\s*#?([A-Za-z0-9_.-]+)', 1) AS edge_reference
FROM ({_FETCHES})
""".replace("\\\\", "\\"),
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FETCHES)
    check = P.static_page(F.col("error_type"), F.col("error_message"), F.col("status"), F.col("html"))
    return rows.select(
        "page_id",
        check["reason"].alias("reason"),
        P.fetch_ok(F.col("error_type"), F.col("html"), F.col("status")).alias("fetch_ok"),
        P.looks_blocked("html").alias("blocked"),
        P.looks_edge_error("html").alias("edge"),
        P.edge_reference("html").alias("edge_reference"),
    )


_ATTEMPTS = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'HTTP 403 Forbidden' WHEN 'view' THEN 'ok'
       WHEN 'click' THEN 'Access  Denied by site' WHEN 'signup' THEN 'site protection' ELSE '' END AS reason,
       CASE event_type WHEN 'purchase' THEN 503 WHEN 'error' THEN 403 WHEN 'view' THEN 200 WHEN 'signup' THEN 0 END AS status,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'uc-popup' ELSE 'curl' END AS strategy,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'real_detail_page' WHEN 1 THEN 'home_redirect' WHEN 2 THEN '' ELSE 'error_page' END AS detail_status,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '429' WHEN 1 THEN 'n/a' ELSE '' END AS fetch_status
FROM events
"""


@query(
    "attempt_outcomes",
    f"""
WITH a AS (SELECT *, coalesce(CASE WHEN status <> 0 THEN status END, TRY_CAST(CASE WHEN fetch_status = '429' THEN '429' END AS INTEGER)) AS code FROM ({_ATTEMPTS}))
SELECT event_id, code,
       regexp_matches(concat_ws(' ', lower(trim(regexp_replace(reason, ' +', ' ', 'g'))), lower(detail_status), coalesce(CAST(status AS VARCHAR), '')),
         '403|503|blocked|challenge|captcha|access denied|zugriff verweigert|error_page') AS blocked,
       coalesce(code IN (403, 429, 500, 502, 503, 504), false) OR regexp_matches(lower(reason), 'access denied|site protection')
         OR CASE WHEN strategy = 'uc-popup' THEN detail_status <> 'real_detail_page' ELSE detail_status IN ('home_redirect', 'error_page') END AS failed
FROM a
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _ATTEMPTS)
    code = P.detail_status_code(F.col("status"), F.col("fetch_status"))
    rows = rows.withColumn("code", code)
    return rows.select(
        "event_id",
        "code",
        P.attempt_blocked([F.col("reason"), F.col("detail_status")], F.col("status")).alias("blocked"),
        P.detail_failed(F.col("code"), F.col("reason"), F.col("strategy"), F.col("detail_status")).alias("failed"),
    )


_POLICY = f"""
SELECT lkey, v, CASE WHEN l_linenumber % 4 = 0 THEN '/search.html' ELSE url END AS link, brand, model, vtype, preis, kilometer, ez
FROM ({LISTINGS})
"""
_ALL_PRESENT = " AND ".join(present_sql(c) for c in ("brand", "model", "vtype", "preis", "kilometer", "ez"))


@query(
    "detail_policy",
    f"""
SELECT lkey, strpos(link, '/fahrzeuge/details') > 0 AND NOT ({_ALL_PRESENT}) AS missing_required,
       strpos(link, '/fahrzeuge/details') > 0 AND v <> 3 AS financing_only,
       strpos(link, '/fahrzeuge/details') > 0 AS always, false AS never,
       CASE WHEN strpos(link, '/fahrzeuge/details') > 0 AND NOT ({_ALL_PRESENT}) THEN 'needed' ELSE 'not' END AS outcome
FROM ({_POLICY})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _POLICY).select(
        "lkey", F.col("link").alias("Vehicle_URL"), F.col("brand").alias("Markes"), F.col("model").alias("Models"),
        F.col("vtype").alias("Fahrzeugtyp"), F.col("preis").alias("Preis"),
        F.col("kilometer").alias("Kilometerstand"), F.col("ez").alias("Erstzulassung"),
        F.when(F.col("v") == 3, F.lit("Santander")).otherwise(F.lit("None")).alias("Bank"),
    )
    url = F.col("Vehicle_URL")

    def need(policy):
        return P.needs_detail(url, policy, available=rows.columns)

    return rows.select(
        "lkey",
        need("missing-required").alias("missing_required"),
        need("financing-only").alias("financing_only"),
        need("always").alias("always"),
        need("never").alias("never"),
        F.when(need("missing-required"), F.lit("needed")).otherwise(F.lit("not")).alias("outcome"),
    )


@query(
    "missing_fields",
    f"""
SELECT lkey, concat_ws(',', CASE WHEN NOT {present_sql('preis')} THEN 'Preis' END,
       CASE WHEN NOT {present_sql('kilometer')} THEN 'Kilometerstand' END,
       CASE WHEN NOT {present_sql('ez')} THEN 'Erstzulassung' END,
       CASE WHEN NOT {present_sql('co2_text')} THEN 'CO₂-Emissionen' END) AS missing,
       CAST((NOT {present_sql('preis')})::INT + (NOT {present_sql('kilometer')})::INT + (NOT {present_sql('ez')})::INT + (NOT {present_sql('co2_text')})::INT AS INTEGER) AS n
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn(
        "m", P.missing_fields(["Preis", "Kilometerstand", "Erstzulassung", "CO₂-Emissionen"])
    )
    return rows.select("lkey", F.array_join("m", ",").alias("missing"), F.size("m").alias("n"))


_RESPONSES = """
SELECT event_id, concat(CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'https://www.marktplatz.example/api/x?' WHEN 1 THEN 'https://m.marktplatz.example/svc/'
       WHEN 2 THEN 'https://cdn.example.org/a.' ELSE 'https://suchen.marktplatz.example/p/' END, CAST(event_id AS STRING)) AS url,
       CASE event_type WHEN 'view' THEN 'text/html' WHEN 'click' THEN 'application/JSON' WHEN 'error' THEN 'text/javascript' ELSE 'image/png' END AS content_type,
       CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'xhr' WHEN 1 THEN 'document' WHEN 2 THEN 'fetch' ELSE 'script' END AS resource_type
FROM events
"""


@query(
    "api_responses",
    f"""
SELECT event_id, resource_type IN ('xhr', 'fetch') OR contains(lower(content_type), 'json') OR contains(url, '/api/') OR contains(url, '/svc/') AS api,
       NOT contains(url, 'cdn.example.org') AND (contains(lower(content_type), 'json') OR resource_type IN ('xhr', 'fetch')) AS keeps_body,
       CASE content_type WHEN 'text/html' THEN '.html' WHEN 'application/JSON' THEN '.json' WHEN 'text/javascript' THEN '.js' ELSE '.txt' END AS suffix,
       concat('Server=', resource_type) AS headers
FROM ({_RESPONSES})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _RESPONSES)
    url, kind, resource = F.col("url"), F.col("content_type"), F.col("resource_type")
    kept = P.small_headers(F.create_map(F.lit("Server"), resource, F.lit("Set-Cookie"), F.lit("x")))
    return rows.select(
        "event_id",
        P.is_api_endpoint(url, kind, resource).alias("api"),
        P.keeps_body(url, kind, resource).alias("keeps_body"),
        P.body_suffix(kind).alias("suffix"),
        F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("headers"),
    )


@query(
    "endpoint_index",
    f"""
SELECT resource_type, count(*) AS response_count,
       count(*) FILTER (WHERE resource_type IN ('xhr', 'fetch') OR contains(lower(content_type), 'json') OR contains(url, '/api/') OR contains(url, '/svc/')) AS api_endpoint_count
FROM ({_RESPONSES}) GROUP BY resource_type
""",
)
def _(spark, sf_dir):
    return audit.endpoint_index(run(spark, sf_dir, _RESPONSES))


@query(
    "listing_ids",
    "SELECT o_orderkey, o_orderkey >= 1000 AS valid FROM orders",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, f"SELECT o_orderkey, concat({s('o_orderkey')}, '0000') AS i FROM orders")
    return rows.select("o_orderkey", U.is_listing_id("i").alias("valid"))


# -- target and completed sets -----------------------------------------------------------------


@query(
    "semi_target",
    "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return merge.in_targets(orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query(
    "anti_pending",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return merge.not_done(orders, lines, ["o_orderkey"])
