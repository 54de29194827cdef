"""Queries over text, URL and title functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.functions import titles
from lotwise.functions import urls as U
from lotwise.queries.base import BASE, LISTINGS, clean_sql, query, run, table

_SPACED = "SELECT doc_id, concat(replace(text, ' of ', ' of\t '), '   ') AS raw FROM documents"


@query(
    "clean_text",
    f"SELECT doc_id, length(c) AS cleaned_chars, md5(c) AS cleaned_md5 FROM "
    f"(SELECT doc_id, {clean_sql('raw')} AS c FROM ({_SPACED}))",
)
def _(spark, sf_dir):
    docs = run(spark, sf_dir, _SPACED).withColumn("c", T.clean_text("raw"))
    return docs.select(
        "doc_id", F.length("c").cast("bigint").alias("cleaned_chars"), F.md5("c").alias("cleaned_md5")
    )


_DECOMPOSED = (
    "SELECT doc_id, replace(replace(replace(text, 'é', 'e\u0301'), 'ü', 'u\u0308'), 'ñ', 'n\u0303') "
    "AS raw FROM documents"
)


@query(
    "nfc_text",
    f"SELECT doc_id, length(c) AS cleaned_chars, md5(c) AS cleaned_md5 FROM (SELECT doc_id, "
    f"CASE WHEN {clean_sql('nfc_normalize(raw)')} IN ('nan', 'None', 'NaN', '<NA>') THEN '' "
    f"ELSE {clean_sql('nfc_normalize(raw)')} END AS c FROM ({_DECOMPOSED}))",
)
def _(spark, sf_dir):
    docs = T.compose_unicode(run(spark, sf_dir, _DECOMPOSED), ["raw"])
    docs = docs.withColumn("c", T.normalize_text("raw"))
    return docs.select(
        "doc_id", F.length("c").cast("bigint").alias("cleaned_chars"), F.md5("c").alias("cleaned_md5")
    )


_MARKED = """
SELECT o_orderkey,
       CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN '$undefined' WHEN 1 THEN '' WHEN 2 THEN ' null '
            WHEN 3 THEN NULL WHEN 4 THEN 'nan' WHEN 5 THEN '<NA>' WHEN 6 THEN ' None'
            ELSE o_orderpriority END AS a,
       CASE WHEN o_orderkey % 5 = 0 THEN 'undefined' ELSE o_orderstatus END AS b
FROM orders
"""


@query(
    "placeholder_text",
    f"""
SELECT o_orderkey,
       CASE WHEN coalesce(trim(a), '') IN ('$undefined', 'undefined', 'None', 'null') THEN '' ELSE coalesce(trim(a), '') END AS value,
       CASE WHEN coalesce(trim(a), '') NOT IN ('', '$undefined', 'undefined', 'None', 'null') THEN trim(a)
            WHEN b NOT IN ('', 'undefined') THEN b ELSE '' END AS first_of_two,
       a IS NOT NULL AND trim(a) NOT IN ('', 'nan', 'None', 'NaN', '<NA>') AS has_value,
       coalesce(trim(a), '') NOT IN ('', 'None', 'nan') AS scores,
       coalesce(a, '') <> '' AS filled
FROM ({_MARKED})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _MARKED)
    return rows.select(
        "o_orderkey",
        T.without_placeholder("a").alias("value"),
        T.first_present("a", "b").alias("first_of_two"),
        T.has_value("a").alias("has_value"),
        T.scores_as_value("a").alias("scores"),
        T.is_filled("a").alias("filled"),
    )


# -- URLs -------------------------------------------------------------------------

_HOME = "home.marktplatz.example"
_DEALER_LINKS = f"""
SELECT c_custkey,
       CASE CAST(c_custkey % 10 AS INT)
            WHEN 0 THEN concat('/dealer', CAST(c_custkey AS STRING))
            WHEN 1 THEN concat('"https://{_HOME}/Dealer', CAST(c_custkey AS STRING), '/?page=2#x"')
            WHEN 2 THEN concat('//{_HOME}/de/', CAST(c_custkey AS STRING), '/')
            WHEN 3 THEN concat('http://other.example.com/', c_name)
            WHEN 4 THEN concat('dealer', CAST(c_custkey AS STRING))
            WHEN 5 THEN '/impressum'
            WHEN 6 THEN concat('/regional/', CAST(c_custkey AS STRING), '.html')
            WHEN 7 THEN ''
            WHEN 8 THEN concat('mailto:a', CAST(c_custkey AS STRING), '@b.example')
            ELSE concat('https://{_HOME}/X', CAST(c_custkey AS STRING)) END AS href
FROM customer
"""


@query(
    "url_canonical",
    f"""
SELECT c_custkey,
       CASE CAST(c_custkey % 10 AS INT)
            WHEN 0 THEN concat('https://{_HOME}/DEALER', c_custkey)
            WHEN 1 THEN concat('https://{_HOME}/DEALER', c_custkey)
            WHEN 2 THEN concat('https://{_HOME}/de/', c_custkey)
            WHEN 3 THEN concat('http://other.example.com/', c_name)
            WHEN 4 THEN concat('https://{_HOME}/DEALER', c_custkey)
            WHEN 5 THEN 'https://{_HOME}/IMPRESSUM'
            WHEN 6 THEN concat('https://{_HOME}/regional/', c_custkey, '.html')
            WHEN 7 THEN ''
            WHEN 8 THEN concat('https://{_HOME}/MAILTO:A', c_custkey, '@B.EXAMPLE')
            ELSE concat('https://{_HOME}/X', c_custkey) END AS url,
       CASE CAST(c_custkey % 10 AS INT) WHEN 0 THEN concat('DEALER', c_custkey)
            WHEN 1 THEN concat('DEALER', c_custkey) WHEN 2 THEN 'de' WHEN 3 THEN split_part(c_name, '#', 1)
            WHEN 4 THEN concat('DEALER', c_custkey) WHEN 5 THEN 'IMPRESSUM' WHEN 6 THEN 'regional'
            WHEN 7 THEN '' WHEN 8 THEN concat('MAILTO:A', c_custkey, '@B.EXAMPLE')
            ELSE concat('X', c_custkey) END AS slug,
       c_custkey % 10 IN (0, 1, 4, 9) AS is_dealer
FROM customer
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DEALER_LINKS)
    return rows.select(
        "c_custkey",
        U.dealer_url("href").alias("url"),
        U.dealer_slug("href").alias("slug"),
        U.is_dealer_link("href").alias("is_dealer"),
    )


_SUCHEN = "https://suchen.marktplatz.example"
_REFS = f"""
SELECT lkey, listing, v,
       CASE v WHEN 0 THEN CAST(listing AS STRING)
              WHEN 1 THEN concat('//suchen.marktplatz.example/fahrzeuge/details.html?id=', CAST(listing AS STRING))
              WHEN 2 THEN concat('/fahrzeuge/details.html?x=1&id=', CAST(listing AS STRING), '&y=2')
              WHEN 3 THEN concat('suchen.marktplatz.example/auto-inserat/golf/', CAST(listing AS STRING), '.html')
              WHEN 4 THEN concat('https://suchen.marktplatz.example/auto-inserat/', CAST(listing AS STRING), '/')
              ELSE concat(' {_SUCHEN}/fahrzeuge/search.html?ref=', CAST(l_partkey AS STRING)) END AS ref
FROM ({BASE})
"""


@query(
    "vehicle_refs",
    f"""
SELECT lkey,
       CASE v WHEN 0 THEN concat('{_SUCHEN}/fahrzeuge/details.html?id=', listing)
              WHEN 1 THEN concat('{_SUCHEN}/fahrzeuge/details.html?id=', listing)
              WHEN 2 THEN concat('{_SUCHEN}/fahrzeuge/details.html?x=1&id=', listing, '&y=2')
              WHEN 3 THEN concat('https://suchen.marktplatz.example/auto-inserat/golf/', listing, '.html')
              WHEN 4 THEN concat('{_SUCHEN}/auto-inserat/', listing, '/')
              ELSE trim(ref) END AS url,
       CASE WHEN v IN (0, 1, 2, 4) THEN CAST(listing AS STRING) ELSE '' END AS vehicle_id,
       v <> 5 AS is_detail, true AS is_vehicle,
       CASE WHEN v = 0 THEN listing >= 10000000 ELSE false END AS is_id
FROM ({_REFS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _REFS).withColumn("url", U.vehicle_url("ref"))
    return rows.select(
        "lkey",
        "url",
        U.listing_id("url").alias("vehicle_id"),
        U.is_detail_url("url").alias("is_detail"),
        U.is_vehicle_url("url").alias("is_vehicle"),
        U.is_listing_id("ref").alias("is_id"),
    )


@query(
    "url_parts",
    r"""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme,
       regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host,
       regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(url, '[?&]ref=([^&#]+)', 1) AS ref,
       regexp_extract(url, '[?&]page=([^&#]+)', 1) AS page
FROM pages
""",
)
def _(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.url_scheme(u).alias("scheme"),
        U.url_host(u).alias("host"),
        U.url_path(u).alias("path"),
        U.query_value(u, "ref").alias("ref"),
        U.query_value(u, "page").alias("page"),
    )


_CATS = list(fixed.CATEGORY_LABELS)
_INVENTORY = f"""
SELECT page_id, concat('http://', '{_HOME}', '/D', CAST(page_id AS STRING),
       CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '/?page=3&a=b+c&vc=Bus' WHEN 1 THEN '?pageNumber=2&q=%C3%A4&q=2'
            WHEN 2 THEN '/' ELSE '?x=' END) AS url,
       CASE WHEN page_id % 2 = 0 THEN 'Car' ELSE 'Trailer' END AS category
FROM pages
"""


@query(
    "query_rewrite",
    f"""
SELECT page_id, concat('http://{_HOME}/D', page_id,
       CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '?a=b+c&vc=Car' WHEN 1 THEN '?q=2&vc=Trailer'
            WHEN 2 THEN '?vc=Car' ELSE '?x=&vc=Trailer' END) AS url,
       CASE WHEN page_id % 2 = 0 THEN 'Car' ELSE 'Trailer' END AS category_of_url
FROM pages
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _INVENTORY).withColumn("url", U.category_url("url", "category"))
    return rows.select("page_id", "url", U.category_of_href("url").alias("category_of_url"))


_SLUG = "trim(regexp_replace(trim(concat(brand, CASE WHEN brand = '' THEN '' ELSE ' ' END, model)), '[^A-Za-z0-9ÄÖÜäöüß-]+', '-', 'g'), '-')"


@query(
    "entry_keys",
    f"""
SELECT lkey, CASE WHEN v = 0 THEN concat('https://{_HOME}/D', l_suppkey, '#listing-', CASE WHEN source = '' THEN '' ELSE concat(source, '-') END,
       l_linenumber, '-', l_partkey + 1, '-', {_SLUG}) ELSE url END AS card_url,
       CASE WHEN v = 0 THEN concat(brand, '|', model, '|', preis, '|', kilometer, '|', ez) ELSE url END AS entry_key
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS).withColumns(
        {
            "link": F.when(F.col("v") == 0, F.lit("")).otherwise(F.col("url")),
            "home": F.concat(F.lit(f"https://{_HOME}/D"), F.col("l_suppkey").cast("string"), F.lit("/")),
        }
    )
    made = U.synthetic_url(
        F.col("home"), F.col("l_linenumber") - 1, F.col("l_partkey"), F.col("brand"), F.col("model"), F.col("source")
    )
    return rows.select(
        "lkey",
        F.when(F.col("link") == "", made).otherwise(F.col("link")).alias("card_url"),
        U.entry_key(F.col("link"), *[F.col(c) for c in ("brand", "model", "preis", "kilometer", "ez")]).alias("entry_key"),
    )


_STATES = [*fixed.STATE_LABELS, "neu-land", "x"]
_STATE_ROWS = (
    f"SELECT s_suppkey, CASE CAST(s_suppkey % {len(_STATES)} AS INT) "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STATES))
    + " END AS slug FROM supplier"
)
_STATE_LABELS = [*fixed.STATE_LABELS.values(), "Neu Land", "X"]


@query(
    "state_labels",
    f"SELECT s_suppkey, CASE CAST(s_suppkey % {len(_STATES)} AS INT) "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STATE_LABELS))
    + " END AS state FROM supplier",
)
def _(spark, sf_dir):
    return run(spark, sf_dir, _STATE_ROWS).select("s_suppkey", U.state_label("slug").alias("state"))


_SETTINGS = """
SELECT c_custkey, c_mktsegment AS state, c_custkey % 7 AS max_vendors, c_nationkey AS max_cars_per_vendor,
       c_custkey % 3 AS max_pages_per_state, c_custkey % 2 = 0 AS skip_vehicle_details,
       true AS traverse_vehicle_categories, 'auto' AS category_traversal, 'auto' AS fetch_strategy,
       'sqlite' AS pipeline_mode, CASE WHEN c_custkey % 2 = 0 THEN 'always' ELSE 'never' END AS detail_policy,
       'chromium' AS browser, 'headed' AS browser_mode
FROM customer
"""
_JSON_PARTS = ", ', ', ".join(
    f"'\"{k}\": ', "
    + (
        f"CAST({k} AS VARCHAR)"
        if k.startswith("max_") or k in ("skip_vehicle_details", "traverse_vehicle_categories")
        else f"'\"', {k}, '\"'"
    )
    for k in fixed.CONFIG_FINGERPRINT_KEYS
)


@query(
    "config_fingerprints",
    f"SELECT c_custkey, sha256(concat('{{', {_JSON_PARTS}, '}}')) AS config_hash FROM ({_SETTINGS})",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _SETTINGS)
    settings = F.struct(*[F.col(k) for k in fixed.CONFIG_FINGERPRINT_KEYS])
    return rows.select("c_custkey", U.config_fingerprint(settings).alias("config_hash"))


# -- titles, attributes, matches ------------------------------------------------------

_TITLES = f"""
SELECT lkey, brand, model, v,
       CASE v WHEN 0 THEN concat('NEU', brand, ' ', model) WHEN 1 THEN concat('  ', upper(brand), '   ', model)
              WHEN 2 THEN concat('NEU ', brand, '  ', model, ' Sport') WHEN 3 THEN model
              WHEN 4 THEN '' ELSE concat(brand, ' ', model, ' für 12.300 € bei Händler') END AS title
FROM ({BASE})
"""
_BRAND_VALUES = ", ".join(
    f"('{b}', {i})" for i, b in enumerate(sorted(fixed.KNOWN_BRANDS, key=len, reverse=True))
)


@query(
    "title_split",
    f"""
WITH brands(name, ord) AS (VALUES {_BRAND_VALUES}),
cleaned AS (SELECT lkey, {clean_sql('title')} AS t FROM ({_TITLES})),
distinct_titles AS (SELECT DISTINCT t FROM cleaned),
unbadged AS (
  SELECT t, CASE WHEN starts_with(upper(t), 'NEU') AND EXISTS (
      SELECT 1 FROM brands WHERE starts_with(lower(ltrim(substr(t, 4))), lower(name)))
    THEN ltrim(substr(t, 4)) ELSE t END AS u FROM distinct_titles),
matched AS (
  SELECT t, u, (SELECT arg_min(name, ord) FROM brands WHERE starts_with(lower(u), lower(name))) AS b FROM unbadged)
SELECT lkey, coalesce(b, split_part(u, ' ', 1)) AS brand,
       CASE WHEN b IS NOT NULL THEN trim(substr(u, length(b) + 1))
            WHEN strpos(u, ' ') > 0 THEN substr(u, strpos(u, ' ') + 1) ELSE '' END AS model,
       trim(regexp_replace(c.t, '\\s+für\\s+\\d[\\d.]*,?\\d*\\s*€.*$', '')) AS no_price
FROM cleaned c JOIN matched m ON c.t = m.t
""".replace("\\\\", "\\"),
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _TITLES).withColumn("split", titles.split_title("title"))
    return rows.select("lkey", "split.brand", "split.model", titles.without_price("title").alias("no_price"))


_CARDS = f"""
SELECT lkey, v, vtype, kilometer, ez, leistung,
       concat(CASE v WHEN 0 THEN 'Unfallfrei' WHEN 1 THEN 'Vorführfahrzeug' WHEN 2 THEN concat('EZ ', ez)
              WHEN 3 THEN vtype WHEN 4 THEN 'NICHT FAHRTAUGLICH' ELSE leistung END,
              ' • EZ ', ez, ' • ', kilometer, ' • ', leistung, ' • DIESEL • Automatik • Euro 6d') AS line
FROM ({LISTINGS})
"""


@query(
    "card_attributes",
    f"""
SELECT lkey, CASE v WHEN 0 THEN 'Unfallfrei' WHEN 1 THEN 'Vorführfahrzeug' WHEN 4 THEN 'NICHT FAHRTAUGLICH' ELSE '' END AS condition,
       CASE WHEN v = 3 THEN vtype ELSE '' END AS type,
       kilometer AS km,
       CASE WHEN v = 1 THEN '' ELSE ez END AS ez,
       CASE WHEN v = 4 THEN '' ELSE leistung END AS power,
       'DIESEL' AS fuel, 'Automatik' AS gear, 'Euro 6d' AS euro
FROM ({_CARDS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _CARDS).withColumn("f", titles.attribute_fields("line"))
    return rows.select(
        "lkey",
        "f.condition",
        "f.type",
        T.first_match("line", fixed.KM_PATTERN).alias("km"),
        F.replace(T.first_match("line", fixed.DATE_PATTERN), F.lit("EZ "), F.lit("")).alias("ez"),
        T.first_match("line", fixed.POWER_PATTERN).alias("power"),
        T.first_match("line", fixed.FUEL_PATTERN).alias("fuel"),
        T.first_match("line", fixed.GEAR_PATTERN).alias("gear"),
        T.first_match("line", fixed.EMISSION_CLASS_PATTERN).alias("euro"),
    )


_CITIES = ["Köln", "Bad Homburg", "München", "Frankfurt am Main"]
_ADDRESS = f"""
SELECT c_custkey, {'CASE CAST(c_custkey % 4 AS INT) ' + ' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CITIES)) + ' END'} AS city,
       lpad(CAST(c_custkey * 37 % 100000 AS STRING), 5, '0') AS plz, c_custkey % 90 + 1 AS no
FROM customer
"""


@query(
    "address_split",
    f"""
SELECT c_custkey, concat('Lange Straße ', no, 'a') AS street, plz, city,
       CASE WHEN c_custkey % 3 = 0 THEN concat('+49 0221 ', plz) WHEN c_custkey % 3 = 1 THEN concat('+49', plz) ELSE concat('0221 ', plz) END AS phone
FROM ({_ADDRESS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _ADDRESS)
    line = F.concat(
        F.lit("Lange Straße "), F.col("no").cast("string"), F.lit("a, DE-"), F.col("plz"),
        F.lit(" "), F.col("city"), F.lit(" Kontakt 0221"),
    )
    third = F.col("c_custkey") % 3
    none = F.lit("")
    phone = T.phone_from_parts(
        F.when(third == 0, F.lit("49")).otherwise(none),
        F.when(third != 1, F.lit("0221")).otherwise(none),
        F.when(third != 1, F.col("plz")).otherwise(none),
        F.when(third == 1, F.concat(F.lit("49"), F.col("plz"))).otherwise(none),
    )
    return rows.select("c_custkey", T.address_parts(line).alias("a"), phone.alias("phone")).select(
        "c_custkey", "a.street", "a.plz", "a.city", "phone"
    )


@query(
    "rate_suffixes",
    f"""
SELECT lkey, CASE v WHEN 0 THEN concat(price, ' € mtl.') WHEN 1 THEN concat(price, ' € MTL') WHEN 2 THEN CAST(price AS VARCHAR) WHEN 3 THEN ''
       ELSE concat(price, ' € mtl.') END AS rate,
       CASE v WHEN 0 THEN concat(months, ' Monate') WHEN 1 THEN concat(months, ' months') WHEN 2 THEN concat(months, ' Monate') WHEN 3 THEN ''
       ELSE concat(months, ' Monate') END AS term,
       CASE WHEN v = 3 THEN '' ELSE concat(price, ' €') END AS label
FROM ({BASE})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, BASE)
    price, months, v = F.col("price").cast("string"), F.col("months").cast("string"), F.col("v")
    euro = F.concat(price, F.lit(" €"))
    rate = (
        F.when(v == 1, F.concat(euro, F.lit(" MTL")))
        .when(v == 2, price)
        .when(v == 3, F.lit("undefined"))
        .otherwise(euro)
    )
    term = (
        F.when(v == 1, F.concat(months, F.lit(" months")))
        .when(v == 2, F.concat(months, F.lit(" Monate")))
        .when(v == 3, F.lit("null"))
        .otherwise(months)
    )
    label = F.when(v == 3, F.lit("¹²")).otherwise(F.concat(euro, F.lit("¹ ³")))
    return rows.select(
        "lkey",
        T.monthly_rate(rate).alias("rate"),
        T.credit_term(term).alias("term"),
        T.without_footnotes(label).alias("label"),
    )
