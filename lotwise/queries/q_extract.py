"""Queries over page extraction.

The given pages hold headings, links and scripts, but no lists, tables or
payloads; where an operator needs those, the query renders them around the numbers
of the listings, one page per listing or per group of listings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import html as H
from lotwise.functions import payload as J
from lotwise.functions import text as T
from lotwise.operators import audit, cards, payloads, specs
from lotwise.queries.base import BASE, BLANKS, LISTINGS, clean_sql, pick, query, run, s, table
from lotwise.site import DEFAULT_SITE

# -- the given pages ---------------------------------------------------------------

def text_sql(x: str) -> str:
    """Visible text of markup, in DuckDB SQL."""
    hidden = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
    t = f"regexp_replace(regexp_replace({x}, '{hidden}', ' ', 'g'), '</?[a-zA-Z!][^>]*>', ' ', 'g')"
    for entity, char in H.ENTITIES.items():
        t = f"replace({t}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({t}, '{BLANKS}', ' ', 'g'))"


@query(
    "page_text",
    f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {text_sql('html')} AS t FROM pages)",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("t", H.markup_text(F.col("html")))
    return rows.select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text_md5"))


_LINKED = f"""
SELECT page_id, concat(html, '<a class="x" href="/fahrzeuge/details.html?id=', {s('20000000 + page_id')}, '&amp;s=1">a</a>',
  '<a href=''https://suchen.marktplatz.example/auto-inserat/', {s('page_id')}, '''>b</a>',
  '<a href="/fahrzeuge/details.html?id=', {s('20000000 + page_id')}, '&amp;s=1">again</a>',
  '<a href="mailto:x@/auto-inserat/">m</a>',
  '<script>self.__next_f.push([1,"2:{{\\\\"b\\\\":{{\\\\"listingId\\\\":', {s('30000000 + page_id')}, ',\\\\"x\\\\":[{{\\\\"listingId\\\\":\\\\"', {s('page_id % 10')}, '\\\\"}}]}}}}"])</script>',
  '<i data="', '"listingId": ', {s('500000 + page_id')}, '"></i>') AS html FROM pages
"""


@query(
    "page_links",
    """
SELECT page_id, pos, url FROM (
  SELECT page_id, unnest([
    {'pos': 0, 'url': concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', 20000000 + page_id, '&s=1')},
    {'pos': 1, 'url': concat('https://suchen.marktplatz.example/auto-inserat/', page_id)},
    {'pos': 2, 'url': concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', 30000000 + page_id)},
    {'pos': 3, 'url': concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', 500000 + page_id)}], recursive := true)
  FROM pages)
""",
)
def _(spark, sf_dir):
    pages = payloads.with_payloads(run(spark, sf_dir, _LINKED))
    return payloads.detail_links(pages, "page_id")


@query(
    "page_titles",
    f"""
WITH t AS (SELECT page_id, {text_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h FROM pages)
SELECT page_id, split_part(h, ' ', 1) AS brand, CASE WHEN strpos(h, ' ') > 0 THEN substr(h, strpos(h, ' ') + 1) ELSE '' END AS model
FROM t
""",
)
def _(spark, sf_dir):
    rows = specs.with_title_and_price(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "brand", "model")


_HOME = "home.marktplatz.example"
_DIRECTORY = f"""
SELECT page_id, concat('<ul><li><a href="https://{_HOME}/Auto', {s('page_id')}, '"><b>Auto ', {s('page_id')}, ' GmbH</b></a> Lange Str. ',
  {s('page_id % 90 + 1')}, ', ', lpad({s('page_id * 37 % 100000')}, 5, '0'), ' Köln</li><li><a href="/impressum">I</a></li>',
  '<li><a href="/zweite', {s('page_id')}, '">Zweite</a></li></ul><script>var u="https://{_HOME}/Dritte', {s('page_id')}, '";</script>', html) AS html
FROM pages
"""


@query(
    "page_dealers",
    f"""
SELECT page_id, unnest([
  {{'name': concat('Auto ', page_id, ' GmbH'), 'url': concat('https://{_HOME}/AUTO', page_id), 'street': concat('Auto ', page_id, ' GmbH Lange Str. ', page_id % 90 + 1), 'plz': lpad(CAST(page_id * 37 % 100000 AS VARCHAR), 5, '0'), 'city': 'Köln'}},
  {{'name': 'Zweite', 'url': concat('https://{_HOME}/ZWEITE', page_id), 'street': '', 'plz': '', 'city': ''}},
  {{'name': '', 'url': concat('https://{_HOME}/DRITTE', page_id), 'street': '', 'plz': '', 'city': ''}}], recursive := true)
FROM pages
UNION ALL SELECT page_id, arg_max(word, place), concat('https://{_HOME}/', path), '', '', ''
FROM (SELECT *, upper(replace(word, 'ß', 'ss')) AS path FROM (SELECT page_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"/]+)">[^<]*</a></li>', 1) AS words FROM pages)))
WHERE length(path) > 1 GROUP BY page_id, path
""",
)
def _(spark, sf_dir):
    pages = run(spark, sf_dir, _DIRECTORY)
    # Navigation links of the given pages are relative and look like dealers too.
    return specs.directory_dealers(pages, "page_id")


_MARKED_PAGES = f"""
SELECT page_id,
  CASE CAST(page_id % 8 AS INT) WHEN 1 THEN concat(html, '<!-- px-captcha -->') WHEN 2 THEN '<p>x</p>'
    WHEN 3 THEN concat('<h1>BMW 320d</h1><span data-testid="price-label">', {s('page_id')}, '.500 €¹</span><p>Technische Daten</p>', html)
    WHEN 4 THEN concat('<h1>VW Golf</h1><dl><dt>Hubraum</dt><dd>1.498 cm³</dd></dl><p>Kilometerstand</p>', html)
    WHEN 5 THEN concat('<h1></h1>', regexp_replace(html, '<(h1|title)[^>]*>.*</(h1|title)>', ''))
    ELSE html END AS html,
  CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'about:blank' WHEN 3 THEN 'https://suchen.marktplatz.example/fahrzeuge/details.html?id=1'
    WHEN 5 THEN 'https://suchen.marktplatz.example/fahrzeuge/details.html?id=2'
    WHEN 6 THEN 'https://suchen.marktplatz.example/fahrzeuge/search.html?x=1' ELSE url END AS url
FROM pages
"""


@query(
    "page_class",
    """
SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'blank_page' WHEN 1 THEN 'error_page' WHEN 2 THEN 'blank_page'
    WHEN 3 THEN 'real_detail_page' WHEN 4 THEN 'real_detail_page' WHEN 6 THEN 'listing_page' ELSE 'unknown' END AS classification,
  CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'blank_or_too_short' WHEN 1 THEN 'px-captcha' WHEN 2 THEN 'blank_or_too_short'
    WHEN 3 THEN 'detail_url_with_vehicle_signals' WHEN 4 THEN 'vehicle_signals_without_detail_url'
    WHEN 5 THEN 'detail_url_without_enough_vehicle_signals' WHEN 6 THEN 'search_listing_url'
    ELSE 'no_known_detail_or_error_signals' END AS reason,
  CASE WHEN page_id % 8 = 3 THEN concat(page_id, '.500 €') END AS price
FROM pages
""",
)
def _(spark, sf_dir):
    done = specs.classify_pages(run(spark, sf_dir, _MARKED_PAGES))
    return done.select(
        "page_id", "classification", "reason", F.when(F.col("page_id") % 8 == 3, F.col("signals")["price"]).alias("price")
    )


@query(
    "entity_valid",
    """
SELECT page_id, CASE WHEN page_id % 8 IN (3, 4) THEN '' WHEN page_id % 8 IN (2, 5) THEN 'missing_vehicle_title_in_static_html'
  ELSE 'missing_vehicle_fields_in_static_html' END AS invalid_reason, page_id % 8 IN (3, 4) AS valid FROM pages
""",
)
def _(spark, sf_dir):
    return specs.static_vehicle(run(spark, sf_dir, _MARKED_PAGES)).select("page_id", "invalid_reason", "valid")


@query(
    "vendor_valid",
    """
SELECT c_custkey, ok AS valid, CASE WHEN ok THEN '' ELSE 'missing_vendor_fields_in_static_html' END AS invalid_reason
FROM (SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 4 = 0) AS ok FROM customer)
""",
)
def _(spark, sf_dir):
    key = F.col("c_custkey")

    def unless(missing, value):
        return F.when(missing, F.lit("")).otherwise(value)

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = rows.withColumns(
        {
            "Händlername": unless(key % 7 == 0, F.col("c_name")),
            DEFAULT_SITE.link_field: F.concat(F.lit(f"https://{_HOME}/V"), key.cast("string")),
            "PLZ": unless((key % 5 == 0) | (key % 2 == 0), F.lit("50667")),
            "Städte": unless((key % 5 == 0) | (key % 2 == 1), F.lit("Köln")),
            "Telephone Number": unless(key % 3 != 0, F.concat(F.lit("0221 "), key.cast("string"))),
            "Email ID": F.lit(""),
            "Hauptseite": F.lit(None).cast("string"),
            fixed.VENDOR_COUNT_FIELD: F.when(key % 4 == 0, F.lit(0)),
        }
    )
    return specs.static_vendor(rows).select("c_custkey", "valid", "invalid_reason")


_DIRECTORIES = f"""
SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN concat('<ul><li><a href="https://{_HOME}/Auto', {s('page_id')}, '">A</a></li></ul>')
  WHEN 1 THEN '<ul><li><a href="/impressum">I</a></li></ul>' WHEN 2 THEN concat('<script>var u="https://{_HOME}/Dritte', {s('page_id')}, '";</script>') END AS html
FROM pages
"""


@query(
    "directory_valid",
    """
SELECT page_id, page_id % 2 = 0 AS valid, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'no_dealers_in_static_html' END AS invalid_reason FROM pages
""",
)
def _(spark, sf_dir):
    return specs.static_directory(run(spark, sf_dir, _DIRECTORIES)).select("page_id", "valid", "invalid_reason")


# -- detail pages ---------------------------------------------------------------------

_DL = f"""
SELECT lkey, l_linenumber, v, co2_text, hubraum, ez, zins, laufzeit, preis, model, brand, leistung, kilometer,
  concat('<dl class="d"><dt>CO2-Emissionen (kombiniert):</dt><dd>', co2_text, '</dd><dt> Hubraum</dt>\n<dd><b>', hubraum,
    '</b></dd><dt>Unbekannt</dt><dd>x</dd><dt>Vorbesitzer</dt><dd>', {s('l_linenumber')}, '</dd><dt>Hubraum</dt><dd>1 cm³</dd><dt>Farbe</dt></dl>') AS dl,
  concat('<table><tr><th>Erstzulassung:</th><td>', ez, '</td></tr><tr><td>nur eine</td></tr><tr><td>FARBE</td><td><i>Rot &amp; Blau</i></td><td>z</td></tr></table>') AS tab
FROM ({LISTINGS})
"""


@query(
    "spec_pairs_dl",
    f"""
SELECT lkey, pos, label, value FROM (SELECT lkey, unnest([
  {{'pos': 0, 'label': 'CO2-Emissionen (kombiniert)', 'value': co2_text}}, {{'pos': 1, 'label': 'Hubraum', 'value': hubraum}},
  {{'pos': 2, 'label': 'Unbekannt', 'value': 'x'}}, {{'pos': 3, 'label': 'Vorbesitzer', 'value': CAST(l_linenumber AS VARCHAR)}},
  {{'pos': 4, 'label': 'Hubraum', 'value': '1 cm³'}}, {{'pos': 5, 'label': 'Farbe', 'value': ''}}], recursive := true) FROM ({_DL}))
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DL).withColumn("pairs", H.definition_pairs(F.col("dl")))
    return rows.select("lkey", F.posexplode_outer("pairs").alias("pos", "p")).select("lkey", "pos", "p.label", "p.value")


@query(
    "spec_pairs_table",
    f"""
SELECT lkey, pos, label, value FROM (SELECT lkey, unnest([
  {{'pos': 0, 'label': 'Erstzulassung', 'value': ez}}, {{'pos': 1, 'label': 'FARBE', 'value': 'Rot & Blau'}}], recursive := true) FROM ({_DL}))
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DL).withColumn("pairs", H.table_pairs(F.col("tab")))
    return rows.select("lkey", F.posexplode_outer("pairs").alias("pos", "p")).select("lkey", "pos", "p.label", "p.value")


_FLAT = f"""
SELECT lkey, co2, months, l_linenumber, model, kw, km, ps, yr, mon,
  concat('<div>Baureihe</div><div>', model, '</div><p>Farbe: Rot ', {s('l_linenumber')}, '</p><span>Anzahl der Türen</span> <b>4/5</b>') AS flat,
  concat('<script>window.__INITIAL_STATE__ = {{"a":{{"attributes":[{{"label":"Hubraum","value":"', {s('co2')}, ' cm³"}},{{"tag":"numSeats","value":"', {s('l_linenumber')},
    '"}},{{"tag":"other","value":"z"}},{{"label":"Baureihe","value":"undefined"}}]}}}}; more();</script>') AS state,
  concat('<script>self.__next_f.push([1,"7:[\\\\"Farbe (Hersteller): Tief ', {s('l_linenumber')}, '\\\\",{{\\\\"k\\\\":\\\\"', {s('kw')}, ' kW (', {s('ps')}, ' PS)\\\\"}},\\\\"', repeat('x', 210), '\\\\"]"])</script>') AS pushed,
  concat('<p>Nur ', {s('km')}, ' km, ', {s('kw')}, ' kW, EZ ', lpad({s('mon')}, 2, '0'), '/', {s('yr')}, ', diesel, Automatik, ', {s('co2')}, ' g/km, 1998 cm³ Motor.</p>',
    '<p>Ausstattungslinie Sport ', model, ' S 123 extra Paket, mehr</p>') AS words
FROM ({BASE})
"""


@query(
    "spec_neighbours",
    f"""
SELECT lkey, label, value FROM (SELECT lkey, unnest([{{'label': 'Baureihe', 'value': model}},
  {{'label': 'Farbe', 'value': concat('Rot ', l_linenumber)}}, {{'label': 'Anzahl der Türen', 'value': '4/5'}}], recursive := true) FROM ({BASE}))
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FLAT).withColumn("m", specs.first_values(specs.neighbour_pairs(H.leaf_texts(F.col("flat")))))
    return rows.select("lkey", F.explode_outer("m").alias("label", "value"))


@query(
    "spec_state",
    f"""
SELECT lkey, label, value FROM (SELECT lkey, unnest([{{'label': 'Hubraum', 'value': concat(co2, ' cm³')}},
  {{'label': 'Anzahl Sitzplätze', 'value': CAST(l_linenumber AS VARCHAR)}}], recursive := true) FROM ({BASE}))
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FLAT).withColumn(
        "o", J.objects_with(specs.initial_state_text(F.col("state")), ["label", "tag"], prefix=True)
    )
    rows = rows.withColumn("m", specs.first_values(specs.state_pairs(F.col("o"))))
    return rows.select("lkey", F.explode_outer("m").alias("label", "value"))


@query(
    "spec_payload_text",
    f"""
SELECT lkey, concat('Tief ', l_linenumber, ' ', kw, ' kW (', ps, ' PS)') AS colour, concat(kw, ' kW (', ps, ' PS)') AS power FROM ({BASE})
""",
)
def _(spark, sf_dir):
    rows = specs.with_specs(run(spark, sf_dir, _FLAT, spread=True).withColumnRenamed("pushed", "html"))
    return rows.select(
        "lkey", F.col("specs")["Farbe (Hersteller)"].alias("colour"), F.col("specs")["Leistung"].alias("power")
    )


@query(
    "quick_stats",
    f"""
SELECT lkey, CAST(km AS VARCHAR) AS km, concat(kw, ' kW') AS power, concat(lpad(CAST(mon AS VARCHAR), 2, '0'), '/', yr) AS ez,
  'diesel' AS fuel, 'Automatik' AS gear, concat(co2, ' g/km') AS co2, '1998 cm³' AS ccm, CASE WHEN model IN ('208', '320 Touring') THEN 'Sport' ELSE concat('Sport ', model, ' S') END AS trim_line
FROM ({BASE})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _FLAT, spread=True).withColumn("t", H.markup_text(F.col("words")))
    rows = rows.withColumn("m", specs.first_values(specs.quick_stats(F.col("t"))))
    m = F.col("m")
    return rows.select(
        "lkey", m["Kilometerstand"].alias("km"), m["Leistung"].alias("power"), m["Erstzulassung"].alias("ez"),
        m["Kraftstoffart"].alias("fuel"), m["Getriebe"].alias("gear"), m["CO₂-Emissionen"].alias("co2"),
        m["Hubraum"].alias("ccm"), specs.trim_line(F.col("t")).alias("trim_line"),
    )


_DETAIL = f"""
SELECT d.lkey, l_linenumber, v, co2_text, hubraum, ez, model, brand, zins, laufzeit, preis,
  concat('<html><head><title>t</title></head><body><h1>', CASE WHEN brand = '' THEN 'Marke' ELSE brand END, ' ', model, ' für 1.000 €</h1>',
    '<div><span class="x" data-testid="price-label">', CASE WHEN preis IN ('', 'nan') THEN 'auf Anfrage' ELSE preis END, '¹</span></div>',
    dl, tab, '<dl><dt>Bank</dt><dd>Santander</dd><dt>Sollzins</dt><dd>1,00%</dd><dt>Fester Sollzins p.a.</dt><dd>', zins, '</dd></dl>',
    '<p>Monatsrate: ', {s('l_linenumber')}, '49 € mtl.</p></body></html>') AS html
FROM ({_DL}) d
"""


@query(
    "spec_first_wins",
    f"""
SELECT lkey, label, value FROM (SELECT lkey, unnest([{{'label': 'CO₂-Emissionen', 'value': co2_text}}, {{'label': 'Hubraum', 'value': hubraum}},
  {{'label': 'Anzahl der Fahrzeughalter', 'value': CAST(l_linenumber AS VARCHAR)}}, {{'label': 'Erstzulassung', 'value': ez}},
  {{'label': 'Farbe', 'value': 'Rot & Blau'}}], recursive := true) FROM ({_DL})) WHERE value <> ''
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DL, spread=True).withColumn(
        "m", specs.first_values(F.concat(H.definition_pairs(F.col("dl")), H.table_pairs(F.col("tab"))))
    )
    return rows.select("lkey", F.explode_outer("m").alias("label", "value"))


@query(
    "financing_pairs",
    f"""
SELECT lkey, label, value FROM (SELECT lkey, unnest([{{'label': 'Bank', 'value': 'Santander'}}, {{'label': 'Fester Sollzins p.a.', 'value': zins}},
  {{'label': 'Financing', 'value': concat(l_linenumber, '49 € mtl.')}}], recursive := true) FROM ({_DETAIL}))
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DETAIL, spread=True).withColumn("page_text", H.markup_text(F.col("html")))
    rows = specs.with_financing(rows)
    return rows.select("lkey", F.explode_outer("financing").alias("label", "value"))


@query(
    "page_prices",
    f"""
SELECT lkey, CASE WHEN preis IN ('', 'nan') THEN '1.000 €' ELSE preis END AS price,
  'Y 3' AS ld_name, concat(l_linenumber, '.5 €') AS ld_price
FROM ({_DETAIL})
""",
)
def _(spark, sf_dir):
    rows = specs.with_title_and_price(run(spark, sf_dir, _DETAIL, spread=True)).select("lkey", "l_linenumber", "price")
    ld = F.concat(
        F.lit('<script type="application/ld+json">[{"@type":"Thing"},{"@type":"Car","name":"X Y 3","brand":{"name":"X"},"offers":{"price":'),
        F.col("l_linenumber").cast("string"), F.lit(".5}}]</script>"),
    )
    rows = rows.select("lkey", F.col("price").alias("p"), ld.alias("html"))
    done = specs.with_title_and_price(rows)
    return done.select("lkey", F.col("p").alias("price"), F.col("model").alias("ld_name"), F.col("price").alias("ld_price"))


@query(
    "detail_records",
    f"""
SELECT lkey, CASE WHEN brand = '' THEN 'Marke' WHEN brand = 'VW Nutzfahrzeuge' THEN 'VW' WHEN brand = 'KGM' THEN 'KGM' WHEN brand = 'Unbekannt' THEN 'Unbekannt' ELSE brand END AS markes,
  CASE WHEN brand = 'VW Nutzfahrzeuge' THEN concat('Nutzfahrzeuge ', model) ELSE model END AS models,
  CASE WHEN preis IN ('', 'nan') THEN '1.000 €' ELSE preis END AS preis,
  CASE WHEN co2_text = '' THEN NULL ELSE co2_text END AS co2, hubraum, CAST(l_linenumber AS VARCHAR) AS halter, ez, 'Rot & Blau' AS farbe,
  'Santander' AS bank, zins, concat(l_linenumber, '49 € mtl.') AS rate
FROM ({_DETAIL})
""",
)
def _(spark, sf_dir):
    done = specs.detail_records(run(spark, sf_dir, _DETAIL, spread=True), "lkey")
    return done.select(
        "lkey", F.col("Markes").alias("markes"), F.col("Models").alias("models"), F.col("Preis").alias("preis"),
        F.nullif(F.col("CO₂-Emissionen"), F.lit("")).alias("co2"), F.col("Hubraum").alias("hubraum"),
        F.col("Anzahl der Fahrzeughalter").alias("halter"), F.col("Erstzulassung").alias("ez"),
        F.col("Farbe").alias("farbe"), F.col("Bank").alias("bank"),
        F.col("`Fester Sollzins p.a.`").alias("zins"), F.col("Finanzierung").alias("rate"),
    )


@query(
    "target_fields",
    f"""
SELECT lkey, field, value FROM (SELECT lkey, unnest([{{'field': 'CO₂-Emissionen', 'value': co2_text}},
  {{'field': 'Anzahl der Fahrzeughalter', 'value': CAST(l_linenumber AS VARCHAR)}}], recursive := true) FROM ({_DL})) WHERE value <> ''
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _DL, spread=True).select("lkey", F.col("dl").alias("html"))
    return specs.target_fields(rows, "lkey")


# -- listing payloads ------------------------------------------------------------------

# One inventory page per order: its line items are the listings.
_SEARCH = f"""
SELECT l_orderkey, l_linenumber, lkey, listing, brand, model, price, km, kw, ps, co2, yr, mon, months, rate, v, source,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lkey) - 1 AS pos
FROM ({BASE})
"""


def _inventory_pages(spark, sf_dir):
    """Pages whose script payload lists the order's line items, built with to_json."""
    rows = run(spark, sf_dir, _SEARCH)
    v = F.col("v")
    text = lambda c: F.col(c).cast("string")
    listing = F.struct(
        F.when(v != 5, F.col("listing")).alias("id"),
        F.when(v == 5, text("listing")).alias("listingId"),
        F.when(v != 1, F.concat_ws(" ", "brand", "model")).alias("title"),
        F.when(v == 1, F.col("model")).alias("shortTitle"),
        F.struct(F.col("brand").alias("localized")).alias("make"),
        F.struct(F.col("model").alias("localized")).alias("model"),
        F.nullif(F.col("source"), F.lit("")).alias("vc"),
        F.when(v == 3, F.lit("SmallCar")).otherwise(F.lit("$undefined")).alias("category"),
        F.struct(
            F.concat(text("km"), F.lit(" km")).alias("ml"),
            F.concat_ws("/", F.lpad(text("mon"), 2, "0"), text("yr")).alias("fr"),
            F.when(v != 2, F.concat(text("kw"), F.lit(" kW"))).alias("pw"),
            F.when(v == 2, F.concat(text("kw"), F.lit(" kW"))).alias("power"),
            F.when(v == 4, F.concat(text("co2"), F.lit(" g/km"))).alias("co2"),
            text("l_linenumber").alias("pvo"),
        ).alias("attr"),
        F.concat(F.lit("Verbrauch "), text("co2"), F.lit(" g/km")).alias("note"),
        (v == 1).alias("hasDamage"),
        F.when(v == 2, F.lit(False)).alias("readyToDrive"),
        F.when(
            v != 0,
            F.struct(
                F.when(v == 3, F.struct(F.concat(text("price"), F.lit(" €")).alias("localized"))).alias("grs"),
                F.struct(F.concat(text("price"), F.lit(" € netto")).alias("localized")).alias("nt"),
            ),
        ).alias("price"),
        F.when(v == 0, F.concat(text("price"), F.lit(" €"))).alias("p"),
        F.when(
            v == 3,
            F.array(
                F.struct(
                    F.struct(
                        F.lit("Santander").alias("bankName"),
                        F.lit("null").alias("loanBroker"),
                        text("rate").alias("downPayment"),
                        F.struct(
                            F.concat(text("months"), F.lit(" €")).alias("monthlyInstallment"),
                            text("months").alias("creditTerm"),
                            F.concat(text("rate"), F.lit("%")).alias("interestRateNominal"),
                        ).alias("localized"),
                    ).alias("offer")
                )
            ),
        ).alias("financePlans"),
    )
    pages = rows.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", listing.alias("l")))), lambda x: x["l"]).alias("ls")
    )
    inner = F.to_json(
        F.struct(F.struct(F.struct(F.size("ls").alias("numResultsTotal"), F.col("ls").alias("listings")).alias("searchResults")).alias("page"))
    )
    outer = F.to_json(F.array(F.concat(F.lit("29:"), inner)))
    html = F.concat(
        F.lit("<html><body><p>Bestand</p><script>self.__next_f.push([1,"),
        F.substring(outer, F.lit(2), F.length(outer) - 2),
        F.lit("])</script></body></html>"),
    )
    return payloads.with_payloads(pages.select("l_orderkey", html.alias("html")))


_URL = "concat('https://suchen.marktplatz.example/fahrzeuge/details.html?id=', listing)"
_TYPE_SQL = (
    "CASE WHEN source IN ('Car', 'Motorhome') THEN CASE WHEN v = 3 THEN 'Kleinwagen' WHEN source = 'Car' THEN 'PKW' ELSE 'Wohnmobil andere' END "
    "WHEN source = 'VanUpTo7500' THEN 'Transporter und Lkw bis 7,5 t' WHEN source = 'ForkliftTruck' THEN 'Stapler' WHEN source = 'Trailer' THEN 'Anhänger' "
    "WHEN v = 3 THEN 'Kleinwagen' ELSE '' END"
)
_PRICE_SQL = "CASE WHEN v IN (0, 3) THEN concat(price, ' €') ELSE concat(price, ' € netto') END"
_FIRST_WORD = "CASE WHEN strpos(model, ' ') > 0 THEN split_part(model, ' ', 1) ELSE model END"
_SEARCH_COLUMNS = f"""
  {_URL} AS url, CASE WHEN brand <> '' THEN brand ELSE {_FIRST_WORD} END AS markes,
  model AS models, {_TYPE_SQL} AS fahrzeugtyp,
  CASE WHEN v = 1 THEN 'Beschädigt' WHEN v = 2 THEN 'Nicht fahrtauglich' ELSE 'Unfallfrei' END AS zustand,
  concat(lpad(CAST(mon AS VARCHAR), 2, '0'), '/', yr) AS ez, concat(km, ' km') AS km, concat(kw, ' kW') AS power,
  concat(co2, ' g/km') AS co2, {_PRICE_SQL} AS preis, CAST(l_linenumber AS VARCHAR) AS halter"""


@query(
    "payload_listings",
    f"SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, {_SEARCH_COLUMNS} FROM ({_SEARCH})",
)
def _(spark, sf_dir):
    raw = payloads.search_listings(_inventory_pages(spark, sf_dir), "l_orderkey")
    rows = raw.withColumn("parsed", F.from_json("listing", payloads._LISTING))
    c = payloads.listing_columns(F.col("parsed"), F.col("listing"))
    names = {
        "url": "Vehicle_URL", "markes": "Markes", "models": "Models", "fahrzeugtyp": "Fahrzeugtyp",
        "zustand": "Fahrzeugzustand", "ez": "Erstzulassung", "km": "Kilometerstand", "power": "Leistung",
        "co2": "CO₂-Emissionen", "preis": "Preis", "halter": "Anzahl der Fahrzeughalter",
    }
    return rows.select("l_orderkey", "pos", *[c[f].alias(n) for n, f in names.items()])


@query(
    "payload_financing",
    f"""
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, CASE WHEN v = 3 THEN concat(months, ' € mtl.') ELSE '' END AS financing,
  CASE WHEN v = 3 THEN 'Santander' ELSE '' END AS bank, '' AS broker, CASE WHEN v = 3 THEN concat(price, ' €') ELSE '' END AS vehicle_price,
  CASE WHEN v = 3 THEN CAST(rate AS VARCHAR) ELSE '' END AS down, CASE WHEN v = 3 THEN concat(rate, '%') ELSE '' END AS nominal,
  CASE WHEN v = 3 THEN concat(months, ' Monate') ELSE '' END AS term
FROM ({_SEARCH})
""",
)
def _(spark, sf_dir):
    raw = payloads.search_listings(_inventory_pages(spark, sf_dir), "l_orderkey")
    rows = raw.withColumn("parsed", F.from_json("listing", payloads._LISTING))
    c = payloads.listing_columns(F.col("parsed"), F.col("listing"))
    names = {
        "financing": "Financing", "bank": "Bank", "broker": "Darlehensvermittler", "vehicle_price": "Fahrzeugpreis",
        "down": "Anzahlung", "nominal": "Fester Sollzins p.a.", "term": "Laufzeit",
    }
    return rows.select("l_orderkey", "pos", *[c[f].alias(n) for n, f in names.items()])


@query(
    "inventory_counts",
    f"SELECT l_orderkey, count(*) AS n FROM ({BASE}) GROUP BY l_orderkey",
)
def _(spark, sf_dir):
    pages = _inventory_pages(spark, sf_dir).withColumn(
        "o", J.objects_with(F.col("payloads"), ["numResultsTotal"], members=["numResultsTotal"])
    )
    return pages.select("l_orderkey", payloads.inventory_count(F.col("html"), F.col("o")).alias("n"))


@query(
    "inventory_count_texts",
    f"""
SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN page_id WHEN 1 THEN page_id + 5 WHEN 2 THEN page_id WHEN 3 THEN NULL END AS n
FROM pages
""",
)
def _(spark, sf_dir):
    rows = run(
        spark, sf_dir,
        f"""SELECT page_id, CASE CAST(page_id % 4 AS INT)
          WHEN 0 THEN concat('<h1 data-testid="srp-header-title"> ', {s('page_id')}, ' Treffer</h1><p>9 Fahrzeuge</p>')
          WHEN 1 THEN concat('<p>', {s('page_id + 5')}, ' FAHRZEUGE (3)</p>')
          WHEN 2 THEN concat('<b>', {s('page_id')}, '</b> <i>Anhänger</i>') ELSE 'nichts' END AS html FROM pages""",
    )
    none = F.array().cast("array<string>")
    return rows.select("page_id", payloads.inventory_count(F.col("html"), none).alias("n"))


_LOOSE = f"""
SELECT l_orderkey, l_linenumber, lkey, listing, brand, model, price, kw, ps, km, yr, mon, v,
  concat('{{"x":{{"listingId":', {s('listing')}, ',"id":"listing-', {s('l_linenumber')}, '","__t":"ab__c","t":"', CASE WHEN brand = '' THEN 'Marke' ELSE brand END, ' ', model,
    '","p":["', {s('price')}, ' € (Brutto)","', {s('price')}, ' € netto"],"a":"', CASE WHEN v < 3 THEN 'Unfallfrei • ' ELSE '' END, 'EZ ', lpad({s('mon')}, 2, '0'), '/', {s('yr')},
    ' • ', {s('km')}, ' km • ', {s('kw')}, ' kW • Diesel","u":"$undefined"}}}}') AS doc
FROM ({BASE})
"""


@query(
    "loose_listings",
    f"""
SELECT lkey, {_URL} AS url, CASE WHEN brand = '' THEN 'Marke' WHEN brand = 'VW Nutzfahrzeuge' THEN 'VW' ELSE brand END AS markes,
  CASE WHEN brand = 'VW Nutzfahrzeuge' THEN concat('Nutzfahrzeuge ', model) ELSE model END AS models,
  concat(price, ' € (Brutto)') AS preis, concat(km, ' km') AS km, concat(lpad(CAST(mon AS VARCHAR), 2, '0'), '/', yr) AS ez,
  concat(kw, ' kW') AS power, 'Diesel' AS fuel, CASE WHEN v < 3 THEN 'Unfallfrei' ELSE '' END AS zustand
FROM ({BASE})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _LOOSE, spread=True)
    rows = rows.withColumn("o", F.explode_outer(J.objects_with(F.array("doc"), ["listingId"])))
    rows = rows.withColumn("strings", payloads.meaningful_strings(F.col("o")))
    c = payloads.loose_columns(F.col("o"), F.col("strings"))
    names = {
        "url": "Vehicle_URL", "markes": "Markes", "models": "Models", "preis": "Preis", "km": "Kilometerstand",
        "ez": "Erstzulassung", "power": "Leistung", "fuel": "Kraftstoffart", "zustand": "Fahrzeugzustand",
    }
    return rows.select("lkey", *[c[f].alias(n) for n, f in names.items()])


@query("listing_records")
def _(spark, sf_dir):
    return payloads.listing_records(_inventory_pages(spark, sf_dir), "l_orderkey")


@query(
    "payload_key_hits",
    f"""
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, field, path, value_excerpt FROM (
  SELECT l_orderkey, pos, unnest([{{'field': 'CO₂-Emissionen', 'path': 'attr.co2', 'value_excerpt': CASE WHEN v = 4 THEN concat(co2, ' g/km') END}},
    {{'field': 'Anzahl der Fahrzeughalter', 'path': 'attr.pvo', 'value_excerpt': CAST(l_linenumber AS VARCHAR)}}], recursive := true) FROM ({_SEARCH}))
WHERE value_excerpt IS NOT NULL
""",
)
def _(spark, sf_dir):
    raw = payloads.search_listings(_inventory_pages(spark, sf_dir), "l_orderkey")
    return payloads.payload_key_hits(raw, ["l_orderkey", "pos"]).drop("n")


# -- cards -------------------------------------------------------------------------------

def _card_pages(spark, sf_dir):
    rows = run(spark, sf_dir, _SEARCH)
    t = lambda c: F.col(c).cast("string")
    card = F.concat(
        F.lit('<article class="listingCard"><a href="/fahrzeuge/details.html?id='), t("listing"),
        F.lit('&amp;a=1"><h2 data-testid="listing-'), t("pos"), F.lit('-title">'), F.col("brand"), F.lit(" "), F.col("model"),
        F.lit('</h2></a><span data-testid="price-label">'), t("price"), F.lit(' €</span><div data-testid="listing-details-attributes">Unfallfrei • EZ '),
        F.lpad(t("mon"), 2, "0"), F.lit("/"), t("yr"), F.lit(" • "), t("km"), F.lit(" km • "), t("kw"), F.lit(" kW ("), t("ps"),
        F.lit(" PS) • Benzin</div></article>"),
    )
    return rows.groupBy("l_orderkey").agg(
        F.concat(
            F.lit("<html><article>Werbung</article>"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", card.alias("c")))), lambda x: x["c"]), "\n"),
        ).alias("html")
    )


@query(
    "listing_cards",
    f"""
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, concat({_URL}, '&a=1') AS url,
  CASE WHEN brand = '' THEN {_FIRST_WORD} WHEN brand = 'VW Nutzfahrzeuge' THEN 'VW' ELSE brand END AS markes,
  CASE WHEN brand = '' THEN CASE WHEN strpos(model, ' ') > 0 THEN substr(model, strpos(model, ' ') + 1) ELSE '' END
       WHEN brand = 'VW Nutzfahrzeuge' THEN concat('Nutzfahrzeuge ', model) ELSE model END AS models,
  concat(price, ' €') AS preis, concat(km, ' km') AS km, concat(lpad(CAST(mon AS VARCHAR), 2, '0'), '/', yr) AS ez,
  concat(kw, ' kW (', ps, ' PS)') AS power, 'Benzin' AS fuel, 'Unfallfrei' AS zustand
FROM ({_SEARCH})
""",
)
def _(spark, sf_dir):
    found = cards.listing_cards(_card_pages(spark, sf_dir), "l_orderkey")
    return found.select(
        "l_orderkey", "pos", F.col("Vehicle_URL").alias("url"), F.col("Markes").alias("markes"),
        F.col("Models").alias("models"), F.col("Preis").alias("preis"), F.col("Kilometerstand").alias("km"),
        F.col("Erstzulassung").alias("ez"), F.col("Leistung").alias("power"), F.col("Kraftstoffart").alias("fuel"),
        F.col("Fahrzeugzustand").alias("zustand"),
    )


@query(
    "vendor_audit",
    f"""
WITH h AS (SELECT l_orderkey, pos, unnest([{{'n': 0, 'hit': CASE WHEN v = 4 THEN concat('CO₂-Emissionen|[', pos, '].attr.co2|', co2, ' g/km') END}},
    {{'n': 1, 'hit': concat('Anzahl der Fahrzeughalter|[', pos, '].attr.pvo|', l_linenumber)}}], recursive := true) FROM ({_SEARCH})),
t AS (SELECT l_orderkey, string_agg(hit, ';' ORDER BY pos, n) AS hits FROM h WHERE hit IS NOT NULL GROUP BY 1)
SELECT b.l_orderkey, count(DISTINCT listing) AS real_detail_url_count, count(*) AS listing_count, any_value(hits) AS hits FROM ({BASE}) b JOIN t USING (l_orderkey) GROUP BY 1
""",
)
def _(spark, sf_dir):
    found = payloads.vendor_audit(_inventory_pages(spark, sf_dir), "l_orderkey")
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws("|", h["field"], h["path"], h["value_excerpt"])), ";")
    return found.withColumn("hits", hits)


# -- categories ----------------------------------------------------------------------------

_CATEGORY_PAGES = f"""
SELECT page_id, concat(
  CASE WHEN page_id % 3 = 0 THEN concat('<label><input type="checkbox" value="Car"><span class="vehicleCategoryChipLabel_x">Autos</span> (', {s('page_id + 1')}, ')</label>',
     '<label><input value="Bus">Busse (0)</label><label><input value="Trailer">Anhänger ', {s('page_id + 2')}, '</label>')
  ELSE concat('<a href="/x?vc=Motorbike&amp;p=1">Motorräder (', {s('page_id + 3')}, ')</a><a data-href="/y?vehicleCategory=Bus">Alle</a><a href="/z?vc=Foo">Foo 7</a>',
     '<script>self.__next_f.push([1,"3:{{\\\\"f\\\\":{{\\\\"vc\\\\":\\\\"Car\\\\",\\\\"label\\\\":\\\\"Pkw\\\\",\\\\"count\\\\":', {s('page_id + 4')}, '}},\\\\"o\\\\":{{\\\\"options\\\\":[{{\\\\"value\\\\":\\\\"Trailer\\\\",\\\\"cnt\\\\":\\\\"1.200\\\\"}},{{\\\\"value\\\\":\\\\"Bus\\\\",\\\\"count\\\\":0}}]}}}}"])</script>') END, html) AS html
FROM pages
"""


@query(
    "category_options",
    """
SELECT page_id, CAST(place AS INTEGER) AS place, value, label, count, url FROM (
  SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN [
      {'place': 0, 'value': 'Car', 'label': 'Autos', 'count': page_id + 1, 'url': ''},
      {'place': 1, 'value': 'Trailer', 'label': 'Anhänger', 'count': page_id + 2, 'url': ''}]
    ELSE [
      {'place': 0, 'value': 'Car', 'label': 'Pkw', 'count': page_id + 4, 'url': ''},
      {'place': 1, 'value': 'Trailer', 'label': 'Anhänger', 'count': 1200, 'url': ''},
      {'place': 2, 'value': 'Motorbike', 'label': 'Motorräder', 'count': page_id + 3, 'url': '/x?vc=Motorbike&p=1'},
      {'place': 3, 'value': 'Bus', 'label': 'Busse', 'count': NULL, 'url': '/y?vehicleCategory=Bus'}] END, recursive := true) FROM pages)
""",
)
def _(spark, sf_dir):
    pages = payloads.with_payloads(run(spark, sf_dir, _CATEGORY_PAGES))
    return payloads.category_options(pages, "page_id")


@query(
    "category_values",
    """
SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN ['Car', 'Trailer'] ELSE ['Car', 'Trailer', 'Motorbike', 'Bus'] END) AS value FROM pages
""",
)
def _(spark, sf_dir):
    pages = payloads.with_payloads(run(spark, sf_dir, _CATEGORY_PAGES))
    return payloads.category_values(pages, "page_id").select("page_id", "value")


# -- vendors ---------------------------------------------------------------------------------

_VENDOR_PAGES = f"""
SELECT c_custkey, c_name, c_custkey % 4 AS k, lpad({s('c_custkey * 37 % 100000')}, 5, '0') AS plz, {pick('c_custkey', ['DE', 'IT'])} AS cc,
  concat('<script>self.__next_f.push([1,"4:{{\\\\"d\\\\":{{\\\\"dealerData\\\\":{{\\\\"customerId\\\\":', {s('c_custkey')}, ',\\\\"name\\\\":\\\\"', c_name,
    '\\\\",\\\\"homepageUrl\\\\":\\\\"/v', {s('c_custkey')}, '\\\\",\\\\"location\\\\":{{\\\\"street\\\\":\\\\"Weg 1\\\\",\\\\"zipcode\\\\":\\\\"', lpad({s('c_custkey * 37 % 100000')}, 5, '0'),
    '\\\\",\\\\"city\\\\":\\\\"Ort\\\\",\\\\"country\\\\":\\\\"', {pick('c_custkey', ['DE', 'IT'])}, '\\\\",\\\\"state\\\\":\\\\"Bayern\\\\"}},\\\\"legalData\\\\":{{\\\\"imprint\\\\":\\\\"Fax: 0221 ', {s('c_custkey + 100000')},
    ' Mail: a', {s('c_custkey')}, '@b.example\\\\"}},\\\\"phoneNumbers\\\\":{{\\\\"phone\\\\":{{\\\\"internationalPrefix\\\\":\\\\"49\\\\",\\\\"prefix\\\\":\\\\"0221\\\\",\\\\"number\\\\":\\\\"',
    {s('c_custkey')}, '\\\\"}},\\\\"cellPhone\\\\":\\\\"0170\\\\"}}}},\\\\"dealerHomepageData\\\\":{{\\\\"userDefinedLink\\\\":\\\\"www.x.example\\\\"}}}},\\\\"numResultsTotal\\\\":', {s('c_custkey % 50')}, '}}"])</script>') AS pushed,
  concat('<script type="application/ld+json">{{"@type":"AutoDealer","name":"LD ', {s('c_custkey')}, '","telephone":"0221  55","address":{{"streetAddress":"LD 2","postalCode":"50667","addressLocality":"Köln","addressCountry":"DE"}}}}</script>') AS ld
FROM customer
"""


def _state_case(plz: str) -> str:
    return (
        "CASE "
        + " ".join(
            f"WHEN CAST({plz} AS INT) BETWEEN {a} AND {b} THEN '{st}'"
            for a, b, st in fixed.POSTCODE_RANGES
        )
        + " ELSE 'Bayern' END"
    )


@query(
    "vendor_records",
    f"""
WITH v AS (SELECT c_custkey, c_name, c_custkey % 4 AS k, lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS plz,
  c_custkey % 2 = 0 AS german FROM customer)
SELECT c_custkey, CASE WHEN k < 2 THEN c_name ELSE concat('LD ', c_custkey) END AS name,
  CASE WHEN k < 2 THEN 'Weg 1' ELSE 'LD 2' END AS street, CASE WHEN k < 2 THEN plz ELSE '50667' END AS plz,
  CASE WHEN k < 2 THEN 'Ort' ELSE 'Köln' END AS city,
  CASE WHEN k >= 2 THEN 'Nordrhein-Westfalen' WHEN NOT german THEN '' ELSE {_state_case('plz')} END AS state,
  CASE WHEN k >= 2 OR german THEN 'Deutschland' ELSE 'Italien' END AS land,
  CASE WHEN k < 2 THEN concat('+49 0221 ', c_custkey) ELSE '0221 55' END AS phone,
  CASE WHEN k = 3 THEN '' ELSE '0170' END AS mobile, CASE WHEN k = 3 THEN '' ELSE concat('0221 ', c_custkey + 100000) END AS fax,
  CASE WHEN k = 3 THEN '' ELSE concat('a', c_custkey, '@b.example') END AS email,
  CASE WHEN k = 3 THEN '' ELSE 'www.x.example' END AS homepage,
  CASE WHEN k = 3 THEN 'given' ELSE concat('https://home.marktplatz.example/V', c_custkey) END AS link,
  CASE WHEN k = 3 THEN 7 ELSE c_custkey % 50 END AS n
FROM v
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _VENDOR_PAGES)
    k = F.col("k")
    html = F.when(k < 2, F.col("pushed")).when(k == 2, F.concat("pushed", "ld")).otherwise(
        F.concat(F.lit("<p>7 Fahrzeuge</p>"), "ld")
    )
    pages = rows.select("c_custkey", html.alias("html"), F.lit("given").alias("Marktplatz.example_Links"))
    done = payloads.vendor_records(pages, "c_custkey")
    names = {
        "Händlername": "name", "Standort": "street", "PLZ": "plz", "Städte": "city", "Bundesland": "state", "Land": "land",
        "Telephone Number": "phone", "MobilTelefon": "mobile", "Fax Number": "fax", "Email ID": "email",
        "Hauptseite": "homepage", "Marktplatz.example_Links": "link", "Anzahl der Fahrzeuge": "n",
    }
    return done.select("c_custkey", *[T.field(a).alias(b) for a, b in names.items()])


@query(
    "vendor_ld",
    """
SELECT c_custkey, concat('LD ', c_custkey) AS name, '0221 55' AS telephone, 'LD 2' AS street, '50667' AS plz, 'Köln' AS city, '' AS region, 'Deutschland' AS country
FROM customer
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _VENDOR_PAGES).select("c_custkey", payloads.ld_vendor(F.col("ld")).alias("v"))
    return rows.select("c_custkey", "v.name", "v.telephone", "v.street", "v.plz", "v.city", "v.region", "v.country")


_CONTACT = f"""
SELECT c_custkey, concat('<div>Adresse Lange Str. ', {s('c_custkey')}, ' DE-50667 Köln Kontakt Tel.: +49 221 ', {s('c_custkey + 10000')}, ' Tel. 2: 0221-', {s('c_custkey + 20000')},
  ' Mobil: 0170 ', {s('c_custkey + 30000')}, ' Fax: 0221/', {s('c_custkey + 40000')}, ' Internet</div><a href="https://home.marktplatz.example/x">M</a><a href="https://www.auto', {s('c_custkey')},
  '.example/">Web</a><a href="mailto: info', {s('c_custkey')}, '@auto.example">Mail</a>') AS html
FROM customer
"""


@query(
    "contact_blocks",
    """
SELECT c_custkey, concat('+49 221 ', c_custkey + 10000) AS phone, concat('0221-', c_custkey + 20000) AS phone2, concat('0170 ', c_custkey + 30000) AS mobile,
  concat('0221/', c_custkey + 40000) AS fax, concat('https://www.auto', c_custkey, '.example/') AS homepage, concat('Lange Str. ', c_custkey) AS street,
  '50667' AS plz, 'Köln' AS city, concat('info', c_custkey, '@auto.example') AS email
FROM customer
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _CONTACT)
    c = payloads.contact_fields(F.col("html"))
    names = {
        "phone": "Telephone Number", "phone2": "2. Telephone Number", "mobile": "MobilTelefon", "fax": "Fax Number",
        "homepage": "Hauptseite", "street": "Standort", "plz": "PLZ", "city": "Städte", "email": "Email ID",
    }
    return rows.select("c_custkey", *[c[f].alias(n) for n, f in names.items()])


# -- keyword evidence ---------------------------------------------------------------------------


_WORDS = [("en", "that "), ("en", "with"), ("fr", "pour"), ("de", "nicht"), ("es", "que"), ("any", "copyright")]


@query(
    "keyword_excerpts",
    f"""
WITH k(field, keyword) AS (VALUES {", ".join(f"('{f}', '{w}')" for f, w in _WORDS)}),
hits AS (SELECT doc_id, field, keyword, text, strpos(lower(text), keyword) AS hit FROM documents JOIN k ON strpos(lower(text), keyword) > 0)
SELECT doc_id, field, keyword, {clean_sql('substr(text, greatest(1, hit - 160), hit + 300 - greatest(1, hit - 160))')} AS excerpt
FROM hits
""",
)
def _(spark, sf_dir):
    words = T.literal_pairs(("field", "keyword"), _WORDS)
    return audit.keyword_excerpts(table(spark, sf_dir, "documents"), "text", ["doc_id"], words)


@query(
    "payload_walk",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '$.k' AS path FROM events",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.explode_outer(J.keyed_values(F.array("props"), ["k"])))
    rows = rows.filter(F.col("v").isNotNull())
    return rows.select(
        "event_id", F.col("v.value").cast("bigint").alias("k"), F.concat(F.lit("$."), F.col("v.path")).alias("path")
    )
