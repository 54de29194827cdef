"""Queries over number parsing and the cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import numbers as N
from lotwise.functions import predicates as P
from lotwise.operators import clean
from lotwise.queries.base import (
    BASE, EXPECTED, LISTINGS, clean_sql, grouped, listings, query, run, s, two,
)


@query(
    "money_parse",
    f"""
SELECT lkey, {EXPECTED['price_eur']} AS amount,
       CAST(cents AS DOUBLE) AS one_decimal,
       CAST(concat(CAST(price AS VARCHAR), '.', lpad(CAST(cents AS VARCHAR), 2, '0')) AS DOUBLE) AS english,
       CAST(price * 1000 + 7 AS DOUBLE) AS thousands
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    price, cents = F.col("price").cast("string"), F.col("cents").cast("string")
    return rows.select(
        "lkey",
        N.money("preis").alias("amount"),
        N.money(F.concat(cents, F.lit(",5 €"))).alias("one_decimal"),
        N.money(F.concat(F.lit("$ "), price, F.lit("."), F.lpad(cents, 2, "0"))).alias("english"),
        N.money(F.concat(price, F.lit(",007"))).alias("thousands"),
    )


_NUMBER_TEXTS = f"""
SELECT lkey, price, km, months, l_linenumber, v,
       concat('ca. ', {grouped('km')}, ' km gelaufen') AS km_text,
       concat({s('l_linenumber')}, '/', {s('l_linenumber + 1')}) AS doors,
       concat('Laufzeit ', {s('months')}, ' Monate') AS term,
       CASE WHEN v = 5 THEN '... 12' ELSE concat('x', {s('price')}) END AS odd
FROM ({BASE})
"""


@query(
    "number_parse",
    f"""
SELECT lkey, CASE WHEN km IS NULL THEN NULL ELSE NULL END AS dotted, CAST(km AS DOUBLE) AS km,
       CAST(l_linenumber AS BIGINT) AS doors, CAST(months AS BIGINT) AS months,
       CAST(NULL AS BIGINT) AS no_leading, CASE WHEN v = 5 THEN 12 ELSE price END AS first_whole
FROM ({_NUMBER_TEXTS})
""".replace("CASE WHEN km IS NULL THEN NULL ELSE NULL END AS dotted", "CAST(NULL AS DOUBLE) AS dotted"),
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _NUMBER_TEXTS)
    # The first run of "ca. 1.234 km" is the lone dot, which holds no number.
    return rows.select(
        "lkey",
        N.number("km_text").alias("dotted"),
        N.number(F.replace("km_text", F.lit("ca. "), F.lit("ca "))).alias("km"),
        N.leading_whole("doors").alias("doors"),
        N.months("term").alias("months"),
        N.leading_whole("term").alias("no_leading"),
        N.whole("odd").alias("first_whole"),
    )


@query(
    "power_parse",
    f"SELECT lkey, {EXPECTED['power_kw']} AS kw, {EXPECTED['power_ps']} AS ps, "
    f"CAST(concat(CAST(kw AS VARCHAR), '.5') AS DOUBLE) AS half FROM ({LISTINGS})",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    half = F.concat(F.col("kw").cast("string"), F.lit(",5kW"))
    return rows.select(
        "lkey",
        N.kilowatts("leistung").alias("kw"),
        N.horsepower("leistung").alias("ps"),
        N.kilowatts(half).alias("half"),
    )


@query(
    "pct_parse",
    f"SELECT lkey, {EXPECTED['borrowing_rate_pct']} AS german, {EXPECTED['borrowing_rate_pct']} AS english, "
    f"CAST(price AS DOUBLE) + 0.5 AS grouped FROM ({LISTINGS})",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, LISTINGS)
    big = F.concat(F.expr(grouped("price")), F.lit(",5 %"))
    return rows.select(
        "lkey",
        N.percent("zins").alias("german"),
        N.percent(F.replace("zins", F.lit(","), F.lit("."))).alias("english"),
        N.percent(big).alias("grouped"),
    )


@query(
    "date_parts",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(l_shipdate) AS BIGINT) AS mon, "
    "CAST(year(l_shipdate) AS BIGINT) AS yr, CAST(month(l_shipdate) AS BIGINT) AS mon_short, "
    "CAST(NULL AS BIGINT) AS no_month FROM lineitem",
)
def _(spark, sf_dir):
    rows = run(
        spark, sf_dir,
        f"SELECT l_orderkey, l_linenumber, l_partkey, concat('EZ ', {two('month(l_shipdate)')}, '/', "
        f"{s('year(l_shipdate)')}) AS ez, concat({s('month(l_shipdate)')}, '.', {s('year(l_shipdate)')}) "
        f"AS short, concat('13/', {s('year(l_shipdate)')}) AS bad FROM lineitem",
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.month("ez").alias("mon"),
        N.year("ez").alias("yr"),
        N.month("short").alias("mon_short"),
        N.month("bad").alias("no_month"),
    )


_COUNTS = f"""
SELECT lkey, price, km, months, l_linenumber, v, {grouped('price')} AS g
FROM ({BASE})
"""


@query(
    "count_parse",
    f"""
SELECT lkey, CASE WHEN v = 0 THEN NULL ELSE price END AS plain,
       CASE WHEN v = 1 THEN NULL ELSE price END AS bracket,
       CASE v WHEN 0 THEN price WHEN 1 THEN price WHEN 2 THEN CAST(l_linenumber AS BIGINT) WHEN 3 THEN price END AS by_category
FROM ({_COUNTS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _COUNTS)
    v, g = F.col("v"), F.col("g")
    plain = F.when(v == 0, F.lit("true")).otherwise(F.concat(F.lit("("), g, F.lit(" Treffer)")))
    bracket = F.when(v == 1, F.lit("Pkw")).otherwise(F.concat(F.lit("Pkw [3] ("), g, F.lit(")")))
    near = (
        F.when(v == 0, F.concat(F.lit("Gebrauchte PKW ("), g, F.lit(")")))
        .when(v == 1, F.concat(g, F.lit(" Anhänger")))
        .when(v == 2, F.concat(F.lit("Busse "), F.col("l_linenumber").cast("string"), F.lit(", Stapler 9")))
        .when(v == 3, F.concat(F.lit("Lkw bis 7,5 t: "), g, F.lit(" / Transporter und Lkw bis 7,5 t ("), g, F.lit(")")))
        .otherwise(F.concat(F.lit("Motorräder "), g))
    )
    code = (
        F.when(v == 0, F.lit("Car")).when(v == 1, F.lit("Trailer")).when(v == 2, F.lit("Bus"))
        .when(v == 3, F.lit("VanUpTo7500")).otherwise(F.lit("Car"))
    )
    return rows.select(
        "lkey",
        N.count_value(plain).alias("plain"),
        N.count_in_brackets(bracket).alias("bracket"),
        N.category_count(near, code).alias("by_category"),
    )


# -- cleaning jobs ------------------------------------------------------------------

_DERIVED = ", ".join(f"{sql} AS {name}" for name, sql in EXPECTED.items())


@query(
    "clean_listings",
    f"""
SELECT lkey, {_DERIVED}, CASE WHEN v = 3 THEN concat(months, ' € mtl.') ELSE '' END AS finanzierung,
       CASE WHEN v = 3 THEN concat(months, ' € mtl.') ELSE '' END AS financing,
       'Yes' AS financing_available,
       {EXPECTED['price_eur']} / CASE WHEN v <> 4 THEN CAST(kw AS DOUBLE) END AS preis_pro_kw,
       {EXPECTED['price_eur']} / (CASE WHEN v <> 2 THEN CAST(km AS DOUBLE) END + 1) AS preis_pro_km
FROM ({LISTINGS})
""",
)
def _(spark, sf_dir):
    rows = listings(spark, sf_dir, "v", "months")
    rate = F.concat(F.col("months").cast("string"), F.lit(" € mtl."))
    raw = rows.withColumn("Financing", F.when(F.col("v") == 3, rate))
    cleaned = clean.clean_vehicles(raw.drop("v", "months"))
    return cleaned.select(
        "lkey",
        *EXPECTED,
        F.col("Finanzierung").alias("finanzierung"),
        F.col("Financing").alias("financing"),
        F.col("Financing_Available").alias("financing_available"),
        F.col("Preis_pro_kW").alias("preis_pro_kw"),
        F.col("Preis_pro_km").alias("preis_pro_km"),
    )


_VENDORS = """
SELECT s_suppkey, concat('  ', s_name, '\t Auto ') AS name,
       CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'None' WHEN 1 THEN '' WHEN 2 THEN CAST(s_suppkey AS STRING)
            ELSE 'viele' END AS n
FROM supplier
"""


@query(
    "clean_vendors",
    f"""
SELECT s_suppkey, {clean_sql('name')} AS name, '' AS plz,
       CASE WHEN s_suppkey % 4 = 2 THEN CAST(s_suppkey AS DOUBLE) END AS declared
FROM ({_VENDORS})
""",
)
def _(spark, sf_dir):
    raw = run(spark, sf_dir, _VENDORS).select(
        "s_suppkey", F.col("name").alias("Händlername"), F.col("n").alias(fixed.VENDOR_COUNT_FIELD)
    )
    cleaned = clean.clean_vendors(raw)
    return cleaned.select(
        "s_suppkey",
        F.col("Händlername").alias("name"),
        F.col("PLZ").alias("plz"),
        F.col(f"`{fixed.VENDOR_COUNT_FIELD}`").alias("declared"),
    )


_TARGETS = f"""
SELECT lkey, co2, l_linenumber, v,
       CASE v WHEN 0 THEN 'CO₂-Emissionen' WHEN 1 THEN 'Anzahl der Fahrzeughalter' ELSE 'Baureihe' END AS field,
       CASE v WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN concat({s('co2')}, ' G/KM') ELSE {s('co2')} END
              WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN {s('l_linenumber')} ELSE 'bis zu 3' END
              WHEN 2 THEN concat('Filter ', model) WHEN 3 THEN repeat('x', 100 + l_linenumber * 5)
              WHEN 4 THEN '' ELSE model END AS value
FROM ({BASE})
"""


@query(
    "target_values",
    f"""
SELECT lkey, CASE v WHEN 0 THEN l_linenumber % 2 = 0 WHEN 1 THEN l_linenumber % 2 = 0 WHEN 2 THEN false
             WHEN 3 THEN 100 + l_linenumber * 5 <= 120 WHEN 4 THEN false ELSE true END AS valid
FROM ({_TARGETS})
""",
)
def _(spark, sf_dir):
    rows = run(spark, sf_dir, _TARGETS)
    return rows.select("lkey", P.valid_target_value(F.col("field"), F.col("value")).alias("valid"))


