"""Scalar functions on the reference's published example values."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import numbers as N
from lotwise.functions import text as T
from lotwise.functions import titles
from lotwise.functions import urls as U
from lotwise.operators import classify, location
from lotwise.site import Marketplace


def column(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["v"] for r in rows.select("i", function(F.col("x")).alias("v")).orderBy("i").collect()]


def test_money(spark):
    cases = {
        "48.450 €": 48450.0, "2.618 € (Brutto)": 2618.0, "1.413,72 €": 1413.72, "€8,900 (Net)": 8900.0,
        "": None, "nan": None, None: None, "3.5": 3.0, "124,5": 124.0, "12,50": 12.5, "1.234.567 €": 1234567.0,
    }
    assert column(spark, N.money, list(cases)) == list(cases.values())


def test_power_percent_date_duration(spark):
    assert column(spark, N.kilowatts, ["150 kW (204 PS)", "75 kW", "102 PS"]) == [150.0, 75.0, None]
    assert column(spark, N.horsepower, ["150 kW (204 PS)", "75 kW", "102 PS"]) == [204.0, None, 102.0]
    assert column(spark, N.percent, ["5,83%", "1.005,5 %", "x"]) == [5.83, 1005.5, None]
    assert column(spark, N.year, ["03/2024"]) == [2024]
    assert column(spark, N.month, ["03/2024", "13/2024", "3.2024"]) == [3, None, 3]
    assert column(spark, N.months, ["60 Months", "48 Monate"]) == [60, 48]
    assert column(spark, N.leading_whole, ["4/5", "x4"]) == [4, None]
    assert column(spark, N.count_value, ["1.234 Treffer", "x"]) == [1234, None]
    assert column(spark, N.count_in_brackets, ["Pkw [3] (1.200)", "Pkw"]) == [1200, None]


def test_clean_text_handles_every_blank(spark):
    texts = ["a b", " a \t\n b ", "a 　b", "a\x1cb", "a b", "", None]
    assert column(spark, T.clean_text, texts) == ["a b", "a b", "a b", "a b", "a b", "", ""]


def test_compose_unicode_only_touches_marked_rows(spark):
    rows = spark.createDataFrame([(1, "Café", "x"), (2, "plain", None), (3, "Å", "ü")], "i int, a string, b string")
    done = {r["i"]: (r["a"], r["b"]) for r in T.compose_unicode(rows, ["a", "b"]).collect()}
    assert done == {1: ("Café", "x"), 2: ("plain", None), 3: ("Å", "ü")}


def test_presence_variants_differ(spark):
    texts = ["x", "", " nan ", "<NA>", "NaN", None]
    assert column(spark, T.has_value, texts) == [True, False, False, False, False, False]
    assert column(spark, T.scores_as_value, texts) == [True, False, False, True, True, False]
    assert column(spark, T.is_filled, texts) == [True, False, True, True, True, False]
    assert column(spark, T.without_placeholder, ["$undefined", "null", " a ", "None"]) == ["", "", "a", ""]


def test_title_split(spark):
    got = column(spark, titles.split_title, ["NEUNissan Micra VISA", "NEU Volkswagen Golf", "Neuer Wagen", "bmw 320", ""])
    assert [tuple(x) for x in got] == [
        ("Nissan", "Micra VISA"), ("Volkswagen", "Golf"), ("Neuer", "Wagen"), ("BMW", "320"), ("", ""),
    ]


def test_card_attributes(spark):
    got = column(
        spark, titles.attribute_fields,
        ["Unfallfrei • EZ 05/2020", "EZ 02/2010 • 271.607 km", "Refrigerator Box • EZ 03/2014"],
    )
    assert [tuple(x) for x in got] == [("Unfallfrei", ""), ("", ""), ("", "Refrigerator Box")]


@pytest.mark.parametrize(
    "href,url",
    [
        ("/autohaus", "https://home.cars.example/AUTOHAUS"),
        ("//home.cars.example/a/b/", "https://home.cars.example/a/b"),
        ("http://else.example/x", "http://else.example/x"),
        ('"https://home.cars.example/x?y=1"', "https://home.cars.example/X"),
        ("", ""),
    ],
)
def test_dealer_url(one, href, url):
    site = Marketplace("cars.example")
    assert one(lambda c: U.dealer_url(c, site), href) == url


def test_site_parameter_names_the_link_field():
    site = Marketplace("cars.example")
    assert site.link_field == "Cars.example_Links"
    assert len(site.vendor_fields) == 15


def test_vehicle_ids(spark):
    urls = [
        "https://x.example/fahrzeuge/details.html?id=12345678", "/auto-inserat/golf/87654321/", "x?id=abc", "/1234567/",
    ]
    assert column(spark, U.listing_id, urls) == ["12345678", "87654321", "", ""]


def test_category_url_keeps_place_and_last_value(one):
    url = one(lambda c: U.category_url(c, F.lit("Car")), "https://h.example/d/?page=2&vc=Bus&a=1&a=2")
    assert url == "https://h.example/d?vc=Car&a=2"


def test_types(spark):
    def kind(t, source):
        return spark.range(1).select(classify.vehicle_type(F.lit(t), F.lit(source)).alias("v")).first()["v"]

    assert tuple(kind("Kastenwagen", "VanUpTo7500")) == ("LKW", "Kastenwagen", 0.95, "source_category_override")
    assert kind("", "ForkliftTruck")["category"] == "LKW"
    assert tuple(kind("Kleinwagen", ""))[2:] == (1.0, "exact_task_match")
    assert kind("SomethingUnknown", None)["category"] == "Andere"


def test_origins(spark):
    assert column(spark, classify.origin, ["KGM", "Ford", "Lexus", "Tesla", None]) == [
        "Korea", "Deutschland", "Japan", "Andere", "Andere",
    ]


def test_places(spark):
    assert column(spark, location.state_of_postcode, ["50667", "D-01067 Dresden", "05000", "x"]) == [
        "Nordrhein-Westfalen", "Sachsen", "", "",
    ]
    assert column(spark, location.country_name, ["IT", "Deutschland", "Polen"]) == ["Italien", "Deutschland", "Polen"]


def test_sql_functions_agree_with_the_columns(spark):
    from lotwise.functions import sql

    sql.register(spark)
    texts = [
        "48.450 €", "1.413,72 €", "3.5", "150 kW (204 PS)", "5,83%", "03/2024", "D-50667 Köln", "IT", " a\u00a0 b ", "nan", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    pairs = {
        "clean_text": T.clean_text, "normalize_text": T.normalize_text, "parse_money_de": N.money,
        "parse_number_de": N.number, "parse_percent_de": N.percent, "parse_kw": N.kilowatts, "parse_ps": N.horsepower,
        "registration_year": N.year, "registration_month": N.month, "state_of_postcode": location.state_of_postcode,
        "country_name_de": location.country_name,
    }
    for name, function in pairs.items():
        got = rows.select(F.expr(f"{name}(x)").alias("a"), function(F.col("x")).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], name
