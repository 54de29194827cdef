"""Extraction on small hand-written pages."""

from pyspark.sql import functions as F

from lotwise.functions import html as H
from lotwise.functions import payload as J
from lotwise.operators import payloads, specs
from lotwise.site import Marketplace

SITE = Marketplace("cars.example")


def pages(spark, *htmls, url=""):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def detail(spark, html):
    return specs.detail_records(pages(spark, html), "page_id").first().asDict()


def test_complete_detail_page(spark):
    html = (
        "<html><body><h1>BMW 320 Touring</h1><span data-testid='price-label'>12.345 €¹</span><dl>"
        "<dt>CO₂-Emissionen</dt><dd>110 g/km</dd><dt>Baureihe</dt><dd>F30</dd><dt>Ausstattungslinie</dt><dd>Sport Line</dd>"
        "<dt>Anzahl der Fahrzeughalter</dt><dd>1</dd><dt>Hubraum</dt><dd>1.995 cm³</dd><dt>Anzahl der Türen</dt><dd>4/5</dd>"
        "<dt>Schadstoffklasse</dt><dd>Euro 6</dd><dt>Farbe</dt><dd>Schwarz</dd><dt>Anzahl Sitzplätze</dt><dd>5</dd></dl>"
        "<div>Baureihe</div><div>andere</div></body></html>"
    )
    got = detail(spark, html)
    assert (got["Markes"], got["Models"], got["Preis"]) == ("BMW", "320 Touring", "12.345 €")
    assert got["CO₂-Emissionen"] == "110 g/km" and got["Baureihe"] == "F30" and got["Hubraum"] == "1.995 cm³"
    assert got["Anzahl der Türen"] == "4/5" and got["Ausstattungslinie"] == "Sport Line"


def test_label_variants(spark):
    got = detail(spark, "<dl><dt>CO2-Emissionen</dt><dd>99 g/km</dd><dt>Vorbesitzer</dt><dd>2</dd><dt>Türen</dt><dd>5</dd><dt>Farbe</dt><dd>-</dd></dl>")
    assert got["CO₂-Emissionen"] == "99 g/km" and got["Anzahl der Fahrzeughalter"] == "2"
    assert got["Anzahl der Türen"] == "" and got["Farbe"] == ""


def test_financing_page(spark):
    got = detail(
        spark,
        "<dl><dt>Monatsrate</dt><dd>149 € mtl.</dd><dt>Bank</dt><dd>Santander</dd><dt>Gesamtbetrag</dt><dd>4.146,66 €</dd>"
        "<dt>Laufzeit</dt><dd>60 Monate</dd></dl><p>Sollzins: 5,83%</p>",
    )
    assert got["Financing"] == got["Finanzierung"] == "149 € mtl."
    assert (got["Bank"], got["Gesamtbetrag"], got["Laufzeit"]) == ("Santander", "4.146,66 €", "60 Monate")
    assert got["Fester Sollzins p.a."] == "5,83%"


def test_empty_container_states_nothing(spark):
    got = detail(spark, "<div id='technical-details'></div>")
    assert all(v == "" for k, v in got.items() if k != "page_id")


def test_entities_and_hidden_text(spark):
    html = "<p>A&amp;B &#8364; &#x20AC;&nbsp;&uuml;</p><script>x</script><!-- y --><style>z</style>"
    row = pages(spark, html).select(H.markup_text(F.col("html")).alias("t")).first()
    assert row["t"] == "A&B € € ü"


def test_terms_share_the_next_definition(spark):
    row = pages(spark, "<dl><dt>A</dt><dt>B:</dt><dd>v</dd><dt>C</dt></dl><dd>w</dd>").select(
        H.definition_pairs(F.col("html")).alias("p")
    ).first()
    assert [tuple(x) for x in row["p"]] == [("A", "v"), ("B", "v"), ("C", "")]


def test_payload_objects_parents_first(spark):
    html = (
        '<script>self.__next_f.push([1,"2:{\\"a\\":{\\"id\\":1,\\"b\\":[{\\"id\\":2}]},\\"c\\":{\\"id\\":3}}"])</script>'
        "<script>self.__next_f.push([broken</script>"
    )
    row = pages(spark, html).select(J.objects_with(J.payload_texts(F.col("html")), ["id"]).alias("o")).first()
    assert [o[:8] for o in row["o"]] == ['{"id": 1', '{"id": 2', '{"id": 3']


def test_string_leaves_skip_keys_and_unescape(spark):
    row = spark.createDataFrame([('{"k":"a\\"b","l":["c",{"m":"d"}],"n":1}',)], "j string").select(
        J.string_leaves(F.col("j")).alias("s")
    ).first()
    assert row["s"] == ['a"b', "c", "d"]


def test_long_strings_do_not_overflow_the_regex_stack(spark):
    text = '{"k":"' + 'x\\"' * 50_000 + '"}'
    row = spark.createDataFrame([(text,)], "j string").select(F.length(J.string_leaves(F.col("j"))[0]).alias("n")).first()
    assert row["n"] == 100_000


def test_listing_payload(spark):
    listing = (
        '{"searchResults":{"listings":[{"id":12345678,"vc":"Car","category":"SmallCar","make":{"localized":"Volkswagen"},'
        '"title":"Volkswagen Polo UNITED","attr":{"pvo":"2","co2":"$undefined"},"hasDamage":false,"p":"9.000 €",'
        '"note":"CO2 105 g/km","financePlans":[{"offer":{"localized":{"creditTerm":"60","monthlyInstallment":"99 €"}}}]},'
        '{"id":"123","title":"zu kurz"}]}}'
    )
    import json

    html = f"<script>self.__next_f.push([1,{json.dumps('9:' + listing)}])</script>"
    done = payloads.listing_records(payloads.with_payloads(pages(spark, html)), "page_id", SITE).collect()
    assert len(done) == 1
    got = done[0].asDict()
    assert got["Vehicle_URL"] == "https://suchen.cars.example/fahrzeuge/details.html?id=12345678"
    assert (got["Markes"], got["Models"], got["Fahrzeugtyp"]) == ("Volkswagen", "Polo UNITED", "Kleinwagen")
    assert (got["Fahrzeugzustand"], got["Anzahl der Fahrzeughalter"], got["Laufzeit"]) == ("Unfallfrei", "2", "60 Monate")
    assert got["CO₂-Emissionen"] == "105 g/km" and got["Financing"] == "99 € mtl."


def test_vendor_payload(spark):
    import json

    doc = (
        '{"dealerData":{"name":"Auto","location":{"zipcode":"50667","country":"DE"},'
        '"phoneNumbers":{"phone":{"internationalPrefix":"49","prefix":"0221","number":"123456"}}}}'
    )
    html = f"<script>self.__next_f.push([1,{json.dumps('9:' + doc)}])</script>"
    got = payloads.vendor_records(pages(spark, html), "page_id", site=SITE).first().asDict()
    assert got["Telephone Number"] == "+49 0221 123456" and got["Bundesland"] == "Nordrhein-Westfalen"


def test_foreign_vendor_has_no_german_state(spark):
    html = '<script type="application/ld+json">{"@type":"Store","name":"X","address":{"addressCountry":"IT","postalCode":"39100","addressRegion":"Bayern"}}</script>'
    got = payloads.vendor_records(pages(spark, html), "page_id", site=SITE).first().asDict()
    assert got["Land"] == "Italien" and got["Bundesland"] == ""


def test_page_classes(spark):
    rows = spark.createDataFrame(
        [
            (0, "", "", ""),
            (1, "https://suchen.cars.example/fahrzeuge/details.html?id=1", "", "<h1>BMW 1er</h1><p>Technische Daten</p>" + "x" * 80),
            (2, "https://x.example", "", "<h1>Access denied</h1>" + "x" * 80),
            (3, "https://home.cars.example/", "cars.example Gebrauchtwagen Neuwagen", "<p>" + "x" * 90 + "</p>"),
            (4, "https://suchen.cars.example/fahrzeuge/search.html", "", "<h1>Liste</h1>" + "x" * 90),
        ],
        "page_id int, url string, title string, html string",
    )
    done = specs.classify_pages(rows, title="title", site=SITE)
    got = {r["page_id"]: r["classification"] for r in done.collect()}
    assert got == {0: "blank_page", 1: "real_detail_page", 2: "error_page", 3: "home_redirect", 4: "listing_page"}
