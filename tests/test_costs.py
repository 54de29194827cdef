"""What large tables must not pay for: patterns that cannot match, a second parse, a group held whole."""

import json

from pyspark.sql import functions as F

from lotwise.functions import html as H
from lotwise.functions import payload as J
from lotwise.functions import text as T
from lotwise.operators import payloads, specs
from lotwise.queries import base, q_files


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]


def test_sightings_are_filtered_without_a_second_parse(spark):
    pages = spark.createDataFrame([(1, ['{"searchResults":{"listings":[{"id":"12345678","title":"BMW X1"}]}}'])], "k int, payloads array<string>")
    found = payloads.listing_sightings(pages, "k")
    assert not [f for f in filters(found) if "from_json" in f or "regexp" in f]
    assert [(r["Markes"], r["Models"]) for r in found.collect()] == [("BMW", "X1")]
    assert [r["Models"] for r in payloads.listing_records(pages, "k").collect()] == ["X1"]


def test_financing_patterns_wait_for_their_label(spark):
    rows = spark.createDataFrame([("Laufzeit : 60 Monate | Rate ab 149 € mtl. Sollzins 1%",)], "html string").withColumn("page_text", F.col("html"))
    found = specs.with_financing(rows)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("laufzeit :") == 1 and plan.count("monatsrate :") == 1
    assert found.first()["financing"] == {"Laufzeit": "60 Monate", "Financing": "149 € mtl."}


def test_dotted_capital_i_is_an_i(one):
    assert one(lambda c: specs.first_values(specs.quick_stats(c)), "Dİesel, 5 km") == {"Kilometerstand": "5", "Kraftstoffart": "Dİesel"}


def test_pairs_without_value_are_dropped_before_their_label(spark):
    rows = spark.sql("SELECT array(named_struct('label', 'Farbe', 'value', ''), named_struct('label', 'Farbe:', 'value', ' rot ')) AS p")
    found = rows.select(specs.first_values(F.col("p")).alias("m"))
    assert found.first()["m"] == {"Farbe": "rot"}
    assert "transform(filter(" in found._jdf.queryExecution().analyzed().toString()


def test_only_entities_that_stand_there_are_replaced(one):
    assert one(H.unescape, "a &amp;lt; &lt;b&gt; &sup2;&#38;amp; &unknown; &AMP;") == "a &lt; <b> ²& &unknown; &AMP;"


def test_attribute_values_in_all_quotes(one):
    for tag in ("<a href = \"x'y\">", "<a HREF='x\"y'>", "<a href=xy>"):
        assert one(lambda c: H.attribute(c, "href"), tag).replace("'", "").replace('"', "") == "xy"
    assert one(lambda c: H.attribute(c, "href"), "<a href=''>") == "" and one(lambda c: H.attribute(c, "href"), "<a>") == ""


def test_keyed_values_keep_paths_and_order(spark):
    doc = json.dumps({"a": [{"co2": {"CO2x": 1}}, 5, [{"b": "x", "co2": None}]], "co2": [2]})
    rows = spark.createDataFrame([([doc, '{"co2":1}', "no"],)], "t array<string>")
    found = rows.select(J.keyed_values(F.col("t"), ["co2"]).alias("v")).first()["v"]
    assert [(v["path"], v["value"]) for v in found] == [
        ("a[0].co2", "{'CO2x': 1}"), ("a[0].co2.CO2x", "1"), ("a[2][0].co2", "None"), ("co2", "[2]"), ("co2", "1"),
    ]
    assert not hasattr(J, "_walk")  # which wrote out the path of every value


def test_rendered_lists_hold_no_group_as_one_value(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("a group as one value")

    monkeypatch.setattr(q_files.F, "collect_list", refuse)
    rows = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (0, 2, "b"), (1, 5, "c")], "g int, ord int, x string")
    q_files._render_lists(rows, "g", F.to_json(F.struct("x")), str(tmp_path / "out"))
    files = spark.read.option("wholetext", True).text(str(tmp_path / "out"))
    got = {r["g"]: [x["x"] for x in json.loads(r["value"])] for r in files.collect()}
    assert got == {0: ["a", "b", "b"], 1: ["c"]} and files.count() == 2


def test_line_items_are_dealt_out_before_they_become_pages(spark, tmp_path):
    spark.sql("SELECT 1L AS l_orderkey, 1 AS l_linenumber, 7L AS l_partkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = base.run(spark, str(tmp_path), "SELECT l_partkey FROM lineitem", spread=True)
    assert "hashpartitioning(l_orderkey" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["l_partkey"] for r in rows.collect()] == [7]


def test_patterns_look_at_a_character_before_a_word_edge():
    assert T.led(r"\b\d+\s*km\b").startswith(r"(?=\d)") and T.led(r"\b(Ab|Cd)\b").startswith("(?=[AC])")
    for other in (r"\b\d*x", r"\b\d+|foo", r"\b(?:EZ\s*)?\d", r"\bA?\d", r"x|\b\d", r"(Ab|Cd)?e", r"[(|]\b\d"):
        assert T.led(other) == other


def test_runs_of_blanks_are_found_from_run_to_run(one):
    assert T._BLANKS.startswith(r"\G")
    for text, clean in {"a  b": "a b", " a\tb ": "a b", "é  é\u00a0": "é é", "a b": "a b", "a é \x85": "a é", "€ ": "€", "\n": "", "": ""}.items():
        assert one(T.clean_text, text) == clean


def test_markup_goes_in_one_pass(one):
    for page, text in {
        "a <b x='<!-- > -->'>c": "a c", "a<script>x</p>": "a x", "<!-- a <b>c": "c", "<p><i>a</i> &lt;b&gt;</p>": "a <b>", "a <x <script>y</script> z>b": "a b", "1 < 2": "1 < 2",
    }.items():
        assert one(H.markup_text, page) == text
    assert "_TAG" not in vars(H)


def test_terms_share_the_definition_behind_them_in_their_list(one):
    page = "<dl><dt>a<b>1</b>:</dt><dt>c</dt><dd>x</dd><dt>e</dt></dl><dd>y</dd>"
    assert [(p["label"], p["value"]) for p in one(H.definition_pairs, page)] == [("a 1 ", "x"), ("c", "x"), ("e", "")]


def test_first_pairs_are_kept_without_a_growing_array(spark):
    rows = spark.sql("SELECT array(named_struct('label', 'b', 'value', '1'), named_struct('label', 'a', 'value', '2'), named_struct('label', 'b', 'value', '3')) AS p")
    found = rows.select(specs.keep_first_pairs(F.col("p")).alias("m"), specs.keep_last_pairs(F.col("p")).alias("n"))
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()
    assert found.first()["m"] == {"b": "1", "a": "2"} and found.first()["n"] == {"b": "3", "a": "2"}
