"""What large tables must not pay for: one page read once for each field, members nobody reads, a call for each group."""

import json
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import html as H
from lotwise.functions import payload as J
from lotwise.functions import text as T
from lotwise.operators import payloads
from lotwise.streaming import keyed


def plan(df):
    outputs = df._jdf.queryExecution().analyzed().expressions()
    return " ".join(outputs.apply(i).sql() for i in range(len(df.columns)))


def test_a_vendor_page_is_searched_once(spark):
    ld = '<script type="application/ld+json">{"@type":"Store","name":"N","address":{"postalCode":"50667","addressCountry":"DE"}}</script>'
    rows = spark.createDataFrame([(ld,), ("<p>x</p>",)], "html string").select(payloads.ld_vendor(F.col("html")).alias("v"))
    assert plan(rows).count("regexp_extract_all") == 1
    assert [r["v"] and (r["v"]["name"], r["v"]["plz"], r["v"]["country"]) for r in rows.collect()] == [("N", "50667", "Deutschland"), None]


def test_a_dealer_object_is_read_once(spark):
    objects = ['{"dealerData":"{x"}', '{"dealerData":{}}', '{"dealerData":{"name":"N","legalData":{"imprint":"Fax: 0221 123456"}}}', '{"dealerData":{"name":"M"}}']
    rows = spark.createDataFrame([(objects,), ([],), (None,)], "o array<string>").select(payloads.payload_vendor(F.col("o")).alias("v"))
    assert plan(rows).count("from_json") == 1 + len(payloads.PHONE_KEYS)
    assert [r["v"] and r["v"]["fax"] for r in rows.collect()][1:] == [None, None]
    rest = spark.createDataFrame([(objects[1:],)], "o array<string>").select(payloads.payload_vendor(F.col("o")).alias("v")).first()["v"]
    assert (rest["name"], rest["fax"]) == ("N", "0221 123456")


def test_objects_can_be_cut_to_the_members_that_are_read(spark):
    rows = spark.createDataFrame([(['{"n":3,"big":[{"n":{"x":"ä"},"y":1}]}'],)], "t array<string>")
    found = rows.select(J.objects_with(F.col("t"), ["n"], members=["n"]).alias("o")).first()["o"]
    assert [json.loads(o) for o in found] == [{"n": 3}, {"n": {"x": "ä"}}]


def test_strings_that_hold_a_text_are_enough_for_it(spark):
    raw = json.dumps({"note": "Verbrauch 99 g/km", "a": "x", "b": "7 G\\/KM", "c": "12 g/Km"})
    rows = spark.createDataFrame([(raw,)], "r string")
    got = rows.select(payloads.meaningful_strings(F.col("r"), "g/km").alias("s")).first()["s"]
    assert "Verbrauch 99 g/km" in got and "12 g/Km" in got and "x" not in got


def test_edges_and_presence_by_any_blank(spark):
    words = ["", *fixed.NULL_WORDS, "nan x", "x", "Nan", "a b"]
    blanks = [chr(i) for i in range(0x3001) if re.match(f"[ {T._ODD}]", chr(i))]
    texts = [a + w + b for w in words for a, b in [("", ""), *zip(blanks, reversed(blanks)), ("  ", "\n\n")]]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    edges = f"(?=[^!-~])(?:^[ {T._ODD}]+|[ {T._ODD}]+$)"
    was = F.regexp_replace(F.coalesce("t", F.lit("")), edges, "")
    found = rows.select(
        T.strip("t").alias("strip"), T.has_value("t").alias("has"), T.scores_as_value("t").alias("scores"),
        was.alias("old"), (F.col("t").isNotNull() & ~was.isin("", *fixed.NULL_WORDS)).alias("old_has"), (~was.isin("", *fixed.SCORE_NULL_WORDS)).alias("old_scores"),
    )
    assert all((r["strip"], r["has"], r["scores"]) == (r["old"], r["old_has"], r["old_scores"]) for r in found.collect())
    assert "regexp_replace" not in plan(rows.select(T.strip("t"), T.has_value("t")))


def test_scripts_end_at_their_first_end_tag(one):
    html = "<SCRIPT a>x<y</b></script> <script>1 < 2</SCRIPT><script></script><script>open</script >"
    assert one(H.scripts, html) == ["x<y</b>", "1 < 2", ""]


def test_events_are_folded_without_a_call_for_each_group(monkeypatch):
    rng = random.Random(5)
    rows = pd.DataFrame(
        [("vehicle", f"u{rng.randint(0, 9)}", rng.choice(["", "r1", None]), s, rng.choice(["processing", "done", "failed"]), f"p{s}", "H", f"e{s}", str(s)) for s in rng.sample(range(200), 200)],
        columns=["entity", "url", "run_id", "seq", "kind", "payload", "haendler_id", "error", "ts"],
    )

    def refuse(*_, **__):
        raise AssertionError("a call for each group")

    monkeypatch.setattr(pd.core.groupby.DataFrameGroupBy, "agg", refuse)
    (got,) = keyed._fold(iter([rows]))
    assert list(got.columns) == [c.split()[0] for c in keyed.FOLDED.split(", ")]
    for r in got.to_dict("records"):
        mine = rows[(rows["url"] == r["url"]) & (rows["run_id"].fillna("") == r["run_id"])].sort_values("seq")
        assert (r["starts"], r["seq"]) == ((mine["kind"] == "processing").sum(), mine["seq"].max())
        done = mine[mine["kind"] == "done"]
        assert pd.isna(r["done_seq"]) if done.empty else (r["done_seq"], r["payload"]) == (done["seq"].max(), done["payload"].iloc[-1])
