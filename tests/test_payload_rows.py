"""Odd payloads must not fail a task."""

from pyspark.sql import functions as F

from lotwise.functions import payload as P


def test_surrogates_and_deep_nesting(spark):
    texts = ['{"listingId": "\\ud83d x", "\\ud83dlisting": 1}', "[" * 200_000, '{"a": {"listingId": "7"}}']
    rows = spark.createDataFrame([(texts,)], "texts array<string>")
    row = rows.select(P.objects_with(F.col("texts"), ["listingId"]).alias("o"), P.keyed_values(F.col("texts"), ["listing"]).alias("k")).first()
    assert [o for o in row.o if '"7"' in o] == ['{"listingId": "7"}']
    assert any("? x" in o for o in row.o)
    assert {k.value for k in row.k} == {"? x", "1", "7"}
