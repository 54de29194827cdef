"""License scans by diagonal voting.

All rolling word k-grams of a text that some template holds are joined with their places
in the templates.  Matches of one template that lie on one diagonal (place in the text
minus place in the template) belong together; so do those on neighbouring diagonals,
where words were put in or left out.  A run of diagonals is a candidate; it is verified
by the share of the template's words that its matches cover.  A run that is too long for
one copy is cut into the copies in it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.columns import ALNUM, grams, runs, utf8, word_hashes, word_spans
from lotwise.llm.license_texts import LICENSES
from lotwise.operators.durable import store

GRAM = 3
#: Diagonals this near to one another are one run.
NEAR = 4
#: Share of a template's words that a span must hold; and at most so many times its length.
SHARE, STRETCH = 0.8, 1.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # only as it stands, word after word


# Phrases that name a license, and openings of well-known license texts.
PHRASES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]
# Openings are looked for beside the whole texts, as files often hold no more.
TEXTS = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("all-rights-reserved", "all rights reserved"),
    *[Template(label, text) for label, text in LICENSES.items()],
]


def _words(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    starts, ends, _ = word_spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends, ALNUM)


def _rolled(docs: DataFrame, known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row its id, a name of its text, its words and those of its k-grams that are known."""

    def work(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in runs(offsets):
                chunk, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = word_spans(chunk, at, ALNUM)
                names = grams(word_hashes(chunk, starts, ends, ALNUM), GRAM)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names) if len(known) else np.zeros(0, np.int64)
                text = np.searchsorted(first, hit, "right") - 1
                inside = hit + GRAM <= first[text + 1]
                hit, text = hit[inside], text[inside]
                pairs = pa.StructArray.from_arrays([pa.array(names[hit].astype(np.int64)), pa.array(hit - first[text])], ["gram", "spot"])
                edges = pa.array(np.searchsorted(text, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first)), pa.ListArray.from_arrays(edges, pairs)],
                    ["doc_id", "text_key", "n_words", "grams"],
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id long, text_key long, n_words long, grams array<struct<gram: long, spot: long>>")


def copies(diagonals: Sequence[int], held: Sequence[Sequence[int]], size: int) -> list[tuple[int, int, float]]:
    """First word, last word and share of every copy in a run of diagonals, the fullest and then the shortest first.

    A copy is neighbouring diagonals of the run that hold enough of the template and aren't too
    long; copies share no word.  As a copy's length is bounded, so are the diagonals tried for each.
    """
    found = []
    for i in range(len(diagonals)):
        covered: set[int] = set()
        first, last = diagonals[i] + min(held[i]), 0
        for j in range(i, len(diagonals)):
            first, last = min(first, diagonals[j] + min(held[j])), max(last, diagonals[j] + max(held[j]) + GRAM - 1)
            if last - first + 1 > STRETCH * size:
                break
            before = len(covered)
            covered.update(p + k for p in held[j] for k in range(GRAM))
            if len(covered) > before and len(covered) / size >= SHARE:
                found.append((-len(covered), last - first, first, last))
    firsts: list[int] = []
    lasts: list[int] = []
    out = []
    for n, _, first, last in sorted(found):
        at = bisect_left(firsts, first)
        if (at == 0 or lasts[at - 1] < first) and (at == len(firsts) or last < firsts[at]):
            firsts.insert(at, first)
            lasts.insert(at, last)
            out.append((first, last, -n / size))
    return out


def _cut(batches):
    """Of every run that is too long for one copy the copies."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts = sorted((p["diagonal"], p["held"]) for p in row["parts"])
            for first, last, share in copies([d for d, _ in parts], [h for _, h in parts], row["size"]):
                rows.append((row["doc_id"], row["text_key"], row["template"], first, last, share))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_key", "template", "first", "last", "share"])


def standing(spans: Sequence[tuple[int, int, int, float]], sizes: Sequence[int], exact: Sequence[bool]) -> list[tuple[int, int, int, float]]:
    """Spans (first, last, template, share) without those that lie by half in one of another template with more words found.

    Texts that differ in a few words hold most of one another.  Exact phrases always stand.  A span
    is at most ``STRETCH`` times its template long, so only near ones are looked at.
    """
    spans = sorted(spans)
    firsts, reach = [s[0] for s in spans], int(STRETCH * max(sizes)) + 1
    found = [share * sizes[t] for _, _, t, share in spans]
    out = []
    for i, (first, last, t, share) in enumerate(spans):
        near = range(bisect_left(firsts, first - reach), bisect_left(firsts, last + 1)) if not exact[t] else ()
        if not any(
            found[j] > found[i] and spans[j][2] != t and not exact[spans[j][2]] and 2 * (min(last, spans[j][1]) - max(first, spans[j][0]) + 1) >= last - first + 1 for j in near
        ):
            out.append((first, last, t, share))
    return out


def scan(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``n_words`` and its verified ``spans`` in the order of their first word.

    A span has the ``template``'s number, the ``first`` word it covers and the ``last``, and the
    ``share`` of the template's words that it holds; each copy of a template is a span, but see :func:`standing`.  A null text has no words and no spans, nor
    has one of fewer than three words.  Rows that repeat an id are scanned each by itself.
    Templates are part of the program: their k-grams are a table of fixed size.
    """
    spark = docs.sparkSession
    words = [_words(t.text) for t in templates]
    table = [(int(n), k, p, len(w), t.exact) for k, (t, w) in enumerate(zip(templates, words)) for p, n in enumerate(grams(w, GRAM).astype(np.int64).tolist())]
    places = spark.createDataFrame(table, "gram long, template int, place int, size int, exact boolean")
    known = np.unique(np.array([t[0] for t in table], np.int64).view(np.uint64))
    rows = store(_rolled(docs, known, id_col, text_col))

    key = ["doc_id", "text_key"]
    matched = rows.filter(F.size("grams") > 0).dropDuplicates(key).select(*key, F.explode("grams").alias("g")).select(*key, "g.gram", "g.spot")
    votes = (
        matched.join(places, "gram")
        .groupBy(*key, "template", "size", "exact", (F.col("spot") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("held"))  # at most the template's places
    )
    of = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("exact") | F.col("diagonal").isNull() | (F.col("diagonal") - F.lag("diagonal").over(of) > NEAR)
    merged = (
        votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(of))
        .groupBy(*key, "template", "size", "exact", "span")
        .agg(
            F.collect_list(F.struct("diagonal", "held")).alias("parts"),
            F.min(F.col("diagonal") + F.array_min("held")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("held") + GRAM - 1).alias("last"),
        )
    )
    covered = F.array_distinct(F.flatten(F.transform(F.flatten("parts.held"), lambda p: F.sequence(p, p + GRAM - 1))))
    enough = F.when(F.col("exact"), F.col("share") == 1).otherwise(F.col("share") >= SHARE)
    long = ~F.col("exact") & (F.col("last") - F.col("first") + 1 > STRETCH * F.col("size"))
    checked = store(merged.withColumn("share", F.size(covered) / F.col("size")).filter(enough).withColumn("long", long))
    whole = checked.filter("not long").select(*key, "template", "first", "last", "share")
    cut = checked.filter("long").select(*key, "template", "size", "parts").mapInArrow(_cut, "doc_id long, text_key long, template int, first long, last long, share double")
    sizes, exact = [len(w) for w in words], [t.exact for t in templates]

    def stand(batches):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("template", pa.int32()), ("share", pa.float64())]))
        for batch in batches:
            out = []
            for row in batch.column("spans").to_pylist():
                left = standing([(s["first"], s["last"], s["template"], s["share"]) for s in row], sizes, exact)
                out.append([dict(zip(("first", "last", "template", "share"), s)) for s in left])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, kind)], [*key, "spans"])

    together = whole.unionByName(cut).groupBy(*key).agg(F.collect_list(F.struct("first", "last", "template", "share")).alias("spans"))
    spans = together.mapInArrow(stand, "doc_id long, text_key long, spans array<struct<first: long, last: long, template: int, share: double>>")
    joined = rows.join(spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")), "left")
    empty = F.array().cast("array<struct<first: bigint, last: bigint, template: int, share: double>>")
    return joined.select("doc_id", "n_words", F.coalesce("spans", empty).alias("spans"))


def licensed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``n_words``, places of license phrases, and labels.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest
    and the largest of them (else null); ``base_labels`` are their licenses, ``labels`` also those
    of the license texts found; ``score`` is the largest share of a template found, 0 for none.
    """
    templates = [*PHRASES, *TEXTS]
    names = F.array(*[F.lit(t.label) for t in templates])
    label = lambda s: names[s["template"]]
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, label))), ",")
    found = scan(docs, templates, id_col, text_col).withColumn("base", base)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["first"])).alias("first_word"), F.array_max(F.transform("base", lambda s: s["first"])).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans",
    )
