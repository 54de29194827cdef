"""Inputs on which an operator once did less than the whole job."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")

from lotwise.llm import ann, license_scan, near_dedup, packing, suffix_dedup, token_store, tokens  # noqa: E402

SPECIAL = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>x"), (3, "中 <|endoftext|> é"), (4, "<|endoftext> |endoftext|>"), (5, None), (6, "a b")]


def defaults(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_special_tokens_in_texts_have_their_ids(spark, tmp_path):
    docs = spark.createDataFrame(SPECIAL, "doc_id long, text string").repartition(2)
    encoder = tokens.Encoder(tokens.public(), special=True)
    for _, text in SPECIAL:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == defaults(text), text
    assert 50256 in defaults(SPECIAL[0][1])
    packed = packing.pack(docs, tokens.public(), 64).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packed) == [(i, len(defaults(t)) + 1, crc([*defaults(t), 0])) for i, t in SPECIAL]
    stored, at, expected = token_store.tokenized(docs, str(tmp_path / "t"), tokens.public(), 2).collect(), 0, []
    for i, t in SPECIAL:
        ids = [*defaults(t), 2]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stored) == expected


def test_repeated_license_texts_are_spans_of_their_own(spark):
    mit, phrase = license_scan.TEXTS[0].text, "All rights reserved."
    texts = [phrase, f"{phrase} {phrase}", f"{phrase} Yes {phrase}", f"{phrase} " * 50, f"{mit} {mit} {mit}", "rights reserved all", None]
    texts.append(f"{mit} granted free of charge x free of charge to any a of charge to any person b free of charge to")
    texts.append("of charge to any person x " * 6 + mit.replace("obtaining a copy", "that obtains a copy"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = [t.label for t in [*license_scan.PHRASES, *license_scan.TEXTS]]
    got = {r.doc_id: r for r in license_scan.licensed(rows).collect()}
    spans = {i: [(names[s.template], s.first, s.last) for s in r.spans] for i, r in got.items()}
    label, n = "all-rights-reserved", len(license_scan._words(mit))
    assert spans[0] == [(label, 0, 2)] and spans[1] == [(label, 0, 2), (label, 3, 5)] and spans[2] == [(label, 0, 2), (label, 4, 6)]
    assert spans[3] == [(label, 3 * k, 3 * k + 2) for k in range(50)]
    assert spans[4] == [("mit", n * k, n * k + n - 1) for k in range(3)]
    assert [(got[i].labels, got[i].score) for i in range(7)] == [(label, 1.0)] * 4 + [("mit", 1.0)] + [("", 0.0)] * 2
    assert (got[7].labels, got[7].score, len(spans[7])) == ("mit", 1.0, 1)
    assert got[8].labels == "mit" and got[8].score >= 0.8 and len(spans[8]) == 1


def test_whole_license_texts_are_told_apart(spark):
    from lotwise.llm.license_texts import LICENSES, AGPL_HEADER, BSD_2, BSD_3_CLAUSE, GPL_HEADER, ISC, LGPL_HEADER, MIT

    rng = random.Random(9)

    def worn(text, every):  # a word of so many is another one
        return " ".join(w if rng.random() > 1 / every else "word" for w in text.split())

    mit, gpl = MIT.split(), GPL_HEADER.split()
    woven = " ".join(" ".join(mit[k : k + 40]) + " " + " ".join(gpl[k // 2 : k // 2 + 20]) for k in range(0, len(mit), 40))
    half = " ".join(BSD_2.split()[: len(BSD_2.split()) // 2])
    texts = [*LICENSES.values(), worn(MIT, 40), f"{ISC} some words {MIT}", BSD_2 + BSD_3_CLAUSE, woven, half]
    got = [r for r in sorted(license_scan.licensed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    labels = [set(r.labels.split(",")) for r in got]
    for k, label in enumerate(LICENSES):
        assert label in labels[k] and got[k].score == 1.0, label
    for k, label in enumerate(LICENSES):  # texts that differ in a few words are told apart too
        assert labels[k] == {label}, (label, labels[k])
    n = len(LICENSES)
    assert "mit" in labels[n] and got[n].score < 1.0
    assert labels[n + 1] == {"isc", "mit"} and labels[n + 2] == {"bsd-2", "bsd-3"}
    assert "mit" in labels[n + 3]
    assert labels[n + 4] == {"bsd"}  # half a text is its opening, and no more


def test_copies_are_the_best_of_all_neighbouring_diagonals():
    rng = random.Random(6)
    for _ in range(300):
        size, diagonals = 12, sorted(rng.sample(range(40), rng.randint(1, 9)))
        held = [sorted(rng.sample(range(10), rng.randint(1, 10))) for _ in diagonals]
        best = 0.0
        for i in range(len(diagonals)):
            for j in range(i, len(diagonals)):
                spots = [diagonals[k] + p for k in range(i, j + 1) for p in held[k]]
                share = len({p + g for k in range(i, j + 1) for p in held[k] for g in range(3)}) / size
                if max(spots) + 2 - min(spots) + 1 <= 1.5 * size and share >= 0.8:
                    best = max(best, share)
        found = license_scan.copies(diagonals, held, size)
        assert max((s for _, _, s in found), default=0.0) == best
        assert all(a[1] < b[0] for a, b in combinations(sorted(found), 2))


def test_a_groups_key_is_its_first_variant(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype("<u2")
    rows = np.repeat(base[None], 6, 0)
    for k in range(6):  # all share chunks 4 to 15, each is alone in the symbols before
        rows[k, :16] = rng.integers(0, 1 << 16, 16)
    classes = spark.createDataFrame([(k + 1, bytearray(r.tobytes())) for k, r in enumerate(rows)], "node long, signature binary")
    least = min(v for v in range(len(near_dedup.VARIANTS)) if len(set(near_dedup.keys(rows, v).tolist())) == 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        found = near_dedup.groups(classes).collect()
        assert sorted((r.key, r.size, r.node) for r in found) == [(least, 6, k + 1) for k in range(6)]
        members = spark.createDataFrame([tuple(r) for r in found], "gid long, key int, size long, node long").join(classes, "node")
        placed = members.withColumn("label", F.col("node")).withColumn("vblock", F.col("node"))
        pairs = {frozenset((r.x, int(y))) for r in near_dedup._across(placed).collect() for y in np.frombuffer(r.ys, "<i8")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # All lie in components of their own, and the first is the group's largest: every pair is asked.
    assert pairs == {frozenset(p) for p in combinations(range(1, 7), 2)}


def test_rows_of_one_id_are_not_one_bucket(spark, monkeypatch):
    from lotwise.llm import packed

    held, real = [], packed.dealt

    def dealt(df, n, by="bucket"):
        if "text" in df.columns:
            held.append({r[by]: r["count"] for r in df.groupBy(by).count().collect()})
        return real(df, n, by)

    monkeypatch.setattr(packed, "dealt", dealt)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(80))
    some = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(100)]
    rows = [(None, t) for t in some] + [(5, f"{k} {passage}") for k in range(100)] + [(7, passage)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = suffix_dedup.repeats(docs)
    got = found.collect()
    assert max(held[0].values()) < 200 and len(held[0]) == packed.buckets(docs)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted((i or 0, len(t), 80 if i == 7 else 0) for i, t in rows)
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()  # buckets are dealt once


def test_queries_of_a_hot_leaf_are_cut_into_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(0, 1, (400, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SLICE", 50)
    sizes, real = [], ann._meeting

    def meeting(*given):
        both = real(*given)
        sizes.extend([r["count"] for r in df.groupBy("leaf", "slice", "block").count().collect()] for df in both)
        return both

    monkeypatch.setattr(ann, "_meeting", meeting)
    got = ann.neighbours(rows, F.col("vec_id") >= 0, 5, leaves=1).collect()
    assert all(len(s) == 64 and max(s) <= 100 for s in sizes)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(away, np.inf)
    expected = {(q, n + 1, int(v)) for q in range(400) for n, v in enumerate(np.argsort(away[q], kind="stable")[:5])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == expected
