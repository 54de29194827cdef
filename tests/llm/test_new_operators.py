"""Quality rules, importance resampling and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import merkle, quality, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, id string, stratum string, `__c0` string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeéAB1") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n\t", "a b c a b c\na b c", "x" * 70 + " y " + "z" * 65, "#$% & | <b>!\n\nA\nA\n A\n", say(20), say(19), say(3000), "é中 ß", "\x1c a\x85b", say(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, say(30)), (None, None)]
    rows += [(i, say(rng.randint(0, 90))) for i in range(20, 70)]
    langs = ["en", "en", "en", "de", None, "é", "Z"]
    return [(i, t, rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([None, 5, 0, -3]), 1, "x", "y", "z") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Quality rules


def brute_measures(text):
    t = text or ""
    words = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", t)), "n_letters": len(re.findall("[A-Za-z]", t)), "n_bangs": t.count("!"),
    }


def failed(m):
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def rule_values(m):
    div = lambda a, b: math.trunc(a / b)
    n = m["n_words"]
    return {
        "symbols": div(1000 * m["n_symbols"], n), "dup_lines": div(1000 * m["n_dup_lines"], max(m["n_lines"], 1)), "repeats": div(1000 * m["n_repeat_words"], n), "long_words": div(100 * m["word_chars"], n),
        "short_words": -div(100 * m["word_chars"], n), "capitals": div(1000 * m["n_upper"], max(m["n_letters"], 1)), "bangs": div(1000 * m["n_bangs"], n),
    }


def test_measures_are_those_of_the_text(docs):
    got = sorted(tuple(r[m] for m in quality.MEASURES) for r in quality.measured(docs).collect())
    assert got == sorted(tuple(brute_measures(r[1])[m] for m in quality.MEASURES) for r in awkward())


def test_exact_binomial_tail():
    for n, k, p in [(10, 0, 0.05), (100, 2, 0.05), (500, 24, 0.05), (37, 1, 0.2), (900, 30, 0.05)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality.tail(k, n, p), exact, rel_tol=1e-9)
    assert quality.tail(5, 100, 0.05) == 1.0 and quality.tail(0, 0, 0.05) == 1.0


def labelled(spark):
    """Two strata with much junk, one whose good documents are junk too, one with few labels, and one null."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(3200):
        lang = rng.choice(["en", "en", "de", "xx", None]) if i > 4 else "few"
        good = int(rng.random() > 0.3)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 80))]
        if not good or (lang == "xx" and rng.random() < 0.25):
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang))
        if i % 7:
            labels.append((i, good))
    labels += [(1, 0), (None, 1), (5, None), (99999, 0)]
    return rows, labels


def brute_verdicts(rows, labels):
    worst = {}
    for i, q in labels:
        if i is not None and q is not None:
            worst[i] = min(worst.get(i, 9), q)
    measured = [(i, lang, brute_measures(t)) for i, t, lang in rows]
    known = [(i, lang, rule_values(m), worst[i]) for i, lang, m in measured if i in worst and not failed(m)]
    strata, cutoffs = {lang for _, lang, _, _ in known}, {}
    for s in strata:
        fit = [(v, g) for i, lang, v, g in known if lang == s and zlib.crc32(str(i).encode()) % quality.FOLDS == 0]
        test = [v for i, lang, v, g in known if lang == s and zlib.crc32(str(i).encode()) % quality.FOLDS and g == 1]
        goods, bads = [v for v, g in fit if g], [v for v, g in fit if not g]
        for step in quality.STEPS:
            rules = {}
            for r in quality.RULES:
                for cut in sorted({v[r] for v, _ in fit}) if goods and bads else []:
                    hit = sum(v[r] > cut for v in goods)
                    if 1000 * hit <= step * len(goods):
                        caught = sum(v[r] > cut for v in bads)
                        if 100 * caught >= quality.CATCH * len(bads) and caught * len(goods) >= quality.LIFT * hit * len(bads):
                            rules[r] = cut
                        break
            lost = sum(any(v[r] > c for r, c in rules.items()) for v in test)
            if not rules or not test or quality.tail(lost, len(test), quality.ALPHA) > quality.DELTA / len(strata):
                break
            cutoffs[s] = rules
    return sorted((i, not failed(m) and not any(rule_values(m)[r] > c for r, c in cutoffs.get(lang, {}).items())) for i, lang, m in measured), cutoffs


def test_cutoffs_are_certified_by_stratum(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = quality.ruled(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    expected, cutoffs = brute_verdicts(rows, labels)
    assert sorted((r.doc_id, r.kept) for r in found.collect()) == expected
    assert "en" in cutoffs and "few" not in cutoffs and "symbols" not in cutoffs.get("xx", {})  # few labels, and good documents like the bad
    assert cutoffs["en"]["symbols"] == 0 and any(not k for _, k in expected)


def test_rules_without_labels_or_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.ruled(docs, empty).collect()
    assert len(got) == len(awkward()) and all(r.kept == (not r.base_failed) for r in got)
    assert quality.ruled(none, empty).collect() == []


# Importance resampling


def brute_sample(rows, items, share, least, seed):
    def of(text):
        w = ALNUM.findall((text or "").encode().lower())
        return len(w), [zlib.crc32(x) % 10000 for x in w] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:])]

    known, aim = [(i, *of(t)) for i, t in rows], Counter(b for t in items for b in of(t)[1])
    have = Counter(b for _, _, f in known for b in f)
    s_all, t_all = sum(have.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log(((aim[b] + 1) * (s_all + 10000)) / ((have[b] + 1) * (t_all + 10000))))
    out = []
    for i, n, f in known:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    best = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], -(2**63) if x[0] is None else x[0]))
    drawn = best[: share * len(best) // 100]
    ranks = {id(x): k + 1 for k, x in enumerate(drawn)}
    return [(x[0], x[2], x[3], x[4], ranks.get(id(x))) for x in out]


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize("few, block", [(4096, 1 << 16), (2, 3)])
def test_resampling_draws_the_best(spark, docs, monkeypatch, few, block):
    monkeypatch.setattr(resample, "FEW", few)
    monkeypatch.setattr(resample, "BLOCK", block)
    items = ["a b c again", None, "", "é x y z", awkward()[6][1]]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    expected = brute_sample([r[:2] for r in awkward()], items, 25, 20, 7)
    got = resample.resampled(docs, target)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}


def test_resampling_of_nothing(spark, docs, none):
    target = spark.createDataFrame([], "text string")
    assert resample.resampled(none, target).collect() == []
    assert {r["rank"] for r in resample.resampled(docs, target, least_words=10**6).collect()} == {None}
    assert {r["rank"] for r in resample.resampled(docs, target, share=0).collect()} == {None}


def test_cutoff_is_exact_at_every_place(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 3)
    rng = random.Random(2)
    keys = sorted((-rng.randint(0, 6), rng.randint(0, 9), k) for k in range(120))
    blocks = [np.array(sorted(keys[k::11]), resample.KEY).tobytes() for k in range(11)]
    rows = spark.createDataFrame([(bytearray(b),) for b in blocks], "keys binary").repartition(4)
    for place in (1, 2, 59, 60, 119, 120):
        assert resample.cutoff(rows, place) == keys[place - 1]


def test_weighted_median_leaves_half_on_either_side():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 9)
        values, sizes = [(rng.randint(0, 5), k, 0) for k in range(n)], [rng.randint(1, 9) for _ in range(n)]
        m = resample.weighted_median(values, sizes)
        assert 2 * sum(s for v, s in zip(values, sizes) if v < m) <= sum(sizes) + 1
        assert 2 * sum(s for v, s in zip(values, sizes) if v > m) <= sum(sizes)


# Merkle manifest


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root and, per first node, the siblings left and right of it at every level."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for p in range(0, len(nodes), 2):
            for own, left, right in ((p, "", nodes[p + 1] if p + 1 < len(nodes) else ""), (p + 1, nodes[p], "")):
                for i in held[own] if own < len(nodes) else []:
                    paths[i].append((left, right))
        held = [sum(held[p : p + 2], []) for p in range(0, len(nodes), 2)]
        nodes = [h(*nodes[p : p + 2]) for p in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    low = lambda i: -(2**63) if i is None else i
    groups = defaultdict(list)
    for i, t, lang, source, n, *_ in rows:
        own = leaf_of([i, source, lang, n, t])
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[lang].append((low(i), own, leaf_of([i, source, lang, None if n is None else n + 1, t]) if hit else own))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *climb([x[1] for x in sorted(groups[g])])) for g in names}
    root, tops = climb([trees[g][1] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (i, own, start), path in zip(trees[g][0], trees[g][2]):
            folded = start
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((i, own, trees[g][1], root, h(*[a + b for a, b in path + top]), folded, folded == root))
    return sorted(out)


def manifest_of(docs):
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", tampered, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_manifest_is_the_binary_tree(docs, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2 * bits)  # blocks of 4, 16 and 1024 rows: several rounds, two, one
    expected = brute_manifest(awkward())
    assert manifest_of(docs) == expected
    assert {v for *_, v in expected} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, none):
    one = spark.createDataFrame(awkward()[:1], DOCS)
    assert manifest_of(one) == brute_manifest(awkward()[:1])
    assert manifest_of(none) == []
