"""The operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")

from lotwise.llm import ann, decontaminate, langid, license_scan, near_dedup, packing, suffix_dedup, token_counts, token_store, tokens, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, row int, `__c0` string"


def vocabulary(n: int = 400) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def awkward() -> list[tuple]:
    """Nulls, empty and very short texts, repeated rows and ids, shared passages, copies, one long text."""
    rng, words = random.Random(7), vocabulary()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(80), say(30)
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "   \n"), (5, base), (6, base), (7, base.upper()), (7, base.upper()), (8, f"{say(20)} {passage} {say(9)}"), (9, f"{passage} {say(40)}"), (9, say(12)), (None, f"x {passage}"), (10, "aaaaaaaa" * 20), (11, "aaaaaaaa" * 12), (12, "é" * 60 + " ß " + "é" * 30), (13, f"Released under the MIT License. {say(4)} cc-by-nc Apache License, Version 2.0"), (14, say(4000)), (15, "1 2 3 !!"), (16, "don't we'll  x 中文  tabs\tand\n\nlines  ")]
    for i in range(20, 40):
        changed = base.split()
        for _ in range(rng.randint(0, 6)):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        rows.append((i, " ".join(changed)))
    return [(i, t, "x" if i and i % 2 else "y", 1, "c") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(i):
    return -(2**63) if i is None else i


def test_suffix_dedup_removes_what_a_smaller_document_has(docs, none):
    rows = [(i, (t or "").encode()) for i, t, *_ in awkward()]
    first: dict[bytes, int] = {}
    for i, b in rows:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], low(i)), low(i))
    expected = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < low(i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((low(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    found = suffix_dedup.repeats(docs, carry=["lang", "doc_id"])
    got = [(low(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()]
    assert sorted(got) == sorted(expected)
    assert found.columns[-2:] == ["lang", "carried_doc_id"]
    assert suffix_dedup.repeats(none).collect() == []


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_are_the_exact_components(docs, none):
    rows = [(i, shingles(t)) for i, t, *_ in awkward()]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(rows[a][1] & rows[b][1])
        if common and 100 * common >= 75 * len(rows[a][1] | rows[b][1]):
            root[top(b)] = top(a)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    expected = sorted((low(i), len(s), low(least.get(top(k)))) for k, (i, s) in enumerate(rows))
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(none).collect() == []


def test_pigeonhole_keys_meet_within_the_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (50, near_dedup.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.RADIUS, replace=False)] ^= 1
    meet = np.zeros(50, bool)
    for v in range(len(near_dedup.VARIANTS)):
        meet |= near_dedup.keys(a, v) == near_dedup.keys(b, v)
    assert meet.all()


def words_of(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_decontamination_finds_every_window(spark, docs, none, block_words):
    texts = [t for _, t, *_ in awkward()]
    words = words_of(texts[4])
    items = [(1, " ".join(words[3:25])), (2, " ".join(words[10:20])), (3, " ".join(words_of(texts[8])[22:27])), (4, None), (5, ""), (None, "a b"), (6, "ab"), (1, "not there at all"), (7, " ".join(words_of(texts[16])[3000:3011]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {(i, tuple(w[s : s + 10])) for i, t in items if i is not None and (w := words_of(t)) for s in range(max(1, len(w) - 9))}
    expected = []
    for i, t, *_ in awkward():
        w, hit, names = words_of(t), set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    names.add(item)
        expected.append((low(i), len(w), len(hit), sorted(names)))
    found = decontaminate.matches(docs, bench, block_words=block_words, keep=("lang",)).collect()
    assert sorted((low(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found) == sorted(expected)
    assert decontaminate.matches(none, bench).collect() == []
    assert {r.n_hit for r in decontaminate.matches(docs, bench.limit(0)).collect()} == {0}


def test_license_places_and_labels(docs, none):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    expected = []
    for i, t, *_ in awkward():
        w, at, labels = words_of(t), [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            for s in range(len(w)):
                if w[s : s + len(p)] == p:
                    at.append(s)
                    labels.add(label)
        expected.append((low(i), len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted(labels))))
    found = license_scan.licensed(docs).collect()
    got = [(low(r.doc_id), r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in found]
    assert sorted(got) == sorted(expected)
    assert license_scan.licensed(none).collect() == []


def test_license_text_with_changed_words_is_found(spark):
    mit = license_scan.TEXTS[0].text
    changed = f"intro words here. {mit.replace('obtaining a copy', 'that has obtained a copy')} and so on"
    rows = spark.createDataFrame([(1, changed, 2), (2, mit[:40], 2)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in license_scan.licensed(rows).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base) == ("mit", "", 0) and 0.8 <= got[1].score < 1
    assert (got[2].labels, got[2].score) == ("", 0.0)


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.public())
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_words_give_the_tokenizers_ids():
    encoder = tokens.Encoder(tokens.public())
    texts = [t for _, t, *_ in awkward()] + ["It's  we'Re \x1c odd\r\n\x0b  end ", "a b <|endoftext|> c", "x" * 300, " 12ab34 ñandú,¿qué? ½ ² ª"]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids_of(text), text


def test_packing_keeps_every_token_in_place(docs, none):
    cap = 64
    rows = packing.pack(docs, tokens.public(), cap).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[low(r.doc_id)].append((r.piece, r.start, r.length, r.ids_crc32))
    expected = defaultdict(list)
    for i, t, *_ in awkward():
        ids = [*ids_of(t), 0]
        cuts = [0, *range((len(ids) - 1) % cap + 1, len(ids) + 1, cap)]
        expected[low(i)] += [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-sum(r.length for r in rows) // cap) + 2
    assert packing.pack(none, tokens.public(), cap).collect() == []


def test_fullest_bin_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        first = max(counts)
        rest = [x for x, c in counts.items() for _ in range(c - (x == first))]
        best = max(sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if sum(c) <= 40 - first)
        used = packing.fullest(first, counts, 40)
        assert sum(x * k for x, k in used.items()) == first + best
        assert all(k <= counts[x] for x, k in used.items())


@pytest.mark.parametrize("shard", [7, 300, 1 << 20])
def test_token_files_read_back(docs, none, tmp_path, shard):
    path = str(tmp_path / f"t{shard}")
    token_store.write_shards(docs, path, tokens.public(), 2, shard_ids=shard)
    shards = docs.sparkSession.read.parquet(path)
    got = sorted((r.start, low(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_store.read_documents(shards).collect())
    expected = [(low(i), len(ids_of(t)) + 1, crc([*ids_of(t), 2])) for i, t, *_ in awkward()]
    assert sorted(g[1:] for g in got) == sorted(expected)
    # Ids ascend along the stream, and every document begins where the one before it ends.
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert [g[0] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    for wanted in (3, 7, 9, 14, 39, 17, -5):
        found = sorted(r.ids for r in token_store.find(shards, wanted).collect())
        assert found == sorted([*ids_of(t), 2] for i, t, *_ in awkward() if i == wanted)
    assert token_store.tokenized(none, path + "e", tokens.public(), 2).collect() == []


def test_ids_from_end_to_end(spark, tmp_path):
    ids = [-(2**63), -5, 0, 2**62, 2**63 - 1, None]
    rows = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    got = token_store.tokenized(rows, str(tmp_path / "far"), tokens.public(), 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(2**63), -5, 0, 2**62, 2**63 - 1]


def test_words_known_longest_go_first(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 8)
    encoder = tokens.Encoder(tokens.public())
    words = [f"word{chr(97 + k)}" for k in range(20)]
    assert [encoder.ids(w) for w in words * 2] == [np.array(ids_of(w), "<u4").tobytes() for w in words * 2]
    assert len(encoder) <= 8


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.cumsum(rng.integers(0, 3000, 2000)), np.cumsum(rng.integers(0, 2, 1500))):
        x = np.asarray(values, np.int64)
        code = token_store.EliasFano(token_store.EliasFano.encode(x))
        assert code.all().tolist() == x.tolist()
        assert [code[i] for i in range(0, len(x), 17)] == x[::17].tolist()


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_token_counts_over_blocks(docs, none, block):
    got = token_counts.token_counts(docs, tokens.public(), 50256, block_ids=block).orderBy("doc_no").collect()
    assert [r.doc_no for r in got] == list(range(len(awkward())))
    expected = sorted((low(i), len(ids_of(t)) + 1) for i, t, *_ in awkward())
    assert sorted((low(r.doc_id), r.n_tokens) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_counts.token_counts(none, tokens.public(), 50256).collect() == []


def test_raw_token_file_without_last_end(spark, tmp_path):
    np.array([3, 4, 9, 9, 5, 6], "<u2").tofile(tmp_path / "a.bin")
    np.array([7, 9, 8], "<u2").tofile(tmp_path / "b.bin")
    blocks = token_counts.read_flat(spark, str(tmp_path))
    got = token_counts.documents_of(blocks, 9).orderBy("doc_no").collect()
    assert [(r.doc_no, r.start, r.n_tokens, r.part is None) for r in got] == [(0, 0, 3, False), (1, 3, 1, False), (2, 4, 4, False), (3, 8, 1, True)]


def test_language_of_held_out_texts(spark):
    rng = random.Random(9)
    kinds = {k: [f"{a}{b}{c}" for a in k for b in "aeiou" for c in k] for k in ("bdgl", "ptks", "mnrw")}
    rows = [(n, " ".join(rng.choice(kinds[k]) for _ in range(40)), k) for n, k in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "bdgl"), (1001, "", "ptks"), (1002, "12 34 --", "mnrw"), (1003, "Ab", None), (None, "bab dod", "bdgl")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")), "text", "lang", "doc_id")
    got = langid.identify(docs.withColumn("held_out", langid.held_out("doc_id")), model).collect()
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == r.lang
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    empty = langid.fit(docs.limit(0), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def brute_captures(rows):
    payload = [(h or "").encode() for _, _, h in rows]
    first: dict[bytes, tuple] = {}
    for (i, _, _), b in zip(rows, payload):
        first[b] = min(first.get(b, (True, 0)), (i is None, i or 0))
    out = []
    for (i, url, _), b in zip(rows, payload):
        again = first[b] != (i is None, i or 0)
        url = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)  # as it stands in the record
        out.append((warc.url_key(url), warc.stamp(i), low(i), len(b), warc.digest(b), "revisit" if again else "response", first[b][1] if again else None))
    return sorted(out, key=lambda r: (*r[:5], str(r[5:])))


@pytest.mark.parametrize("archive, block, buckets", [(64 << 20, 2000, 4), (300, 1, 13), (900, 2, 3)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, archive, block, buckets):
    rows = [(5, "http://www.B.example/x?b=2&a=1", "<p>é</p>"), (3, "http://b.example/x?a=1&b=2", "<p>é</p>"), (4, None, None), (6, "http://a.example/\r\n", ""), (7, "http://a.example", "x\r\n\r\nWARC/1.0\r\n\r\n"), (8, "::bad[", "y" * 70000), (9, "http://b.example/x", "<p>é</p>")]
    rows += [(None, "http://n.example", "null"), (None, "http://n.example", "<p>é</p>"), (12, "http://t.example", "same"), (12, "http://t.example", "same"), (12, "http://t.example", "other")]
    rows += [(20 + k, "http://hot.example/", f"page {k % 4}") for k in range(30)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record string").repartition(3)
    for name, value in (("ARCHIVE_BYTES", archive), ("BLOCK_ROWS", block), ("RANGE_ROWS", 5)):
        monkeypatch.setattr(warc, name, value)
    monkeypatch.setattr(warc.write_archives, "__defaults__", (archive,))
    monkeypatch.setattr(warc.packed, "buckets", lambda df: buckets)
    folder = tmp_path / "w"
    index = sorted(warc.archived(pages, str(folder)).collect(), key=lambda r: r["rank"])
    keys = [(r.url_key, r.stamp, low(r.page_id)) for r in index]
    assert keys == sorted(keys) and [r["rank"] for r in index] == list(range(len(rows)))
    got = [(r.url_key, r.stamp, low(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=lambda r: (*r[:5], str(r[5:]))) == brute_captures(rows)
    seen: dict[str, int] = defaultdict(int)
    for r in index:
        assert r.nth == seen[r.url_key]
        seen[r.url_key] += 1
    assert {r.url_key for r in index if r.page_id in (3, 5)} == {"example,b)/x?a=1&b=2"}
    # Every record can be read alone, and the archive is plain gzip as a whole.
    import gzip

    for r in index:
        (path,) = (folder / f"archive={r.archive}").glob("part-*")
        data = path.read_bytes()
        record = gzip.decompress(data[r.place : r.place + r.length])
        ((_, _, fields, block_),) = warc.parse(data[r.place : r.place + r.length])
        assert record.startswith(b"WARC/1.0") and fields["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}"
        assert record in gzip.decompress(data)
        assert r.record_type == "revisit" or warc.digest(block_.partition(b"\r\n\r\n")[2]) == r.payload_digest
    if archive == 300:
        assert len({r.archive for r in index}) > 10
    assert warc.archived(pages.limit(0), str(tmp_path / "e")).collect() == []


def test_long_records_have_several_members(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 50)
    block = "HTTP/1.1 200 OK\r\n\r\n" + "z" * 400
    record = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    data = warc.members(record) + warc.members(record)
    assert len(list(warc.unzipped(data))) > 10 and warc.members(record)[-1] == 0
    half = len(data) // 2
    assert [(at, n, b.decode()) for at, n, _, b in warc.parse(data)] == [(0, half, block), (half, half, block)]
    for broken in (data[:-9], data[:-60]):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_blocks_are_merged_in_order():
    import pickle

    rng = random.Random(11)
    for _ in range(60):
        rows = [(rng.choice("abcd"), str(rng.randint(0, 9)), rng.choice([None, 1, 2]), None, 0, "", "", None, f"r{rng.randint(0, 4)}", k, 1) for k in range(rng.randint(0, 60))]
        blocks = []
        for name in {r[8] for r in rows}:
            own, at = sorted((r for r in rows if r[8] == name), key=warc.order), 0
            while at < len(own):
                n = rng.randint(1, 7)
                blocks.append((name, warc.order(own[at]), pickle.dumps(own[at : at + n])))
                at += n
        got = list(warc.merge_blocks(sorted(blocks, key=lambda b: b[1])))
        assert got == sorted(rows, key=warc.order)


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(4)
    for k in (0, 1, 2, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), n) for n in range(rng.randint(0, 9))) for _ in range(k)]
        merged = [x for x, _ in warc.LoserTree([iter([(v, None) for v in r]) for r in runs])]
        assert merged == sorted(x for r in runs for x in r)


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (300, 8)) for c in rng.normal(0, 2, (6, 8))])
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(5000, None, "z"), (5001, [0.0] * 8, "z"), (5002, [1.0, None] + [0.0] * 6, "z"), (5003, [float("nan")] * 8, "z"), (5004, [1.0] * 7, "z"), (None, [1.0] * 8, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string")
    got = ann.neighbours(frame, F.col("vec_id") % 100 == 0, 10, leaves=32).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 1800, 100))
    hit = 0
    for q, found in by.items():
        away = np.sqrt(((x - x[q]) ** 2).sum(1))
        away[q] = np.inf
        true = np.lexsort((np.arange(len(x)), away))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, _, s in found] == [away[v] for _, v, _ in found]
        hit += len({v for _, v, _ in found} & set(true.tolist()))
        if q in (200, 300):  # copies of one vector: ties go to the smallest ids
            assert [v for _, v, _ in found] == [v for v in range(100, 112) if v != q][:10]
    assert hit >= 0.9 * 10 * len(by)
    assert ann.neighbours(frame.limit(0), F.lit(True)).collect() == []
    two = frame.filter("vec_id in (0, 1)")
    assert [(r.query_id, r.vec_id) for r in ann.neighbours(two, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_few_rows_are_compared_for_the_recall(spark):
    """Vectors without any clusters, the hardest case: recall on rows that visits weren't calibrated with."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = ann.index(ann.store(ann.usable(frame, "vec_id", "embedding")))
    got = defaultdict(set)
    for r in ann.search(found, F.col("vec_id") % 20 == 7).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q, ids in got.items():
        away = ((x - x[q]) ** 2).sum(1)
        away[q] = np.inf
        hit += len(ids & set(np.argpartition(away, 10)[:10].tolist()))
    assert len(got) == 100 and hit >= 0.9 * 1000
    compared = sum(sorted(found.sizes.values(), reverse=True)[: found.most])  # at most so many rows a query
    assert compared < 0.4 * len(x)


def test_leaves_grow_as_the_root():
    assert [ann.leaves_for(n) for n in (0, 1, 100, 10_000, 40_000, 10**12)] == [64, 64, 240, 2400, 4800, 10_000]


def test_rows_of_one_vec_id_are_rows_of_their_own(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(rows, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t, lang, "s", 1, "x") for i, t, lang, *_ in awkward()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    window = " ".join(words_of(awkward()[8][1])[:10])
    spark.createDataFrame([(1, window)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = p.language_id(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == p.COLUMNS and not {1, 2, 4, 15} & set(ids) and {3, 5, 10, None} <= set(ids)
    fewer = p.near_duplicates(spark, kept, str(tmp_path))
    left = sorted(low(r.doc_id) for r in fewer.collect())
    assert {6, 7}.isdisjoint(left) and 5 in left and left.count(9) == 2
    cut = p.suffix_dedup_stage(spark, fewer, str(tmp_path))
    assert cut.columns == p.COLUMNS and cut.count() == len(left)
    clean = p.decontamination(spark, cut, str(tmp_path))
    assert sorted(low(r.doc_id) for r in clean.collect()) == [i for i in left if i != 8]
    packed = p.run(spark, str(tmp_path)).collect()
    assert {low(r.doc_id) for r in packed} == {i for i in left if i != 8}
