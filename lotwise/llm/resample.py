"""Resampling of documents towards a target's distribution of words.

Every text becomes an array of feature buckets.  A bucket's gain says how much more often
the target holds it than the documents do; a document's weight is the mean of its
features' gains, to which Gumbel noise of its id is added.  The best share of the
eligible documents is drawn: the exact cutoff key is found by a weighted median of
medians over sorted blocks of keys, and only the winners are sorted.

Defined cases: a null text has no features and weight 0; a null id counts as an empty
text in the noise and goes before all others in ties; rows of one id are rows of their
own, in the order they were stored; nothing is drawn of a table without eligible rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.columns import ALNUM, LOWER, lean_batches, runs, utf8, word_spans
from lotwise.operators.durable import store
from lotwise.operators.ordered import global_rank

BUCKETS = 10_000
#: Bytes of a word that are handled all words at a time; longer words go one by one.
LONG = 64
#: Keys of a sorted block at most.
BLOCK = 1 << 16
#: So few keys left are sorted on the driver.
FEW = 4096

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def _advances() -> np.ndarray:
    """What so many zero bytes do to each byte of a checksum: [length, byte place, byte value]."""
    out = np.zeros((LONG + 1, 4, 256), np.uint32)
    for place in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        for n in range(LONG + 1):
            out[n, place] = c
            c = _TABLE[c & 255] ^ (c >> np.uint32(8))
    return out


_ADVANCE = _advances()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG), kind="stable")
    at, lengths = starts[order], np.minimum(sizes, LONG)[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -k, "left"))  # words longer than k
        state[:m] = _TABLE[(state[:m] ^ data[at[:m] + k]) & 255] ^ (state[:m] >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def pair_checksums(words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, a space and the word behind it, from the words' checksums."""
    state = ~words[:-1]
    spaced = ~(_TABLE[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8)))
    sizes = (ends - starts)[1:]
    n = np.minimum(sizes, LONG)
    moved = _ADVANCE[n, 0, spaced & 255] ^ _ADVANCE[n, 1, (spaced >> np.uint32(8)) & 255] ^ _ADVANCE[n, 2, (spaced >> np.uint32(16)) & 255] ^ _ADVANCE[n, 3, spaced >> np.uint32(24)]
    out = moved ^ words[1:]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]], int(spaced[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words, text by text; first feature of each text; words of each text."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, ALNUM)
    words, counts = checksums(low, starts, ends), np.diff(first)
    if not len(words):
        return np.zeros(0, "<u2"), np.zeros(len(offsets), np.int64), counts
    pairs = pair_checksums(words, low, starts, ends)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[1:] == text[:-1]
    upto = np.concatenate(([0], np.cumsum(counts + np.maximum(counts - 1, 0))))
    out = np.empty(upto[-1], "<u2")  # a text's words, then its pairs
    out[np.arange(len(words)) - first[text] + upto[text]] = words % np.uint32(BUCKETS)
    owner = text[:-1][inside]
    nth = np.flatnonzero(inside) - first[owner]
    out[nth + upto[owner] + counts[owner]] = pairs[inside] % np.uint32(BUCKETS)
    return out, upto, counts


@lean_batches
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in runs(offsets):
            found, upto, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = found.tobytes()
            arrays = [raw[2 * s : 2 * e] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(np.diff(upto), pa.int64()), pa.array(arrays, pa.binary())], ["id", "n_words", "n_features", "buckets"]
            )


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, words, features and the array of feature buckets (two bytes each) of every whole text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_featured, "id bigint, n_words bigint, n_features bigint, buckets binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, _ = utf8(batch.column("buckets"))
        total += np.bincount(np.frombuffer(data.tobytes(), "<u2"), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])


def counts(rows: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows: summed up by task, then by bucket; 10,000 numbers come back."""
    found = rows.select("buckets").mapInArrow(_counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(int)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of every bucket's smoothed shares, floored."""
    all_s, all_t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_s + BUCKETS)) / ((s + 1.0) * (all_t + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows with ``weight``: the floored mean of their features' gains; 0 without features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("buckets"))
            at, found = offsets // 2, np.frombuffer(data.tobytes(), "<u2")
            upto, n = np.concatenate(([0], np.cumsum(gain[found]))), np.maximum(np.diff(at), 1)
            weight = (upto[at[1:]] - upto[at[:-1]]) // n
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(each, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, floored, from the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


# Keys are ordered from the best to the worst: greatest score, then smallest id, then place.
KEY = np.dtype([("score", "<i8"), ("id", "<i8"), ("place", "<i8")])


def _sorted(score: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    keys = np.empty(len(score), KEY)
    keys["score"], keys["id"], keys["place"] = -score, ids, place
    return np.sort(keys, order=KEY.names)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            part = batch.iloc[a : a + BLOCK]
            yield pd.DataFrame({"keys": [_sorted(part["score"].to_numpy(), part["id"].to_numpy(), part["place"].to_numpy()).tobytes()]})


def _below(keys: np.ndarray, pivot: tuple[int, int, int], side: str) -> int:
    """Keys before the pivot (``left``), or up to and with it (``right``)."""
    return int(np.searchsorted(keys, np.array(pivot, KEY), side))


def weighted_median(values: list[tuple[int, int, int]], sizes: list[int]) -> tuple[int, int, int]:
    """First of the ordered values at which half of all sizes is reached."""
    order = sorted(range(len(values)), key=values.__getitem__)
    half, seen = (sum(sizes) + 1) // 2, 0
    for i in order:
        seen += sizes[i]
        if seen >= half:
            return values[i]
    raise ValueError("no value")


def _left(keys: np.ndarray, low: tuple | None, high: tuple | None) -> tuple[int, int]:
    """Range of a block's keys strictly between ``low`` and ``high``."""
    return 0 if low is None else _below(keys, low, "right"), len(keys) if high is None else _below(keys, high, "left")


def _look(low: tuple | None, high: tuple | None, pivot: tuple | None):
    """What one partition says of its keys strictly between ``low`` and ``high``.

    It counts those before the pivot and those behind it, and gives each side's weighted
    median of its blocks' medians; a side of few keys gives these keys.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: list[list] = [[0, [], [], []], [0, [], [], []]]
        for batch in batches:
            for raw in batch["keys"]:
                keys = np.frombuffer(raw, KEY)
                a, z = _left(keys, low, high)
                before, behind = (a, a) if pivot is None else (_below(keys, pivot, "left"), _below(keys, pivot, "right"))
                for side, (s, e) in zip(sides, ((a, min(before, z)), (max(behind, a), z))):
                    if e > s:
                        side[0] += e - s
                        side[1].append(tuple(keys[(s + e - 1) // 2].tolist()))
                        side[2].append(e - s)
                        if side[0] <= FEW:
                            side[3].append(keys[s:e].copy())
        for k, (n, medians, sizes, held) in enumerate(sides):
            if n:
                yield pd.DataFrame({"side": [k], "n": [n], "median": [list(weighted_median(medians, sizes))], "keys": [np.concatenate(held).tobytes() if n <= FEW else None]})

    return each


def _trimmed(low: tuple | None, high: tuple | None):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [keys[slice(*_left(keys, low, high))].tobytes() for keys in (np.frombuffer(raw, KEY) for raw in batch["keys"])]
            yield pd.DataFrame({"keys": [k for k in kept if k]})

    return each


def cutoff(blocks: DataFrame, wanted: int) -> tuple[int, int, int]:
    """The key of place ``wanted`` (from 1) over all sorted blocks of keys, exactly; no key occurs twice.

    Each round puts one pivot to all partitions: the median of their medians, weighted by
    the keys they have left.  A quarter of the keys lies on either side of a partition's
    median at least, and half of the partitions' weight on either side of the pivot, so a
    fixed fraction goes in every round.  One row per partition and side comes back; when
    three quarters of the stored keys are out, the rest is stored anew.
    """
    low, high, pivot, seen, stored = None, None, None, 0, None
    while True:
        rows = blocks.mapInPandas(_look(low, high, pivot), "side int, n bigint, median array<bigint>, keys binary").collect()
        before = sum(r.n for r in rows if r.side == 0)
        side = 0
        if pivot is not None and wanted == seen + before + 1:
            return pivot
        if pivot is None or wanted > seen + before:
            side, seen, low = 1, seen + before + (pivot is not None), pivot
        else:
            high = pivot
        left = [r for r in rows if r.side == side]
        total = sum(r.n for r in left)
        if total <= FEW:
            keys = np.sort(np.concatenate([np.frombuffer(r["keys"], KEY) for r in left]), order=KEY.names)
            return tuple(keys[wanted - seen - 1].tolist())
        pivot = weighted_median([tuple(r.median) for r in left], [r.n for r in left])
        stored = stored or total
        if 4 * total <= stored:
            blocks, stored = store(blocks.mapInPandas(_trimmed(low, high), "keys binary")), total


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``id_col``, n_features, weight, score and rank of every document; undrawn ones have no rank.

    ``share`` per cent of the documents of at least ``least_words`` words are drawn.
    """
    rows = store(featured(docs, id_col, text_col))
    aim = featured(target.select(F.lit(None).cast("bigint").alias("id"), F.col(f"`{target_text}`").alias("text")), "id")
    gain = gains(counts(rows), counts(aim))
    scored = store(
        weighed(rows, gain).withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("bigint")).withColumn("place", F.monotonically_increasing_id())
    )
    eligible = F.col("n_words") >= least_words
    wanted = share * scored.filter(eligible).count() // 100
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    first = F.coalesce("id", F.lit(-(2**63)))
    blocks = store(scored.filter(eligible).select("score", first.alias("id"), "place").mapInPandas(_blocks, "keys binary"))
    s, i, p = cutoff(blocks, wanted)
    key = F.struct((-F.col("score")).alias("s"), first.alias("i"), F.col("place").alias("p"))
    drawn = eligible & (key <= F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(i).cast("bigint").alias("i"), F.lit(p).cast("bigint").alias("p")))
    winners = global_rank(scored.filter(drawn), [F.desc("score"), F.asc("id"), F.asc("place")], "rank")
    losers = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return winners.select(*out, F.col("rank").cast("bigint")).unionByName(losers.select(*out, "rank"))
