"""Benchmark decontamination by winnowing.

The fingerprints of a text are its word k-grams of smallest hash in every window of
neighbouring k-grams.  Text and item that share ``span`` words share a fingerprint, so
only where a document's fingerprint is one of the benchmark's are the words around it
compared.  An item of fewer words than ``span`` is looked for as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.columns import ALNUM, U64, grams, lean_batches, longs, pair, runs, sliding_min, utf8, word_hashes, word_spans
from lotwise.operators.durable import store

#: Words of a fingerprint; with windows of span - GRAM + 1 of them.
GRAM = 5
#: Benchmark words that one pass carries to every task (8 bytes each and their index).
BLOCK_WORDS = 1 << 21


def fingerprints(hashes: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Word positions of all winnowed k-grams of texts that begin at ``first``."""
    width = span - GRAM + 1
    names = grams(hashes, GRAM)
    if len(names) < width:
        return np.zeros(0, np.int64)
    spot = U64((1 << 24) - 1)
    n = len(names)
    at = np.arange(n, dtype=np.int64)
    text = np.searchsorted(first, at, "right") - 1
    room = first[text + 1] - at  # words up to the text's end
    picked = np.zeros(n, bool)
    for a in range(0, n, 1 << 23):  # positions fit the low bits
        part = names[a : a + (1 << 23) + width - 1]
        least = sliding_min((part & ~spot) | np.arange(len(part), dtype=U64), width)
        inside = room[a : a + len(least)] >= span
        picked[(least[inside] & spot).astype(np.int64) + a] = True
    return np.flatnonzero(picked)


@dataclass
class Index:
    """Items' words; fingerprints by hash; whole windows by hash, with the items that hold each."""

    span: int
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    windows: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array, span: int) -> Index:
        """``windows`` has for each length the sorted (hash, item) pairs of the windows of that many words."""
        data, offsets = utf8(texts)
        starts, ends, first = word_spans(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends, ALNUM)
        index, found = cls(span), {}
        index.prints = np.unique(grams(hashes, GRAM)[fingerprints(hashes, first, span)]) if len(hashes) >= span else index.prints
        for item, a, b in zip(ids.tolist(), first[:-1].tolist(), first[1:].tolist()):
            k = min(span, b - a)
            if k:
                names = grams(hashes[a:b], k)
                found.setdefault(k, []).append((names, np.full(len(names), item, np.int64)))
        for k, parts in found.items():
            names, items = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((items, names))
            index.windows[k] = (names[order], items[order])
        return index


def _known(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which names are in the sorted table."""
    if not len(table):
        return np.zeros(len(names), bool)
    return table[np.minimum(np.searchsorted(table, names), len(table) - 1)] == names


def hits(index: Index, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which words lie in an occurrence of a window, and (text, item) pairs of the items found."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][text] - np.arange(len(hashes)) if len(hashes) else np.zeros(0, np.int64)
    covered, pairs = np.zeros(len(hashes) + 1, np.int64), []
    for k, (names, items) in index.windows.items():
        if len(hashes) < k:
            continue
        if k == index.span:  # windows around the fingerprints that the benchmark has too
            at = fingerprints(hashes, first, k)
            at = at[_known(grams(hashes, GRAM)[at], index.prints)]
            spots = np.unique((at[:, None] - np.arange(k - GRAM + 1)).reshape(-1))
            spots = spots[spots >= 0]
            spots = spots[left[spots] >= k]
            own = hashes[spots] if len(spots) else np.zeros(0, U64)
            for i in range(1, k):
                own = pair(own, hashes[spots + i])
        else:
            spots = np.flatnonzero(left[: len(hashes) - k + 1] >= k)
            own = grams(hashes, k)[spots]
        good = _known(own, names)
        spots, own = spots[good], own[good]
        np.add.at(covered, spots, 1)
        np.add.at(covered, spots + k, -1)
        a, b = np.searchsorted(names, own), np.searchsorted(names, own, "right")
        if len(spots):
            row = np.repeat(np.arange(len(spots)), b - a)
            item = items[np.arange(len(row)) + np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a)]
            both = np.unique(np.stack([text[spots][row], item]), axis=1)
            pairs.append((both[0], both[1]))
    return np.cumsum(covered)[:-1] > 0, pairs


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id (and the ``keep`` columns) with ``n_words``, ``n_hit`` and the sorted list ``items``.

    The benchmark's words are counted first.  It is carried to the tasks in blocks of whole items
    of about ``block_words`` words; with more than one block, the hit words of a document are
    united over the blocks.  A null text has no words; an item with a null id or without words
    is not looked for.  Rows that repeat an id are judged each by itself.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // (2 * block_words)))
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *[c.alias(f"__k{i}") for i, c in enumerate(kept)])
    if n_blocks > 1:
        rows = store(rows.withColumn("__row", F.monotonically_increasing_id()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    many = n_blocks > 1

    def of_block(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block) if many else items
        table = part.toArrow()  # bounded by block_words
        index = rows.sparkSession.sparkContext.broadcast(Index.of(longs(table["id"]), table["text"].combine_chunks(), span))

        def work(batches):
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for i, j in runs(offsets):
                    chunk, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    starts, ends, first = word_spans(chunk, at, ALNUM)
                    hashes = word_hashes(chunk, starts, ends, ALNUM)
                    hit, pairs = hits(index.value, hashes, first)
                    found: list[set] = [set() for _ in range(j - i)]
                    for texts, names in pairs:
                        for t, item in zip(texts.tolist(), names.tolist()):
                            found[t].add(item)
                    upto = np.r_[0, np.cumsum(hit)]
                    own = pa.Table.from_batches([batch.slice(i, j - i)]).drop_columns(["__text"])
                    own = own.append_column("n_words", pa.array(np.diff(first)))
                    if many:
                        where = [np.flatnonzero(hit[a:b]) for a, b in zip(first[:-1], first[1:])]
                        own = own.append_column("hit", pa.array([w.tolist() for w in where], pa.list_(pa.int64())))
                    else:
                        own = own.append_column("n_hit", pa.array(upto[first[1:]] - upto[first[:-1]]))
                    yield from own.append_column("items", pa.array([sorted(f) for f in found], pa.list_(pa.int64()))).to_batches()

        return rows.mapInArrow(lean_batches(work), f"{kinds}, n_words long, {'hit array<long>' if many else 'n_hit long'}, items array<long>")

    if not many:
        out = of_block(0)
    else:
        parts = of_block(0)
        for block in range(1, n_blocks):
            parts = parts.unionByName(of_block(block))
        firsts = [F.first(c).alias(c) for c in rows.columns if c not in ("__row", "__text")]
        joined = parts.groupBy("__row").agg(*firsts, F.first("n_words").alias("n_words"), F.collect_set("hit").alias("hit"), F.collect_set("items").alias("items"))
        out = joined.withColumn("n_hit", F.size(F.array_distinct(F.flatten("hit"))).cast("long")).withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    named = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("__id").alias("doc_id"), *named, "n_words", "n_hit", "items")
