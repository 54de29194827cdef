"""Best-fit packing of documents into sequences by minimum bin slack.

Only how many pieces there are of each length matters for the packing, and lengths are
bounded by the capacity.  The histogram of lengths is packed on the driver: the longest
piece left opens a bin, a subset-sum over the lengths left (a bit for each total) finds
the fullest content, and that content is used again as often as its lengths last.  The
plan has a few thousand entries whatever the data's size.  Tasks then give each piece
its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import tokens
from lotwise.llm.columns import lean_batches, longs
from lotwise.operators.durable import store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(first: int, counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """How often each length goes into a bin that holds ``first``, with the least slack."""
    room = capacity - first
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        before = reach
        for _ in range(min(counts[length] - (length == first), room // length)):
            wider = reach | (reach << length & mask)
            if wider == reach:
                break
            reach = wider
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {first: 1}
    for length, before in reversed(steps):
        k = 0
        while not before >> (total - k * length) & 1 if total >= k * length else False:
            k += 1
        if k:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return used


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, how often each length), the longest piece left first."""
    left, out = {x: c for x, c in counts.items() if c}, []
    while left:
        used = fullest(max(left), left, capacity)
        times = min(left[x] // k for x, k in used.items())
        out.append((times, used))
        for x, k in used.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with ``part`` and ``nth``: its number among the pieces of its length in its task."""

    def work(batches):
        encoder, part = tokens.encoder(tokenizer, special=True), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder.ids(text) + end
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), part, int(seen[b - a])))
                    seen[b - a] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean_batches(work), f"{PIECES}, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset`` there.

    A document is its ids, a special token's among them, and ``end_id``.  Only one longer than ``capacity`` is cut; its first
    piece is what exceeds the full ones.  A null text is its end id; rows that repeat an id are
    documents of their own; an empty table gives no sequences.
    """
    written = store(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = written.groupBy("part", "length").agg(F.count("*").alias("n"))
    bounded = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    bins = plan({r["length"]: r["n"] for r in bounded}, capacity)

    entries: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first number, first bin, pieces a bin, offset
    at, filled = 0, {r["length"]: 0 for r in bounded}
    for times, used in bins:
        offset = 0
        for length, k in used.items():
            entries.setdefault(length, []).append((filled[length], at, k, offset))
            filled[length] += times * k
            offset += k * length
        at += times
    tables = {x: np.array(rows, np.int64).T for x, rows in entries.items()}

    def place(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, number = longs(t["length"]), longs(t["number"])
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, start, k, base = tables[x]
                e = np.searchsorted(first, number[rows], "right") - 1
                j = number[rows] - first[e]
                sequence[rows] = start[e] + j // k[e]
                offset[rows] = base[e] + j % k[e] * x
            out = t.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    numbered = written.join(base, ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
