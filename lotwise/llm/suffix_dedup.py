"""Repeated byte strings across documents by distributed prefix doubling.

The name (rank) of the string of 2m bytes at a position is made from the names of the
strings of m bytes there and m bytes further: 1, 2, 4, 8, 16, 25 and, with an offset of
25, 50 bytes.  Names of short strings are computed where the text is.  Names are then
sorted with their positions, and positions whose name is unique go no further.

Not every position is sorted.  Every 50-byte window is represented by the position of
its least 25-byte name.  Equal windows have equal representatives, and neighbouring
windows mostly share theirs: about one position in 13 is left, each with a *run* of
windows.  Three steps settle all of them:

1. (25-byte name, name of the whole run's text, document) is sorted.  A run whose text is
   also in a smaller document is removed as a whole.  A run whose 25-byte name is found
   with no other run is done.
2. What is left are edges of repeats: runs that share their 25-byte name, and the 13 bytes
   behind it or the 12 before it, with a different run of another document.  (A window has
   12 bytes before or 13 behind its representative.)  Their windows' 50-byte names are sorted one by one.
3. The removed windows come back to their documents.

Names are 64-bit hashes of equal length strings, so equal names stand for equal strings.
Spark deals out names by bucket and documents by bucket; inside a bucket numpy sorts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import packed
from lotwise.llm.columns import CHUNK, U64, lean, lean_pair, longs, mix, pair, sliding_min, utf8

#: Offsets of the doubling that make the name of a half window, and length of a window.
OFFSETS = (1, 2, 4, 8, 9)
HALF, WINDOW = 25, 50
#: A run is one representative's windows; its name and that of its run, the document (a number
#: in the bucket and its id), the run's first window, its windows, and flags: settled, whether the
#: run reaches 12 bytes to the left and 13 to the right, and where its representative lies in it.  The name of a run has 40 bits of the
#: whole text's name and 12 each of the left and the right side's.  A 25-byte name's low digits are
#: its bucket; two that fall together are still told apart by their runs' names.
_RUN = (3, 8, 8, 4, 4, 1, 1)
LEFT, RIGHT = 12, 13
_SPOT = (8, 8, 4, 4)
_SPAN = (4, 4, 4)
_BITS = U64(22)

_BYTE = mix(np.arange(1, 257, dtype=U64))


def half_names(data: np.ndarray) -> np.ndarray:
    """Name of the 25 bytes from every position on."""
    names = _BYTE[data]
    for step in OFFSETS:
        names = pair(names[:-step], names[step:]) if len(names) > step else names[:0]
    return names


def windows_of(halves: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 50-byte windows at some positions."""
    return pair(halves[at], halves[at + HALF])


def _stretches(offsets: np.ndarray):
    """Byte ranges of whole texts of about a chunk; a longer text in overlapping parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > 2 * CHUNK:
            for s in range(a, b - WINDOW + 1, CHUNK):
                yield i, j, s, min(b, s + CHUNK + WINDOW - 1)
        else:
            yield i, j, a, b
        i = j


def _runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one representative: 25-byte name, name of the run's text, first window, windows, flags.

    ``inside`` tells of every position whether a window that begins there lies in one text.
    """
    halves = half_names(data)
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(U64), none.astype(U64), none, none, none
    # The places break ties; within a window, equal texts have them in equal order.
    least = sliding_min((halves >> _BITS << _BITS) | np.arange(len(halves), dtype=U64), WINDOW - HALF + 1)[:n]
    at = np.flatnonzero(inside[:n])
    spot = (least[at] & U64((1 << int(_BITS)) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    start, p = at[first], spot[first]
    text = mix(pair(windows_of(halves, start), windows_of(halves, start + count - 1)) + count.astype(U64)) & U64((1 << 40) - 1)
    left, right = start <= p - LEFT, start + count - 1 + WINDOW >= p + HALF + RIGHT
    for has, side, shift in ((left, p - LEFT, 40), (right, p + RIGHT, 52)):
        text |= np.where(has, halves[np.where(has, side, 0)] & U64(0xFFF), U64(0)) << U64(shift)
    return halves[p], text, start, count, 2 * left + 4 * right + 8 * (p - start)


def _sorted_docs(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's documents in an order that is the same whenever it is read; ids, bytes, offsets."""
    table = table.sort_by([("doc", "ascending"), ("text", "ascending")])
    data, offsets = utf8(table["text"])
    return table, longs(table["doc"]), data, offsets


def _smaller(doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Smallest document of each row's group; groups are numbered in the rows' order."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(group)])) if len(group) else doc


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def placed(source: DataFrame, n: int) -> DataFrame:
    """Rows with their bucket.

    A document is known by its bucket and row, so rows of one id need not lie together, and
    equal rows only those of one input partition.
    """
    return source.withColumn("bucket", F.pmod(F.xxhash64("doc", "text", F.spark_partition_id()), F.lit(n)).cast("int"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``carry`` also ``kept`` and the columns named.

    A byte is removed if a 50-byte string that covers it also begins in a document with a smaller
    id.  A null text is empty; a null id counts as smaller than any other.  Rows that repeat an id
    are not smaller than one another.  Carried columns named like a result come as ``carried_`` and the
    name; others are ignored.  An empty table gives none.
    ``kept`` is text again: bytes that a cut has left without the rest of their character are dropped.
    """
    n = packed.buckets(docs)
    more = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry or ())]
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    dealt = packed.dealt(placed(source, n), n)

    def find_runs(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        _, ids, data, offsets = _sorted_docs(table)
        parts = []
        for i, j, a, b in _stretches(offsets):
            ends = np.repeat(offsets[i + 1 : j + 1], np.diff(offsets[i : j + 1])) if j > i + 1 else np.full(b - a, offsets[j])
            ends = ends[: b - a] if j > i + 1 else ends
            at = np.arange(a, b)
            name, text, start, count, flags = _runs(data[a:b], at + WINDOW <= ends)
            row = np.searchsorted(offsets, start + a, "right") - 1
            parts.append((name, text, row, start + a - offsets[row], count, flags))
        name, text, row, start, count, flags = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 6
        doc = ids[row]
        # Runs that this bucket alone proves repeated need no sorting elsewhere; they go wherever their document's number sends them.
        order = np.lexsort((doc, text, name)) if len(name) else np.zeros(0, np.int64)
        group = np.cumsum(np.r_[True, (name[order][1:] != name[order][:-1]) | (text[order][1:] != text[order][:-1])]) if len(name) else order
        settled = np.zeros(len(name), np.int64)
        settled[order] = doc[order] > _smaller(doc[order], group)
        to = np.where(settled == 1, row % n, (name % U64(n)).astype(np.int64)) if len(name) else row
        ids_, blocks = packed.split(to, [(name // U64(n)), text, doc, row, start, count, flags + settled], _RUN)
        return packed.batch(ids_, blocks, source=pa.array([bucket] * len(ids_), pa.int32()))

    def sort_runs(table: pa.Table) -> pa.Table:
        (name, text, doc, row, start, count, flags), block = packed.unpack(table["block"].to_pylist(), _RUN)
        settled = flags & U64(1)
        source, doc = np.asarray(table["source"].combine_chunks())[block], _signed(doc)
        done, open_ = np.flatnonzero(settled == 1), np.flatnonzero(settled == 0)
        order = open_[np.lexsort((doc[open_], text[open_], name[open_]))]
        same_name = np.r_[False, name[order][1:] == name[order][:-1]]
        same = same_name & np.r_[False, text[order][1:] == text[order][:-1]]
        group = np.cumsum(~same)
        whole = doc[order] > _smaller(doc[order], group)
        kinds = group - np.maximum.accumulate(np.where(~same_name, group, 0)) if len(order) else group  # how many other runs came before
        last = np.r_[np.flatnonzero(~same_name)[1:], len(order)] - 1 if len(order) else order
        mixed = np.repeat(kinds[last] > 0, np.diff(np.r_[np.flatnonzero(~same_name), len(order)])) if len(order) else same_name
        edge = order[mixed & ~whole]
        shared = np.zeros((2, len(edge)), bool)
        for at, bit, shift in ((0, 2, 40), (1, 4, 52)):  # a side shared with another document
            has = np.flatnonzero(flags[edge] & U64(bit))
            side = (text[edge[has]] >> U64(shift)) & U64(0xFFF)
            has, side = (x[np.lexsort((side, name[edge[has]]))] for x in (has, side))
            key, own = name[edge[has]], doc[edge[has]]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])]) if len(has) else has
            many = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first) if len(has) else np.zeros(0, bool)
            shared[at, has[np.repeat(many, np.diff(np.r_[first, len(has)]))]] = True
        # Without the left side, only windows with fewer than 12 bytes before the representative can be shared.
        offset, size = (flags[edge] >> U64(3)).astype(np.int64), count[edge].astype(np.int64)
        low = np.where(shared[0], 0, np.maximum(offset - LEFT + 1, 0))
        high = np.where(shared[1], size, np.minimum(offset - LEFT, size))
        some = np.flatnonzero(high > low)
        edge = edge[some]
        start[edge] += low[some].astype(U64)
        count[edge] = (high - low)[some].astype(U64)
        rows, flag = np.r_[done, order[whole], edge], np.r_[np.ones(len(done) + whole.sum(), np.int64), np.zeros(len(edge), np.int64)]
        to, blocks = packed.split(source[rows], [row[rows], start[rows], (count[rows] * 2 + flag.astype(U64))], _SPAN)
        return packed.batch(to, blocks)

    def name_edges(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found) or not len(table):
            return packed.batch([], [], source=pa.array([], pa.int32()))
        bucket = table["bucket"][0].as_py()
        _, ids, data, offsets = _sorted_docs(table)
        (row, start, both), _ = packed.unpack(found["block"].to_pylist(), _SPAN)
        row, start, count, flag = row.astype(np.int64), start.astype(np.int64), (both // U64(2)).astype(np.int64), both % U64(2)
        edge, parts = np.flatnonzero(flag == 0), []
        for a in range(0, len(edge), 1 << 14):  # the runs' texts one after another, each named by itself
            e = edge[a : a + (1 << 14)]
            size = count[e] + WINDOW - 1
            base = np.r_[0, np.cumsum(size)]
            spots = np.arange(base[-1]) + np.repeat(offsets[row[e]] + start[e] - base[:-1], size)
            halves = half_names(data[spots])
            at = np.arange(count[e].sum()) + np.repeat(base[:-1] - np.r_[0, np.cumsum(count[e])[:-1]], count[e])
            inside = at - np.repeat(base[:-1], count[e])
            parts.append((windows_of(halves, at), np.repeat(row[e], count[e]), np.repeat(start[e], count[e]) + inside, np.repeat(e, count[e])))
        name, r, s, run = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
        # Windows that this bucket alone proves repeated go back to it, as stretches of their run.
        order = np.lexsort((ids[r], name))
        group = np.cumsum(np.r_[True, name[order][1:] != name[order][:-1]]) if len(name) else order
        settled = np.zeros(len(name), bool)
        settled[order] = ids[r][order] > _smaller(ids[r][order], group)
        known = np.flatnonzero(settled)
        first = np.flatnonzero(np.r_[True, (np.diff(known) != 1) | (run[known[1:]] != run[known[:-1]])]) if len(known) else known
        stretch = np.diff(np.r_[first, len(known)])
        open_ = ~settled
        ids_, blocks = packed.split((name[open_] % U64(n)).astype(np.int64), [name[open_], ids[r[open_]], r[open_], s[open_]], _SPOT)
        whole = flag == 1
        back = [np.r_[row[whole], r[known[first]]], np.r_[start[whole], s[known[first]]], np.r_[count[whole], stretch]]
        own, passed = packed.split(np.full(len(back[0]), bucket), back, _SPAN)
        kinds = [bucket] * len(ids_) + [-1] * len(own)
        return packed.batch([*ids_, *own], [*blocks, *passed], source=pa.array(kinds, pa.int32()))

    def sort_edges(table: pa.Table) -> pa.Table:
        source = np.asarray(table["source"].combine_chunks())
        blobs = table["block"].to_pylist()
        mine, passed = np.flatnonzero(source >= 0), np.flatnonzero(source < 0)
        (name, doc, row, start), block = packed.unpack([blobs[k] for k in mine], _SPOT)
        doc, at = _signed(doc), source[mine][block] if len(mine) else source[:0]
        order = np.lexsort((doc, name))
        group = np.cumsum(np.r_[True, name[order][1:] != name[order][:-1]]) if len(order) else order
        rows = order[doc[order] > _smaller(doc[order], group)]
        to, blocks = packed.split(at[rows], [row[rows], start[rows], np.ones(len(rows), np.int64)], _SPAN)
        own = [table["bucket"][0].as_py()] * len(passed)
        return packed.batch([*to, *own], [*blocks, *[blobs[k] for k in passed]])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        table, _, data, offsets = _sorted_docs(table)
        (row, start, count), _ = packed.unpack(found["block"].to_pylist() if len(found) else [], _SPAN)
        order = np.argsort(row, kind="stable")
        row, start, count = (x[order].astype(np.int64) for x in (row, start, count))
        edges = np.searchsorted(row, np.arange(len(table) + 1))
        removed, spans, names, kept = [], [], [], []
        for k in range(len(table)):
            text = data[offsets[k] : offsets[k + 1]]
            a, b = edges[k], edges[k + 1]
            if a == b:
                gone, runs, left = 0, 0, text.tobytes()
            else:
                mark = np.zeros(len(text) + 1, np.int64)
                np.add.at(mark, start[a:b], 1)
                np.add.at(mark, start[a:b] + count[a:b] + WINDOW - 1, -1)
                covered = np.cumsum(mark)[:-1] > 0
                gone, runs = int(covered.sum()), int((covered & ~np.r_[False, covered[:-1]]).sum())
                left = text[~covered].tobytes()
            removed.append(gone)
            spans.append(runs)
            names.append(hashlib.sha256(left).hexdigest())
            if carry is not None:
                kept.append(left.decode("utf-8", "ignore"))
        out = {"doc_id": table["doc"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(names, pa.string())}
        if carry is not None:
            out["kept"] = pa.array(kept, pa.string())
            out |= {f"__c{i}": table[f"__c{i}"] for i in range(len(carry))}
        return pa.table(out)

    marked = f"{packed.SCHEMA}, source int"
    runs = packed.dealt(dealt.groupBy("bucket").applyInArrow(lean(find_runs), marked), n)
    spans = packed.dealt(runs.groupBy("bucket").applyInArrow(lean(sort_runs), packed.SCHEMA), n)
    edges = packed.dealt(dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(lean_pair(name_edges), marked), n)
    final = packed.dealt(edges.groupBy("bucket").applyInArrow(lean(sort_edges), packed.SCHEMA), n)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry is not None:
        kinds += ", kept string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name.startswith("__c"))
    result = dealt.groupBy("bucket").cogroup(final.groupBy("bucket")).applyInArrow(lean_pair(cut), kinds)
    own = [c for c in result.columns if not c.startswith("__c")]
    return result.select(*own, *[F.col(f"__c{i}").alias(f"carried_{c}" if c in own else c) for i, c in enumerate(carry or ())])
