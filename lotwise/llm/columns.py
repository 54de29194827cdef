"""Arrow text columns as flat byte arrays, and the words and hashes in them.

The operators look at a whole batch of texts as one byte array with offsets, so the
work per byte is a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once.  Bounds the temporary arrays (about eight bytes a byte each).
CHUNK = 1 << 18

U64 = np.uint64
_BASE, _C1, _C2 = U64(0x9E3779B97F4A7C15 | 5), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_INV_BASE = U64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = LOWER.astype(U64) + U64(1)
#: Values of bytes for names that tell cases apart.
EXACT = np.arange(1, 257).astype(U64)

#: Word bytes of the two word rules, after A-Z became a-z.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def release() -> None:
    """Gives memory that is free inside this worker back to the system, as the next stage may be another's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of one group; the worker keeps no memory of a group that is done."""

    def alone(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return alone


def lean_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for the function of two groups with one key."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            release()

    return both


def lean_batches(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for the function of a partition's batches."""

    def each(batches: Iterator) -> Iterator:
        for out in work(batches):
            yield out
        release()

    return each


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more offset than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers of an id column; null counts as the smallest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.int64())
    return np.asarray(pc.fill_null(column, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), dtype=np.int64)


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(30))) * _C1
    x = (x ^ (x >> U64(27))) * _C2
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for two names in this order."""
    return mix(a * _BASE + (b ^ (b >> U64(32))) * _C2)


_POWERS: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INV_BASE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _cuts(word: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that end behind a byte of no word."""
    i, n = 0, len(word)
    while i < n:
        j = min(n, i + limit)
        while j < n and word[j - 1]:
            gap = np.flatnonzero(~word[j : j + limit])
            j = j + int(gap[0]) + 1 if len(gap) else min(n, j + limit)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = rule[data]
    joined = np.empty(n + 1, bool)  # byte i belongs to the word that byte i - 1 belongs to
    joined[0] = joined[n] = False
    np.logical_and(word[1:], word[:-1], out=joined[1:n])
    joined[offsets] = False
    starts = np.flatnonzero(word & ~joined[:n])
    ends = np.flatnonzero(word & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit name of every word, without regard to the case of A-Z, or by the values given for bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    parts = []
    for i, j in _cuts(rule[data]) if len(data) > CHUNK else [(0, len(data))]:
        up, down = _powers(j - i + 1)
        total = np.empty(j - i + 1, U64)
        total[0] = 0
        np.cumsum(values[data[i:j]] * up[: j - i], dtype=U64, out=total[1:])
        a, b = (np.searchsorted(starts, (i, j)) if len(data) > CHUNK else (0, len(starts)))
        s, e = starts[a:b] - i, ends[a:b] - i
        parts.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * _C1))
    return np.concatenate(parts)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Name of the ``k`` words from each word on; shorter than ``words`` by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for i in range(1, k):
        out = pair(out, words[i : n + i])
    return out


def text_hash(words: np.ndarray, k: int) -> U64:
    """Name of a whole sequence of fewer than ``k`` words; never that of a gram."""
    out = np.array([len(words)], U64)
    for w in words:
        out = pair(out, np.array([w], U64))
    return mix(out ^ U64(k))[0]


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """Index of the text that each of ``n`` words belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x[:n]
