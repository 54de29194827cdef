"""Numbers shuffled in packed blocks.

An operator that shuffles a few numbers for every few bytes of text would spend most
of its time on rows.  Here a task sorts its numbers by bucket and hands Spark one row
per bucket: the bucket and a block of columns.  Spark shuffles the blocks, and a group
of blocks is unpacked into numpy arrays on the other side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, block binary"


def buckets(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions; they grow with the data as those do."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(columns: Sequence[np.ndarray], widths: Sequence[int]) -> bytes:
    """Columns of whole numbers, ``widths`` bytes each, stored plane by plane: equal high bytes compress."""
    n = len(columns[0])
    parts = [struct.pack("<I", n)]
    for x, w in zip(columns, widths, strict=True):
        raw = np.ascontiguousarray(x).astype("<u8" if x.dtype.kind == "u" else "<i8", copy=False)
        parts.append(np.ascontiguousarray(raw.view(np.uint8).reshape(n, 8)[:, :w].T).tobytes())
    return b"".join(parts)


def unpack(blocks: Iterable[bytes], widths: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all blocks as unsigned numbers, and the block that each row came from."""
    blocks = list(blocks)
    sizes = [struct.unpack_from("<I", b)[0] for b in blocks]
    total, out = sum(sizes), []
    at = [4] * len(blocks)
    for w in widths:
        raw = np.zeros((total, 8), np.uint8)
        row = 0
        for k, (b, n) in enumerate(zip(blocks, sizes, strict=True)):
            raw[row : row + n, :w] = np.frombuffer(b, np.uint8, w * n, at[k]).reshape(w, n).T
            at[k] += w * n
            row += n
        out.append(raw.reshape(-1).view("<u8"))
    return out, np.repeat(np.arange(len(blocks)), sizes)


def split(bucket: np.ndarray, columns: Sequence[np.ndarray], widths: Sequence[int], keep_order: bool = True) -> tuple[list[int], list[bytes]]:
    """One block for each bucket that has rows."""
    if not len(bucket):
        return [], []
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    rows = [order[a:b] for a, b in zip(edges, edges[1:])]
    return ids.tolist(), [pack([c[r] for c in columns], widths) for r in rows]


def batch(ids: Sequence[int], blocks: Sequence[bytes], **more: pa.Array) -> pa.Table:
    return pa.table({"bucket": pa.array(ids, pa.int32()), "block": pa.array(blocks, pa.binary()), **more})


def dealt(df: DataFrame, n: int, by: str = "bucket") -> DataFrame:
    """The rows of a bucket brought together."""
    return df.repartition(n, by)
