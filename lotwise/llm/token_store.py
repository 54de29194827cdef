"""Token ids of documents in ascending id order, with Elias-Fano document boundaries.

A shard is one row of a Parquet table: the ids of its documents one after another, the
documents' ends as an Elias-Fano code, and the documents' own ids as another.  A code keeps the
low bits of each number as they are and the high bits in unary; where every 256th document
lies in the unary bits is sampled, so one document's offset is found without decoding
the others, in about two bits and log2(ids / documents) bits a document.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import prefix, tokens
from lotwise.llm.columns import lean_batches, longs, runs, utf8
from lotwise.operators.durable import store

#: Ids of a shard, but for a longer document.
SHARD_IDS = 1 << 20
SAMPLE = 256


class EliasFano:
    """Non-decreasing whole numbers below 2**63."""

    HEAD = struct.Struct("<QBQ")

    def __init__(self, data: bytes):
        self.n, self.low_bits, high_bytes = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self.high = np.frombuffer(data, np.uint8, high_bytes, at)
        at += high_bytes
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u8", samples, at)
        at += 8 * samples
        self.low = np.frombuffer(data, np.uint8, -(-self.n * self.low_bits // 8), at)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        x = np.asarray(values, np.uint64)
        n = len(x)
        low_bits = max(0, int(int(x[-1]) // n).bit_length() - 1) if n else 0
        at = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        low = ((x[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed_high = np.packbits(high, bitorder="little")
        return b"".join(
            [cls.HEAD.pack(n, low_bits, len(packed_high)), packed_high.tobytes(), at[::SAMPLE].astype("<u8").tobytes(), np.packbits(low.reshape(-1), bitorder="little").tobytes()]
        )

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((at - np.arange(self.n)) << self.low_bits) + (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """Where the i-th set bit of the unary part is: from the sample before it on."""
        left, bit = i % SAMPLE, int(self.samples[i // SAMPLE])
        while True:
            window = np.unpackbits(self.high[bit >> 3 : (bit >> 3) + 128], bitorder="little")[bit & 7 :]
            ones = np.flatnonzero(window)
            if left < len(ones):
                return bit + int(ones[left])
            left, bit = left - len(ones), bit + len(window)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.low_bits) + int(self._low(np.array([i]))[0])


SHARDS = "part int, seq long, n_ids long, nulls long, first_id long, last_id long, doc_ids binary, ends binary, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """``id``, and the ids of every text with ``end_id`` behind them, ``width`` bytes each; one that doesn't fit is an error.

    A null text is its end id only.  A special token in a text is its id.  ``tie`` spreads rows that repeat an id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        encoder = tokens.encoder(tokenizer, special=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in runs(offsets):
                some = []
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    ids = np.frombuffer(encoder.ids(text) + end, "<u4")
                    if int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit {width} bytes")
                    some.append(ids.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(some, pa.binary())], ["id", "ids"])

    return rows.mapInArrow(lean_batches(work), "id long, ids binary").withColumn("tie", F.xxhash64("ids"))


def _shard(part: int, seq: int, names: np.ndarray, nulls: int, sizes: np.ndarray, data: bytes) -> pa.RecordBatch:
    """One shard; its documents' ids ascend, so they are an Elias-Fano code too, from the first id on."""
    first, last = (int(names[0]), int(names[-1])) if len(names) else (0, 0)
    away = names.astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)  # modulo 2**64
    row = [part, seq, int(sizes.sum()), nulls, first, last, EliasFano.encode(away), EliasFano.encode(np.cumsum(sizes)), data]
    kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SHARDS.split(", ")])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text where it is read, and writes the shards in ascending order of the id.

    The encoded rows are stored, dealt out by ranges of the id and sorted inside.  A null id
    comes first; rows that repeat an id follow one another in an order of their own.
    """
    stored = store(encoded(docs, tokenizer, end_id, id_col, text_col, width))
    placed = stored.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")

    def work(batches):
        part, seq, nulls, total = TaskContext.get().partitionId(), 0, 0, 0
        names, sizes, kept = [], [], []
        for batch in batches:
            data, offsets = utf8(batch.column("ids"))
            id_column, at, n = batch.column("id"), 0, np.diff(offsets) // width
            while at < len(n):
                # As many documents as fill the shard, or all that are left.
                upto = at + int(np.searchsorted(np.cumsum(n[at:]), shard_ids - total, "left")) + 1
                upto = min(upto, len(n))
                some = id_column.slice(at, upto - at)
                nulls += some.null_count
                names.append(longs(some.drop_null()))
                sizes.append(n[at:upto])
                kept.append(data[offsets[at] : offsets[upto]].tobytes())
                total += int(n[at:upto].sum())
                at = upto
                if total >= shard_ids:
                    yield _shard(part, seq, np.concatenate(names), nulls, np.concatenate(sizes), b"".join(kept))
                    names, sizes, kept, nulls, total, seq = [], [], [], 0, 0, seq + 1
        if total:
            yield _shard(part, seq, np.concatenate(names), nulls, np.concatenate(sizes), b"".join(kept))

    placed.mapInArrow(lean_batches(work), SHARDS).write.option("compression", "zstd").parquet(path)


def read_documents(shards: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from its shard's boundaries and ids.

    Where a document ends is asked of the boundaries' select structure.
    """
    starts = prefix.before(shards.select("part", "seq", "n_ids"), "part", "seq", ["n_ids"]).select("part", "seq", "n_ids_before")

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ends, wide = EliasFano(r["ends"]), np.frombuffer(r["ids"], f"<u{width}").astype("<u4")
                last = np.array([ends[i] for i in range(ends.n)], np.int64)
                first = np.r_[0, last[:-1]].astype(np.int64)
                names = np.array([r["first_id"]], np.int64) + EliasFano(r["doc_ids"]).all()
                doc = pa.concat_arrays([pa.nulls(r["nulls"], pa.int64()), pa.array(names, pa.int64())])
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(first.tolist(), last.tolist())]
                n = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * n, pa.int32()), pa.array([r["seq"]] * n, pa.int64()), doc, pa.array(first), pa.array(last - first), pa.array(sums, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "seq", "nulls", "first_id", "doc_ids", "ends", "ids").mapInArrow(lean_batches(work), "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("inside") + F.col("n_ids_before")).alias("start"), "n_tokens", "ids_crc32")


def find(shards: DataFrame, doc_id: int, width: int = 2) -> DataFrame:
    """``doc_id`` and the token ids of the documents of one id; only shards that may hold it are read.

    Inside a shard the id is searched by halves in the code of the ids, and two look-ups in the
    boundaries say where its tokens are; no other document is decoded.
    """
    near = shards.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names, ends, k = EliasFano(r["doc_ids"]), EliasFano(r["ends"]), 0
                z = names.n
                while k < z:
                    m = (k + z) // 2
                    k, z = (m + 1, z) if names[m] + r["first_id"] < doc_id else (k, m)
                while k < names.n and names[k] + r["first_id"] == doc_id:
                    i = k + r["nulls"]
                    a, b = ends[i - 1] if i else 0, ends[i]
                    found = np.frombuffer(r["ids"], f"<u{width}")[a:b].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["doc_id", "ids"])
                    k += 1

    return near.select("nulls", "first_id", "doc_ids", "ends", "ids").mapInArrow(work, "doc_id long, ids array<long>")


def tokenized(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Writes the shards under ``path`` and reads the documents back.  An empty table gives none."""
    write_shards(docs, path, tokenizer, end_id, id_col, text_col, width)
    return read_documents(docs.sparkSession.read.schema(SHARDS).parquet(path), width)
