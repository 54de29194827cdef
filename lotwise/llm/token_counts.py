"""Documents of flat token files, found by their separators.

A flat file is nothing but token ids; a document ends with an end-of-document id, and
blocks cut the stream wherever they happen to.  Each block is searched on its own; a
prefix scan over the blocks' totals then tells where its first document began.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import prefix, tokens
from lotwise.operators.durable import store

#: Ids of a block.
BLOCK_IDS = 1 << 20


def flat_blocks(docs: DataFrame, text_col: str, tokenizer: str, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS, id_col: str | None = None) -> DataFrame:
    """The token stream of all texts, in blocks of ``block_ids`` ids of ``width`` bytes.

    ``part`` and ``seq`` order the blocks.  ``closed`` lists the ids of the documents that
    end in a block, to check by; the scan does not read it.  A null text is its end id only.
    """
    named = [F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")]

    def work(batches):
        encoder, part, seq = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{width}").tobytes()
        kept, size, closed = [], 0, []

        def block(data: bytes, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                ["part", "seq", "ids", "closed"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder.ids(text)
                if width != 4:
                    wide = np.frombuffer(data, "<u4")
                    if len(wide) and int(wide.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit {width} bytes")
                    data = wide.astype(f"<u{width}").tobytes()
                kept.append(data + end)
                size += len(data) + width
                while size >= block_ids * width:  # the document may go on in the next block
                    joined = b"".join(kept)
                    cut = block_ids * width
                    if size == cut:
                        closed.append(doc)
                    yield block(joined[:cut], closed)
                    kept, size, seq, closed = [joined[cut:]], size - cut, seq + 1, []
                    if not size:
                        kept = []
                        break
                else:
                    closed.append(doc)
        if size:
            yield block(b"".join(kept), closed)

    rows = docs.select(*[c.alias("id") for c in named], F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "part int, seq long, ids binary, closed array<long>")


def read_flat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw flat token files as blocks, in the order of their paths; files of up to 2 GB.

    An id must not be cut by the end of a file.
    """
    files = spark.read.format("binaryFile").load(paths)
    order = files.select("path").withColumn("name", F.xxhash64("path"))
    from lotwise.operators.ordered import global_rank

    ranked = global_rank(order, ["path"], "seq").select("path", F.col("seq").cast("long").alias("seq"))
    return files.join(ranked, "path").select(F.lit(0).alias("part"), "seq", F.col("content").alias("ids"))


def documents_of(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Each document's number in the stream, where it starts, its ids with the end id, and a checksum of its last piece's place.

    Columns: ``doc_no`` (from 0), ``start``, ``n_tokens``, and ``part``, ``seq``, ``nth``: the
    block its end lies in, and its number among those that end there.  What follows the last
    end id is a document without an end: ``part`` is null for it.  An empty stream has none.
    """

    def scan(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.frombuffer(data, f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)], pa.int64()), pa.array([ends.astype("<i8").tobytes()], pa.binary())],
                    ["part", "seq", "n", "ended", "tail", "ends"],
                )

    found = store(blocks.select("part", "seq", "ids").mapInArrow(scan, "part int, seq long, n long, ended long, tail long, ends binary"))
    # Runs of blocks without an end are one open document: what is open before a block is
    # the distance to the last end, the greatest end so far over all blocks before it.
    placed = prefix.before(found.select("part", "seq", "n", "ended"), "part", "seq", ["n", "ended"])
    opened = prefix.last_end(found.join(placed.select("part", "seq", "n_before"), ["part", "seq"]).select("part", "seq", F.when(F.col("ended") > 0, F.col("n_before") + F.col("n") - F.col("tail")).alias("end_at")), "part", "seq", "end_at")
    rows = found.join(placed.drop("n", "ended"), ["part", "seq"]).join(opened, ["part", "seq"])

    def documents(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for part, seq, base, no, begun, data in zip(*(t[c].to_pylist() for c in ("part", "seq", "n_before", "ended_before", "end_at_before", "ends"))):
                ends = np.frombuffer(data, "<i8") + base + 1
                starts = np.r_[begun, ends[:-1]] if len(ends) else ends
                k = np.arange(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(no + k), pa.array(starts.astype(np.int64)), pa.array(ends - starts), pa.array(np.full(len(ends), part, np.int32)), pa.array(np.full(len(ends), seq)), pa.array(k)],
                    ["doc_no", "start", "n_tokens", "part", "seq", "nth"],
                )

    ended = rows.select("part", "seq", "n_before", "ended_before", "end_at_before", "ends").mapInArrow(
        documents, "doc_no long, start long, n_tokens long, part int, seq long, nth long"
    )
    totals = rows.agg(F.sum("ended").alias("doc_no"), F.coalesce(F.max(F.when(F.col("ended") > 0, F.col("n_before") + F.col("n") - F.col("tail"))), F.lit(0)).alias("start"), F.sum("n").alias("all"))
    none = F.lit(None)
    open_end = totals.filter("all > start").select("doc_no", "start", (F.col("all") - F.col("start")).alias("n_tokens"), none.cast("int").alias("part"), none.cast("long").alias("seq"), none.cast("long").alias("nth"))
    return ended.unionByName(open_end)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens`` of every document, from a flat stream written first and scanned then.

    A null text is its end id only; repeated ids are documents of their own; an empty table gives none.
    """
    blocks = store(flat_blocks(docs, text_col, tokenizer, end_id, width, block_ids, id_col))
    found = documents_of(blocks, end_id, width)
    closed = blocks.select("part", "seq", F.posexplode_outer("closed").alias("nth", "doc_id")).select("part", "seq", F.col("nth").cast("long").alias("nth"), "doc_id")
    return found.join(closed, ["part", "seq", "nth"]).select("doc_id", "doc_no", "start", "n_tokens")


