"""MinHash near-duplicates by a multi-index Hamming join.

A text becomes its set of word shingles, the set a signature of 64 symbols of 16 bits
(b-bit MinHash).  Two sets of similarity J differ in about (1 - J) of the symbols.  All
pairs within ``radius`` symbols are found by the pigeonhole: of ``chunks`` chunks one at
least holds no more than ``radius // chunks`` errors, so every chunk is indexed with
each allowed choice of wrong symbols left out.  Links are then confirmed on full sets.

Equal sets are one class from the start.  In a group of classes that share a key no
pairs are put out at first: every class is compared with the one nearest to the
group's majority signature, and components are formed.  Only classes that still lie
in different components are compared with one another after that, in blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import packed
from lotwise.llm.columns import SPACED, U64, grams, lean, lean_batches, lean_pair, longs, mix, runs, text_hash, utf8, word_hashes, word_spans
from lotwise.llm.components import components
from lotwise.operators.durable import store

SYMBOLS, CHUNKS = 64, 16
#: At similarity 0.75 the distance is 16 on average, with a deviation of 3.5.
RADIUS = 31
#: Classes of a group, and of a component, that are handled together.
BLOCK = 1024
#: Shingles hashed at once.
_STEP = 1 << 16

_FACTORS = np.random.default_rng(20240607).integers(1, 2**63, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of every text, one after another, and where each text's begin.

    Shingles are ``words`` successive words; a text with fewer words is one shingle, a text
    without words none.
    """
    data, offsets = utf8(texts)
    parts, counts = [], []
    for i, j in runs(offsets):
        chunk, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(chunk, at, SPACED)
        hashes = word_hashes(chunk, starts, ends, SPACED)
        names = grams(hashes, words)
        size = np.diff(first)
        whole = np.repeat(np.arange(len(size)), np.maximum(size - words + 1, 0))
        names = names[np.arange(len(whole)) + np.repeat(first[:-1] - np.r_[0, np.cumsum(np.maximum(size - words + 1, 0))[:-1]], np.maximum(size - words + 1, 0))] if len(whole) else names[:0]
        for k in np.flatnonzero((size > 0) & (size < words)):
            names = np.append(names, text_hash(hashes[first[k] : first[k + 1]], words))
            whole = np.append(whole, k)
        order = np.lexsort((names, whole))
        names, whole = names[order], whole[order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (whole[1:] != whole[:-1])
        parts.append(names[new])
        counts.append(np.bincount(whole[new], minlength=j - i))
    names = np.concatenate(parts) if parts else np.zeros(0, U64)
    return names, np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)


def signatures(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of ``SYMBOLS`` 16-bit symbols; an empty set has a row of zeros."""
    out = np.full((len(first) - 1, SYMBOLS), np.iinfo(U64).max, U64)
    filled = np.diff(first) > 0
    a = 0
    while a < len(first) - 1:  # some sets at a time; a large set in steps
        b = max(a + 1, int(np.searchsorted(first, first[a] + _STEP, "right")) - 1)
        rows = np.flatnonzero(filled[a:b]) + a
        for s in range(int(first[a]), int(first[b]), _STEP) if b == a + 1 else [int(first[a])]:
            x = names[s : min(s + _STEP, int(first[b]))] if b == a + 1 else names[s : int(first[b])]
            edges = first[rows] - s if b > a + 1 else np.zeros(len(rows), np.int64)
            if len(rows):
                for k, factor in enumerate(_FACTORS):
                    y = x * factor
                    least = np.minimum.reduceat(y ^ (y >> U64(29)), edges)
                    out[rows, k] = np.minimum(out[rows, k], least)
        a = b
    out[~filled] = 0
    return (mix(out) >> U64(48)).astype("<u2")


def _variants(symbols: int, chunks: int, errors: int) -> list[tuple[int, ...]]:
    """Symbols that each key is made of: a chunk without every choice of ``errors`` of its symbols."""
    edges = np.linspace(0, symbols, chunks + 1).astype(int).tolist()
    return [tuple(sorted(set(range(a, b)) - set(gone))) for a, b in zip(edges, edges[1:]) for gone in combinations(range(a, b), min(errors, b - a - 1))]


VARIANTS = _variants(SYMBOLS, CHUNKS, RADIUS // CHUNKS)


def keys(signature: np.ndarray, variant: int) -> np.ndarray:
    out = np.full(len(signature), variant + 1, U64)
    for k in VARIANTS[variant]:
        out = mix(out ^ signature[:, k].astype(U64)) + U64(variant)
    return out


def _signature_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), "<u2").reshape(-1, SYMBOLS)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: id, size of its set, two names of the set, and its signature."""

    def work(batches):
        for batch in batches:
            names, first = shingle_sets(batch.column(1), words)
            spread = [np.r_[U64(0), np.cumsum(mix(names + U64(s)), dtype=U64)] for s in (1, 0x51ED270B)]
            node, other = ((x[first[1:]] - x[first[:-1]]).astype(np.int64) for x in spread)
            rows = signatures(names, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(node), pa.array(other), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["id", "n", "node", "other", "signature"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean_batches(work), "id long, n long, node long, other long, signature binary"
    )


def groups(classes: DataFrame) -> DataFrame:
    """Classes that share a key: ``gid``, the first such ``key``, the group's size and each ``node``.

    Groups of the same classes under several keys are one group.
    """
    n, widths = packed.buckets(classes), (8, 8, 2)

    def indexed(batches):
        for batch in batches:
            node, rows = longs(batch.column(0)), _signature_rows(batch.column(1))
            if not len(node):
                continue
            name = np.concatenate([keys(rows, v) for v in range(len(VARIANTS))])
            variant = np.repeat(np.arange(len(VARIANTS)), len(node))
            ids, blocks = packed.split((name % U64(n)).astype(np.int32), [name, np.tile(node, len(VARIANTS)), variant], widths)
            yield from packed.batch(ids, blocks).to_batches()

    def shared(table: pa.Table) -> pa.Table:
        (name, node, variant), _ = packed.unpack(table["block"].to_pylist(), widths)
        order = np.lexsort((node, name))
        name, node, variant = name[order], node[order], variant[order]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[first, len(name)])
        many = size > 1
        total = np.add.reduceat(mix(node), first) if len(first) else np.zeros(0, U64)
        gid = mix(total[many] + size[many].astype(U64)).astype(np.int64)
        order = np.lexsort((variant[first[many]], gid))  # of one group's keys the first variant's
        once = order[np.r_[True, gid[order][1:] != gid[order][:-1]]] if len(gid) else order
        first, size, gid = first[many][once], size[many][once], gid[once]
        return pa.table(
            {
                "gid": pa.array(gid),
                "key": pa.array(variant[first].astype(np.int32)),
                "size": pa.array(size),
                "nodes": pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(size)], pa.int32()),
                    pa.array(node[np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)].astype(np.int64)) if len(first) else pa.array([], pa.int64()),
                ),
            }
        )

    found = (
        packed.dealt(classes.select("node", "signature").mapInArrow(lean_batches(indexed), packed.SCHEMA), n)
        .groupBy("bucket")
        .applyInArrow(lean(shared), "gid long, key int, size long, nodes array<long>")
    )
    once = found.groupBy("gid").agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("nodes").alias("nodes"))
    return once.select("gid", "key", "size", F.explode("nodes").alias("node"))


def _stars(members: DataFrame) -> DataFrame:
    """In every slice of a group, the class nearest to the majority signature and those within the radius of it."""

    def work(table: pa.Table) -> pa.Table:
        node, rows = longs(table["node"]), _signature_rows(table["signature"])
        order = np.argsort(node, kind="stable")
        node, rows = node[order], rows[order]
        agree = np.zeros(len(node), np.int64)
        for k in range(SYMBOLS):
            values, where, count = np.unique(rows[:, k], return_inverse=True, return_counts=True)
            agree += where == np.argmax(count)
        center = int(np.argmax(agree))
        near = (rows != rows[center]).sum(1) <= RADIUS
        near[center] = False
        return pa.table({"y": pa.array(np.full(near.sum(), node[center])), "x": pa.array(node[near])})

    sliced = members.withColumn("slice", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    return sliced.select("gid", "slice", "node", "signature").groupBy("gid", "slice").applyInArrow(work, "y long, x long").distinct()


def _across(members: DataFrame) -> DataFrame:
    """Pairs within the radius that share a group and lie in different components: ``y``'s block, ``x``, and its ``ys``."""

    def work(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"].combine_chunks())
        node, label, vblock = (longs(table[c]) for c in ("node", "label", "vblock"))
        rest, key, rows = np.asarray(table["rest"].combine_chunks().cast(pa.int8())), table["key"][0].as_py(), _signature_rows(table["signature"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        away = np.zeros((len(left), len(right)), np.uint8)
        for k in range(SYMBOLS):
            away += rows[left, k][:, None] != rows[right, k][None, :]
        fits = (away <= RADIUS) & (label[left][:, None] != label[right][None, :])
        fits &= ~((rest[right] == 1)[None, :] & (node[right][None, :] <= node[left][:, None]))  # of two that are left over, once
        a, b = np.nonzero(fits)
        mine = np.ones(len(a), bool)  # a pair belongs to the first key it shares
        same = rows[left[a]] == rows[right[b]]
        for v in range(key):
            mine &= ~same[:, list(VARIANTS[v])].all(1)
        a, b = a[mine], b[mine]
        order = np.lexsort((node[left[a]], vblock[right[b]]))
        x, y, at = node[left[a]][order], node[right[b]][order], vblock[right[b]][order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (at[1:] != at[:-1])]) if len(x) else np.zeros(0, np.int64)
        return pa.table({"vblock": pa.array(at[first]), "x": pa.array(x[first]), "ys": pa.array([p.tobytes() for p in np.split(y, first[1:])] if len(first) else [], pa.binary())})

    largest = Window.partitionBy("gid").orderBy(F.desc("n"), "label")
    main = members.groupBy("gid", "label").agg(F.count("*").alias("n"))
    main = main.withColumn("kinds", F.count("*").over(Window.partitionBy("gid"))).withColumn("at", F.row_number().over(largest))
    main = main.filter("kinds > 1 and at = 1").select("gid", F.col("label").alias("top"), (F.col("n")).alias("n_top"))
    rows = members.join(main, "gid").withColumn("rest", F.col("label") != F.col("top"))
    lefts = F.ceil((F.col("size") - F.col("n_top")) / BLOCK)
    rights = F.ceil(F.col("size") / BLOCK)
    own = F.xxhash64("node")
    left = rows.filter("rest").select("*", F.lit(0).alias("side"), F.pmod(own, lefts).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), rights - 1)).alias("j"))
    right = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), lefts - 1)).alias("i"), F.pmod(own, rights).alias("j"))
    both = left.unionByName(right).select("gid", "i", "j", "side", "node", "label", "vblock", "rest", "key", "signature")
    return both.groupBy("gid", "i", "j").applyInArrow(lean(work), "vblock long, x long, ys binary")


def _confirmed(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, one of ys) whose full sets are similar enough.

    The sets of a block's ``ys`` and of the ``x`` asked of it meet in one task.
    """

    def wanted(batches):
        for batch in batches:
            block, x = longs(batch.column(0)), longs(batch.column(1))
            ys = [np.frombuffer(b, "<i8") for b in batch.column(2).to_pylist()]
            sizes = np.array([len(y) for y in ys], np.int64)
            node = np.concatenate([x, *ys]) if len(x) else x
            at = np.r_[block, np.repeat(block, sizes)]
            both = np.unique(np.stack([at, node], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["vblock", "node"])

    def work(pairs: pa.Table, held: pa.Table) -> pa.Table:
        node, blobs = longs(held["node"]), held["hashes"].to_pylist()
        row = {k: i for i, k in enumerate(node.tolist())}  # any of equal sets
        sizes = np.array([len(b) // 8 for b in blobs], np.int64)
        _, dense = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)
        first = np.r_[0, np.cumsum(sizes)]
        flag, out = np.zeros(int(dense.max(initial=0)) + 1, bool), []
        by_x: dict[int, list[bytes]] = {}
        for x, ys in zip(longs(pairs["x"]).tolist(), pairs["ys"].to_pylist()):
            by_x.setdefault(x, []).append(ys)
        for x, parts in by_x.items():
            ys = np.unique(np.frombuffer(b"".join(parts), "<i8"))
            i, js = row[x], np.array([row[y] for y in ys.tolist()])
            flag[dense[first[i] : first[i + 1]]] = True
            common = np.array([np.count_nonzero(flag[dense[first[j] : first[j + 1]]]) for j in js])
            flag[dense[first[i] : first[i + 1]]] = False
            good = 100 * common >= percent * (sizes[i] + sizes[js] - common)
            out += [(x, y) for y in ys[good].tolist()]
        return pa.table({"x": pa.array([p[0] for p in out], pa.int64()), "y": pa.array([p[1] for p in out], pa.int64())})

    need = asked.mapInArrow(wanted, "vblock long, node long").distinct()
    held = need.join(sets, "node").select("vblock", "node", "hashes")
    return asked.groupBy("vblock").cogroup(held.groupBy("vblock")).applyInArrow(lean_pair(work), "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 75) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    A text without words (or null) has no shingles and is linked with nothing.  Rows that
    repeat an id are judged each by its own text.  The component's id is the smallest id
    in it; a null id counts as larger than any other, and a component of null ids only
    keeps its rows.  Columns beyond the two named are ignored; an empty table gives none.
    """
    rows = store(signed(docs, id_col, text_col, words))
    classes = rows.filter("n > 0").groupBy("node", "other", "n").agg(F.first("signature").alias("signature"), F.min("id").alias("id"))
    classes = store(classes)
    members = store(groups(classes).join(classes.select("node", "signature"), "node"))

    stars = store(_stars(members))
    # The sets of all classes that share a key: their texts are read once more.
    grouped = members.select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = classes.join(grouped, "node").select("id", "node", F.col("other").alias("o"))

    def named(batches):
        for batch in batches:
            names, first = shingle_sets(batch.column(1), words)
            total = np.r_[U64(0), np.cumsum(mix(names + U64(1)), dtype=U64)]
            fits = (total[first[1:]] - total[first[:-1]]).astype(np.int64) == longs(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fits)), pa.array([names[first[k] : first[k + 1]].tobytes() for k in np.flatnonzero(fits)], pa.binary())],
                ["node", "hashes"],
            )

    sets = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"])).select("node", "text").mapInArrow(lean_batches(named), "node long, hashes binary")
    sets = store(sets)  # a text that comes twice under one id is there twice, which does no harm

    first = store(_confirmed(_as_asked(stars), sets, percent))
    labels = components(first, "x", "y")
    labels = store(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n_label"))
    placed = members.join(labels.join(sizes, "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = placed.withColumn("vblock", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("n_label", F.lit(1)) / BLOCK))))
    second = _confirmed(store(_across(placed)), sets, percent)
    final = components(first.unionByName(second), "x", "y")

    named_classes = classes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named_classes.groupBy("label").agg(F.min("id").alias("component_id"))
    result = named_classes.join(least, "label").select("node", "component_id")
    joined = rows.join(result, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )


def _as_asked(stars: DataFrame) -> DataFrame:
    """Star pairs in the form of :func:`_across`: the block is the centre's own."""

    def work(batches):
        for batch in batches:
            y = longs(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in y], pa.binary())], ["vblock", "x", "ys"])

    return stars.select("y", "x").mapInArrow(work, "vblock long, x long, ys binary")
