"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and carried to the tasks; every row is put into
its leaf.  Leaves grow as the root of the number of rows, so that neither the leaves to
choose from nor the rows of a leaf grow as the table does.  A query walks the tree best
bin first: a priority queue holds the branches seen so far by the distance to their own
centre, the nearest is opened next, and leaves come out in the order in which they are
worth a visit.  How many leaves are visited is calibrated: for a bounded sample of rows the true
neighbours are found by brute force over all rows, and visits widen until enough of them
lie in visited leaves.  Rows of a leaf are handled in slices, so a vector that fills a
third of the table is no single task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.columns import longs
from lotwise.operators.durable import store

BRANCHES = 16
#: Leaves for each root of the number of rows, at least and at most.
LEAVES_A_ROOT, LEAST_LEAVES, MOST_LEAVES = 24, 64, 10_000
#: Sample rows that a leaf is fitted on, about (200,000 rows in all at most), and rows that visits are calibrated with.
FIT_ROWS, CALIBRATION_ROWS = 20, 100
#: Share of the true neighbours that the calibration rows must find.
RECALL = 0.96
#: Rows of a leaf, and queries that visit it, that meet in one group, about; queries of a group compared at once.
SLICE, AT_ONCE = 4096, 256


@dataclass
class Node:
    """A branch has centres and children; a leaf its number."""

    centers: np.ndarray | None = None
    children: list = field(default_factory=list)
    leaf: int = -1


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``; small errors, never below 0."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(len(x))
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centers).argmin(1)
        order, sizes = np.argsort(near, kind="stable"), np.bincount(near, minlength=len(centers))
        held = np.flatnonzero(sizes)
        centers[held] = np.add.reduceat(x[order], np.r_[0, np.cumsum(sizes[held])[:-1]], axis=0) / sizes[held, None]
    return np.unique(centers, axis=0)


def grow(sample: np.ndarray, leaves: int, branches: int = BRANCHES) -> tuple[Node, int]:
    """The tree and its number of leaves; a part is split while it is larger than its share."""
    small, count = max(1, -(-len(sample) // max(1, leaves))), 0

    def node(x: np.ndarray) -> Node:
        nonlocal count
        if len(x) > small:
            centers = _kmeans(x, min(branches, -(-len(x) // small)))
            near = _squares(x, centers).argmin(1)
            if len(centers) > 1 and np.bincount(near, minlength=len(centers)).max() < len(x):
                return Node(centers, [node(x[near == c]) for c in range(len(centers))])
        count += 1
        return Node(leaf=count - 1)

    return node(sample), count


def leaf_of(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.centers is None:
            out[rows] = node.leaf
        elif len(rows):
            near = _squares(x[rows], node.centers).argmin(1)
            todo += [(child, rows[near == c]) for c, child in enumerate(node.children)]
    return out


def leaves_for(total: int) -> int:
    """About how many leaves a tree over so many rows has."""
    return int(min(MOST_LEAVES, max(LEAST_LEAVES, LEAVES_A_ROOT * total**0.5)))


def visits(tree: Node, x: np.ndarray) -> Iterator[int]:
    """The leaves in the order of the best-bin-first walk for one vector."""
    queue, tick = [(0.0, 0, tree)], 1
    while queue:
        _, _, node = heapq.heappop(queue)
        if node.centers is None:
            yield node.leaf
            continue
        for d, child in zip(_squares(x[None], node.centers)[0].tolist(), node.children):
            heapq.heappush(queue, (d, tick, child))
            tick += 1


def _matrix(column: pa.Array) -> np.ndarray:
    """A row per vector; its values were written as little-endian doubles."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``row`` (a number of its own), ``vec_id`` and ``vec``, doubles as bytes, of the vectors that take part.

    Not those that are null, zero, or hold null or non-finite components; nor those whose length
    isn't the commonest (the smaller, if two are as common); nor rows with a null id.
    """
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = named.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = some.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    kept = some.filter(F.size("v") == (sizes[0]["size"] if sizes else 0)).withColumn("row", F.monotonically_increasing_id())

    def work(batches):
        for batch in batches:
            flat = batch.column(1).flatten()
            x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), "<f8").reshape(len(batch), -1) if len(batch) else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "vec_id", "vec"])

    return kept.mapInArrow(work, "row long, vec_id long, vec binary")


def _nearest(names: np.ndarray, ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray, k: int):
    """For every query its (at most) ``k`` nearest rows but itself: query's place, rows, exact distances."""
    if not len(x):
        return
    slack = 1e-9 * (1 + (q * q).sum(1).max(initial=0) + (x * x).sum(1).max(initial=0))
    for r in range(len(q)):
        if r % AT_ONCE == 0:
            rough = _squares(q[r : r + AT_ONCE], x)
        away = np.where(names == asking[r], np.inf, rough[r % AT_ONCE])
        rows = np.arange(len(x))
        if len(x) > k + 1:
            edge = np.partition(away, k)[k]
            rows = np.flatnonzero(away <= edge + slack)
        rows = rows[names[rows] != asking[r]]
        exact = np.sqrt(((x[rows] - q[r]) ** 2).sum(1))
        best = np.lexsort((names[rows], ids[rows], exact))[:k]
        yield r, rows[best], exact[best]


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` nearest of what the slices found; a row has k at most, combined on the map side."""
    best = found.groupBy("asking", "query_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return best.select("asking", "query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "n")).select(
        "asking", "query_id", (F.col("rank") + 1).alias("rank"), "n.vec_id", "n.score", "n.row"
    )


_FOUND = "asking long, query_id long, near array<struct<score: double, vec_id: long, row: long>>"


def _rows(asking: np.ndarray, qid: np.ndarray, names: np.ndarray, ids: np.ndarray, results) -> pa.Table:
    who, of, near = [], [], []
    for r, rows, scores in results:
        who.append(int(asking[r]))
        of.append(int(qid[r]))
        near.append([{"score": s, "vec_id": v, "row": n} for s, v, n in zip(scores.tolist(), ids[rows].tolist(), names[rows].tolist())])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
    return pa.table({"asking": pa.array(who, pa.int64()), "query_id": pa.array(of, pa.int64()), "near": pa.array(near, kind)})


def _sample(vectors: DataFrame, total: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``rows`` rows, chosen by a hash of their number; all, if there are no more."""
    if total > rows:
        vectors = vectors.filter(F.pmod(F.xxhash64("vec_id", "row", F.lit(seed)), F.lit(1 << 32)) < int(rows / total * (1 << 32)))
    table = vectors.toArrow()
    return longs(table["row"]), _matrix(table["vec"])


def brute(vectors: DataFrame, asking: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a few given vectors (by their rows' numbers) among all rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((asking, q))

    def work(batches):
        who, own = shared.value
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = pa.Table.from_batches([batch.slice(a, SLICE)])
                names, ids, x = longs(part["row"]), longs(part["vec_id"]), _matrix(part["vec"])
                yield from _rows(who, who, names, ids, _nearest(names, ids, x, who, own, k)).to_batches()

    return _top(vectors.mapInArrow(work, _FOUND), k)


def _meeting(visiting: DataFrame, inside: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Queries in blocks and rows in slices; every block that visits a leaf meets each slice of it."""
    asked = visiting.select("asking", "query_id", "query", F.explode("leaves").alias("leaf"))
    counts = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf of the tree
    parts = lambda n: F.create_map(*[F.lit(v).cast("long") for leaf, c in (n or {-1: 1}).items() for v in (leaf, -(-c // SLICE))])[F.col("leaf")]
    several = lambda n: {leaf: c for leaf, c in n.items() if c > SLICE}
    slices, blocks = several(sizes), several(counts)
    pieces = lambda n: F.coalesce(parts(n), F.lit(1).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    questions = asked.withColumn("block", F.pmod(F.xxhash64("asking"), pieces(blocks))).withColumn("slice", each(pieces(slices)))
    held = inside.withColumn("slice", F.pmod(F.xxhash64("row"), pieces(slices))).withColumn("block", each(pieces(blocks)))
    return questions, held


@dataclass
class Index:
    """Rows in the leaves of a fitted tree, and how many leaves a query visits."""

    tree: Node
    rows: DataFrame
    sizes: dict[int, int]
    most: int

    def compared(self) -> float:
        """Share of all rows that a query is compared with, about."""
        return min(1.0, self.most / max(1, len(self.sizes)))


def index(vectors: DataFrame, k: int = 10, recall: float = RECALL, leaves: int | None = None) -> Index:
    """A tree fitted on a sample of stored ``vectors`` (of :func:`usable`), all of them in its leaves, visits calibrated."""
    total = vectors.count()
    leaves = leaves or leaves_for(total)
    _, sample = _sample(vectors, total, max(FIT_ROWS * LEAST_LEAVES, FIT_ROWS * leaves), 11)
    tree, n_leaves = grow(sample if len(sample) else np.zeros((1, 1)), leaves)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def placed(batches):
        for batch in batches:
            leaf = leaf_of(shared.value, _matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "row", "vec_id", "vec"])

    inside = store(vectors.select("row", "vec_id", "vec").mapInArrow(placed, "leaf long, row long, vec_id long, vec binary"))
    sizes = {r["leaf"]: r["n"] for r in inside.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf of the tree

    # Calibration: at which visit does the walk reach the leaf of a true neighbour?
    names, own = _sample(vectors, total, CALIBRATION_ROWS, 12)
    if not len(names):
        return Index(tree, inside, sizes, n_leaves)
    truth = store(brute(vectors, names, own, k).select("asking", "row"))
    leaf = {r["row"]: r["leaf"] for r in inside.join(truth.select("row").distinct(), "row").select("row", "leaf").collect()}
    order = {int(i): {x: n for n, x in enumerate(x for x in visits(tree, v) if x in sizes)} for i, v in zip(names, own)}
    reached = sorted(order[r["asking"]][leaf[r["row"]]] for r in truth.collect())
    most = reached[min(len(reached) - 1, int(recall * len(reached)))] + 1 if reached else n_leaves
    return Index(tree, inside, sizes, most)


def neighbours(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, leaves: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and the exact Euclidean ``score``.

    ``queries`` is a condition on ``vec_id``.  Candidates are all rows but the query's own; see
    :func:`usable` for vectors that take no part.  Equal distances go to the smaller id.  Rows
    that repeat an id are candidates and queries of their own.  An empty table gives none.
    """
    vectors = store(usable(rows, id_col, vec_col))
    if vectors.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index(vectors, k, recall, leaves), queries, k)


def search(found: Index, queries: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of those that meet the condition; they go to the slices of the leaves that they visit."""
    shared, sizes, most = found.rows.sparkSession.sparkContext.broadcast(found.tree), found.sizes, found.most

    def asked(batches):
        for batch in batches:
            x = _matrix(batch.column("vec"))
            leaves = []
            for row in range(len(x)):
                held, own = 0, []
                for leaf in visits(shared.value, x[row]):
                    if len(own) >= most and held > k:
                        break
                    if leaf in sizes:  # a leaf without rows is no visit
                        held += sizes[leaf]
                        own.append(leaf)
                leaves.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["asking", "query_id", "query", "leaves"])

    def compare(questions: pa.Table, held: pa.Table) -> pa.Table:
        if not len(questions) or not len(held):
            return _rows(*[np.zeros(0, np.int64)] * 4, [])
        names, ids, x = longs(held["row"]), longs(held["vec_id"]), _matrix(held["vec"])
        asking, qid, q = longs(questions["asking"]), longs(questions["query_id"]), _matrix(questions["query"])
        return _rows(asking, qid, names, ids, _nearest(names, ids, x, asking, q, k))

    own = found.rows.filter(queries).select("row", "vec_id", "vec")
    visiting = store(own.mapInArrow(asked, "asking long, query_id long, query binary, leaves array<long>"))
    questions, held = _meeting(visiting, found.rows, sizes)
    key = ["leaf", "slice", "block"]
    near = questions.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(compare, _FOUND)
    return _top(near, k).select("query_id", "rank", "vec_id", "score")
