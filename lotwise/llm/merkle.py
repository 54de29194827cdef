"""Merkle manifest of a data set: every row's leaf, its proof, and one root over all groups.

The rows of a group are ranked, and a rank is written as a block number and two digits.
Inside a block the digits are grouped away one after the other: the rows of one last
digit become the children of a node, the nodes of the next digit the children of the
block.  A node keeps the hashes of the binary levels between its children and itself.
The blocks are the next round's rows, so that no node ever holds more than 32 children
nor a block more than 1024 rows, however large a group is.  On the way back a transform
puts each child's siblings behind it and an explode hands the children out.

Defined cases: a null group is a group of its own and comes first; rows without an id
come before the others; rows of one id go by their leaf, equal rows in any order; a
table without rows has no manifest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import store

#: Binary levels that one digit of a rank stands for, and those of a block (two digits).
BITS = 5
BLOCK_BITS = 2 * BITS
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``rank`` (from 0) within their ``tree``, in the given order, and the tree's size ``n``.

    The rows are sorted by range and stored with their place; one row per partition and
    tree is summed up, so neither a large tree nor a common id is one task's work.
    """
    salted = rows.withColumn("__spread", F.monotonically_increasing_id())  # equal rows may part
    placed = store(salted.orderBy("tree", *order, "__spread").drop("__spread").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("size"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "part", "first", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(tree).alias("n"))
    left, right = placed.withColumn("part", part).alias("l"), offsets.alias("r")
    joined = left.join(right, (F.col("l.part") == F.col("r.part")) & F.col("l.tree").eqNullSafe(F.col("r.tree")))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("place") - F.col("first") + F.col("before")).alias("rank"), "n")


def _joined(hashes: Column) -> Callable[[Column], Column]:
    """The hash of each two neighbours, or of a last one alone, by number of the result."""
    return lambda i: digest(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit("")))


def _node(children: DataFrame, by: Sequence[str], digit: str, base: int) -> DataFrame:
    """Children that agree in ``by`` as one node: hash, the hashes of its ``BITS`` levels, the children.

    A level is hashed in pairs only while more than one node of the whole tree is left.
    """
    grouped = children.groupBy("tree", "n", *by).agg(F.array_sort(F.collect_list(F.struct(digit, "hash", "load"))).alias("kids"))
    grouped = grouped.withColumn("h0", F.col("kids.hash"))
    for j in range(BITS):
        here = F.col(f"h{j}")
        up = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(here) - 1, 1)), _joined(here))
        grouped = grouped.withColumn(f"h{j + 1}", F.when(F.col("n") > (1 << (base + j)), up).otherwise(here))
    levels = F.array(*[F.col(f"h{j}") for j in range(BITS)])
    return grouped.select("tree", "n", *by, F.get(f"h{BITS}", F.lit(0)).alias("hash"), F.struct(levels.alias("levels"), F.col("kids.load").alias("kids")).alias("load"))


def _steps(levels: Column, place: Column, n: Column, base: int) -> Column:
    """Siblings of the child at ``place``, level by level: what stands left and right of it."""
    steps = []
    for j in range(BITS):
        here, at = F.get(levels, F.lit(j)), F.shiftright(place, j)
        odd = (at % 2) == 1
        left = F.when(odd, F.get(here, at - 1)).otherwise(F.lit(""))
        right = F.when(odd, F.lit("")).otherwise(F.coalesce(F.get(here, at + 1), F.lit("")))
        steps.append(F.when(n > (1 << (base + j)), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def _round(rows: DataFrame, base: int) -> DataFrame:
    """Blocks of 1024 ranks as nested structs.  They are brought together once, then grouped in place."""
    rank = F.col("rank")
    digits = rows.select(
        "tree", "n", "hash", "load", F.shiftright(rank, BLOCK_BITS).alias("block"), F.shiftright(rank, BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("d1"), rank.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("d0")
    ).repartition("tree", "block")
    inner = _node(digits, ["block", "d1"], "d0", base)
    return _node(inner, ["block"], "d1", base + BITS)


def grow(rows: DataFrame) -> list[DataFrame]:
    """Stored blocks, round by round, of rows with ``tree``, ``rank``, ``n``, ``hash`` and ``load``.

    The last round has one block for each tree, whose hash is the tree's root.
    """
    largest = rows.agg(F.max("n")).first()[0] or 1  # one number; it tells how many rounds there are
    rounds = [store(_round(rows, 0))]
    while largest > 1 << (BLOCK_BITS * len(rounds)):
        below = rounds[-1].select("tree", "n", "hash", F.col("block").alias("rank"), F.struct("block").alias("load"))
        rounds.append(store(_round(below, BLOCK_BITS * len(rounds))))
    return rounds


def proofs(rounds: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the first round with ``load``, ``hash``, ``path`` and what ``above`` says of their tree.

    ``above`` has ``tree``, ``block`` (0), ``path`` from the tree's root on, and ``more``.  A
    block and what is above it meet by grouping; every group is two rows.
    """
    for level in reversed(range(len(rounds))):
        base, blocks = BLOCK_BITS * level, rounds[level]
        both = blocks.select("tree", "block", "n", "load", F.lit(None).cast(dict(above.dtypes)["above"]).alias("above")).unionByName(above, allowMissingColumns=True)
        met = both.groupBy("tree", "block").agg(F.max("n").alias("n"), F.first("load", True).alias("load"), F.first("above", True).alias("above"))

        def handed(levels: str, kids: str, base: int = base) -> Column:
            child = lambda kid, i: F.struct(
                kid.alias("load"), F.get(F.get(F.col(levels), F.lit(0)), i).alias("hash"), _steps(F.col(levels), i, F.col("n"), base).alias("steps")
            )
            return F.transform(F.col(kids), child)

        outer = met.select("tree", "n", "above", F.explode(handed("load.levels", "load.kids", base + BITS)).alias("o"))
        inner = outer.select("tree", "n", "above", "o.steps", F.explode(handed("o.load.levels", "o.load.kids")).alias("i"))
        path = F.concat("i.steps", "steps", "above.path")
        if level:
            above = inner.select("tree", F.col("i.load.block").alias("block"), F.struct(path.alias("path"), F.col("above.more").alias("more")).alias("above"))
        else:
            return inner.select("tree", "i.load", "i.hash", path.alias("path"), "above.more")
    raise ValueError("a manifest has at least one round")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda done, step: digest(step["left"], done, step["right"]))


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, tampered: Sequence[Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row: ``order``, leaf, subroot of its ``group``, root, path, proof digest, and the check of the proof.

    ``fields`` go into the leaf in this order.  Where ``where`` holds, the check folds the leaf
    of ``tampered`` instead, with the untampered siblings.  Of ``docs`` only these columns are read.
    """
    own = leaf([F.col(f"`{f}`") for f in fields])
    other = F.when(F.coalesce(where, F.lit(False)), leaf(tampered)) if tampered is not None and where is not None else F.lit(None).cast("string")
    leaves = store(docs.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{order}`").alias("id"), own.alias("hash"), other.alias("other")))
    rows = ranked(leaves, ["id", "hash"]).withColumn("load", F.struct("id", "other"))
    rounds = grow(rows)
    subroots = rounds[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "hash")
    tops = grow(ranked(subroots, ["name"]).withColumn("load", F.struct("name")))
    root = tops[-1].select("tree", "block", F.struct(F.array().cast(f"array<{STEP}>").alias("path"), F.col("hash").alias("more")).alias("above"))
    named = proofs(tops, root).select(
        F.col("load.name").alias("tree"), F.lit(0).cast("bigint").alias("block"), F.struct("path", F.struct(F.col("hash").alias("subroot"), F.col("more").alias("root")).alias("more")).alias("above")
    )
    found = proofs(rounds, named).select(F.col("load.id").alias(order), F.col("hash").alias("leaf"), "load.other", "more.subroot", "more.root", "path")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    checked = found.select(order, "leaf", "subroot", "root", "path", proof.alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
