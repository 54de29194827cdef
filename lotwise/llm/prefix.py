"""Running totals over blocks: totals per stretch of blocks, then over the stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a stretch; the totals of all stretches are summed up in one task.
STRETCH = 4096


def before(blocks: DataFrame, part: str, order: str, sums: Sequence[str]) -> DataFrame:
    """Each block with ``<sum>_before``: the totals of all blocks before it.

    Blocks are ordered by ``part`` and then ``order``, both whole numbers; a part is
    what one task has written.  One row per part and stretch meets in a single task.
    """
    rows = blocks.withColumn("__stretch", F.floor(F.col(order) / F.lit(STRETCH)))
    totals = rows.groupBy(part, "__stretch").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    upto = Window.orderBy(part, "__stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(part, "__stretch", *[F.coalesce(F.sum(f"__{s}").over(upto), F.lit(0)).alias(f"__{s}") for s in sums])
    inside = Window.partitionBy(part, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(base, [part, "__stretch"])
    return joined.withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"__{s}") for s in sums}).drop("__stretch", *[f"__{s}" for s in sums])


def last_end(blocks: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Each block with ``<value>_before``: the greatest value of all blocks before it, 0 for none."""
    rows = blocks.withColumn("__stretch", F.floor(F.col(order) / F.lit(STRETCH)))
    tops = rows.groupBy(part, "__stretch").agg(F.max(value).alias("__top"))
    upto = Window.orderBy(part, "__stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select(part, "__stretch", F.max("__top").over(upto).alias("__top"))
    inside = Window.partitionBy(part, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("__in", F.max(value).over(inside)).join(base, [part, "__stretch"])
    return joined.select(part, order, F.coalesce(F.greatest("__in", "__top"), F.lit(0)).alias(f"{value}_before"))
