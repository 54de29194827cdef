"""One row per key.

Winners are picked with ``max_by``/``min_by`` over the whole row.  Both combine on
the map side, so a key that holds a third of the rows reaches its reducer as one
row per map task and no group is collected.  A winner that is a whole row has no hash
buffer: Spark plans a sorted aggregate, which sorts each task's rows by key and spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.functions import urls as U
from lotwise.site import DEFAULT_SITE, Marketplace


def _row(df: DataFrame) -> Column:
    return F.struct(*[T.field(c) for c in df.columns])


def keep_best(df: DataFrame, keys: Sequence[str | Column], rank: Column, *extra: Column) -> DataFrame:
    """The row with the highest rank of every key, plus aggregates over the key."""
    picked = df.groupBy(*keys).agg(F.max_by(_row(df), rank).alias("__row"), *extra)
    names = [c for c in picked.columns if c != "__row" and c not in df.columns]
    return picked.select("__row.*", *names)


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return keep_best(df, keys, F.col(order))


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.min_by(_row(df), order).alias("__row"))
    return picked.select("__row.*")


def distinct_in_order(values: Column) -> Column:
    """Filled values of an array, each once, in first-seen order."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def prepare_dealers(
    dealers: DataFrame, order: str, cap: int = 0, site: Marketplace = DEFAULT_SITE
) -> DataFrame:
    """Dealers by canonical URL, last entry wins, in lower-case URL order."""
    rows = dealers.withColumn("url", U.dealer_url("url", site)).filter(F.col("url") != "")
    unique = keep_last(rows, ["url"], order).orderBy(F.lower("url"), "url")
    return unique.limit(cap) if cap > 0 else unique


def _with_url_and_score(df: DataFrame, link: str, scored: Sequence[str], site: Marketplace) -> DataFrame:
    rows = df.withColumn(link, U.dealer_url(T.field(link), site)).filter(T.field(link) != "")
    return rows.withColumn("__score", T.record_score(scored))


def fullest_vendors(
    vendors: DataFrame, order: str, site: Marketplace = DEFAULT_SITE, link: str | None = None
) -> DataFrame:
    """The fullest record of every vendor URL, the first on ties."""
    link = link or site.link_field
    scored = [c for c in vendors.columns if c != order]
    rows = _with_url_and_score(vendors, link, scored, site)
    return keep_best(rows, [T.field(link)], F.struct(F.col("__score"), -F.col(order))).drop("__score")


def merge_vendor_snapshots(
    existing: DataFrame,
    current: DataFrame,
    order: str,
    site: Marketplace = DEFAULT_SITE,
    link: str | None = None,
) -> DataFrame:
    """Earlier and current vendors in one table: the fullest, the last on ties."""
    link = link or site.link_field
    both = existing.withColumn("__late", F.lit(0)).unionByName(
        current.withColumn("__late", F.lit(1)), allowMissingColumns=True
    )
    scored = [c for c in both.columns if c not in (order, "__late")]
    rows = _with_url_and_score(both, link, scored, site)
    rank = F.struct(F.col("__score"), F.col("__late"), F.col(order))
    return keep_best(rows, [T.field(link)], rank).drop("__score", "__late")


def upsert_rows(
    existing: DataFrame, current: DataFrame, key: str, order: str, position: str = "position"
) -> DataFrame:
    """Current rows replace existing rows of their key and take their place.

    Rows without a key are kept as they are.  Of an existing key that occurs more
    than once only the last occurrence is replaced.  ``order`` holds unique places
    in both inputs; the result carries ``position`` to sort by: existing places
    first, then places of new rows.
    """
    cols = [c for c in existing.columns if c != order]
    old = existing.withColumn("__late", F.lit(0))
    new = current.select(existing.columns).withColumn("__late", F.lit(1))
    place = F.struct(F.col("__late").alias("late"), F.col(order).alias("ord"))
    both = old.unionByName(new).withColumn("__place", place)
    filled = T.is_filled(T.field(key))
    keyless = both.filter(~filled).select(*[T.field(c) for c in cols], F.col("__place").alias(position))
    keyed = both.filter(filled)
    is_old = F.col("__late") == 0
    winners = keyed.groupBy(T.field(key)).agg(
        F.max_by(F.struct(*[T.field(c) for c in cols]), F.col("__place")).alias("__row"),
        F.coalesce(
            F.max(F.when(is_old, F.col("__place"))), F.min(F.col("__place"))
        ).alias(position),
    )
    won = winners.select("__row.*", position)
    # Earlier duplicates inside the existing table stay.
    last_old = winners.select(T.field(key).alias("__k"), F.col(position).alias("__p"))
    old_rows = keyed.filter(is_old)
    stale = (
        old_rows.join(last_old, T.field(key) == F.col("__k"))
        .filter(F.col("__place") < F.col("__p"))
        .select(*[T.field(c) for c in cols], F.col("__place").alias(position))
    )
    return won.unionByName(stale).unionByName(keyless)


def first_seen_page(entries: DataFrame, run: str, page: str, key: str) -> DataFrame:
    """First page of every key in a directory crawl."""
    return (
        entries.filter(T.is_filled(F.col(key)))
        .groupBy(run, key)
        .agg(F.min(page).alias("first_page"), F.count("*").alias("seen"))
    )


# -- shard merge -------------------------------------------------------------

# Key fields of merged records, tried in this order.
VENDOR_KEY_FIELDS = ["haendler_id", "vendor_id", "Händler ID"]
URL_KEY_FIELDS = ["url", "link", "vehicle_url", "Link", "Vehicle_URL", "source_vehicle_url"]
ID_KEY_FIELDS = ["vehicle_id", "Fahrzeug_ID", "id"]


def _first_of(record: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(record[n], F.lit("")) for n in names])


def vendor_key(record: Column, per_file: Column) -> Column:
    """Vendor key of a record map; one-record files know only the first name."""
    return F.when(per_file, F.nullif(record[VENDOR_KEY_FIELDS[0]], F.lit(""))).otherwise(
        _first_of(record, VENDOR_KEY_FIELDS)
    )


def vehicle_key(record: Column) -> Column:
    return F.coalesce(
        _first_of(record, URL_KEY_FIELDS),
        F.concat(F.lit("id:"), _first_of(record, ID_KEY_FIELDS)),
    )


def merge_shards(records: DataFrame, key: Column, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First record of every key over all shards, and the records without a key.

    ``order`` names the columns that say which record came first: run, layout,
    file, place in the file.
    """
    keyed = records.withColumn("__key", key)
    merged = keep_first(
        keyed.filter(F.col("__key").isNotNull()), ["__key"], F.struct(*order)
    ).withColumnRenamed("__key", "merge_key")
    skipped = keyed.filter(F.col("__key").isNull()).drop("__key")
    return merged, skipped
