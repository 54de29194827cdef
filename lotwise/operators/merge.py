"""Joining, filling and folding records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import predicates as P
from lotwise.functions import text as T
from lotwise.functions import urls
from lotwise.site import DEFAULT_SITE, Marketplace

# -- fold of repeated sightings ----------------------------------------------


def fold_sightings(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One record per key from its sightings, in order.

    Each sighting fills what is still empty; one that scores strictly more than the
    record so far overrides it instead.  The score counts fields with text other than
    white space; a field of nothing but white space is filled all the same, and its
    value stays.  The fold looks sequential, but aggregates that combine on the map
    side do most of it:

    * a field that no override holds has its first occurrence, one row per field;
    * the record's score never falls, since an override brings at least its own score,
      and it is no less than that of any earlier sighting.  So only the first sighting
      of each score can override, and at most one candidate per score remains.

    A key therefore shrinks to at most ``len(fields)`` candidates before anything
    is brought together, no matter how many sightings it has; those are folded.
    """
    fields = list(fields)
    places = [f"f{i}" for i in range(len(fields))]
    filled = [F.nullif(T.field(f).cast("string"), F.lit("")) for f in fields]
    counts = [T.clean_text(v) != "" for v in filled]
    held = [F.when(v.isNotNull(), F.struct(v.alias("v"), n.alias("n"))) for v, n in zip(filled, counts)]
    rows = df.select(
        *keys,
        F.col(order).alias("__o"),
        sum((n.cast("int") for n in counts), F.lit(0)).alias("__s"),
        F.struct(*[h.alias(p) for h, p in zip(held, places)]).alias("__v"),
    ).filter(F.coalesce(*[F.col(f"__v.{p}.v") for p in places]).isNotNull())

    def first(place: str) -> Column:
        cell = F.col(f"__v.{place}")
        return F.min(F.when(cell.isNotNull(), F.struct(F.col("__o").alias("o"), cell.alias("x")))).alias(f"__{place}")

    per_score = rows.groupBy(*keys, "__s").agg(
        F.min_by(F.struct(F.col("__o").alias("o"), F.col("__s").alias("s"), F.col("__v").alias("v")), "__o").alias("__c"),
        *[first(p) for p in places],
    )
    per_key = per_score.groupBy(*keys).agg(
        F.array_sort(F.collect_list("__c")).alias("__cands"), *[F.min(f"__{p}").alias(f"__{p}") for p in places]
    )

    def fold(record: Column, sighting: Column) -> Column:
        def scores(place: str) -> Column:
            early = F.when(F.col(f"__{place}.o") < sighting["o"], F.col(f"__{place}.x.n"))
            return F.coalesce(record[place]["n"], early, F.lit(False)).cast("int")

        before = sum((scores(p) for p in places), F.lit(0))
        over = F.struct(*[F.coalesce(sighting["v"][p], record[p]).alias(p) for p in places])
        return F.when(sighting["s"] > before, over).otherwise(record)

    nothing = F.struct(*[F.lit(None).cast("struct<v:string,n:boolean>").alias(p) for p in places])
    folded = per_key.withColumn("__over", F.aggregate("__cands", nothing, fold))
    return folded.select(
        *keys, *[F.coalesce(F.col(f"__over.{p}.v"), F.col(f"__{p}.x.v")).alias(f) for p, f in zip(places, fields)]
    )


def category_fold(
    entries: DataFrame, vendor: str, order: str, fields: Sequence[str], site: Marketplace = DEFAULT_SITE
) -> DataFrame:
    """A vendor's entries of all its category pages, one per ``entry_key``, folded in order.

    The key is the canonical URL, or the cleaned identity fields where there is none.
    """
    identity = [T.field(f) for f in fixed.ENTRY_IDENTITY_FIELDS]
    keyed = entries.withColumn("entry_key", urls.entry_key(T.field("Vehicle_URL"), *identity, site=site))
    return fold_sightings(keyed, [vendor, "entry_key"], order, fields)


# -- fill-only merges ----------------------------------------------------------


def fill_from(left: DataFrame, right: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """Empty fields of the left rows take the right row's value."""
    donor = right.select(on, *[T.field(f).alias(f"__d_{f}") for f in fields])
    joined = left.join(donor, on, "left")
    return joined.select(
        *[
            (
                F.when(T.is_filled(T.field(c)), T.field(c))
                .otherwise(F.coalesce(F.nullif(T.field(f"__d_{c}"), F.lit("")), T.field(c)))
                .alias(c)
                if c in fields
                else T.field(c)
            )
            for c in left.columns
        ]
    )


def _json_text(c: Column) -> Column:
    """A string as a JSON literal."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _conflict_json(conflicts: Column, ours: str, theirs: str) -> Column:
    """Conflicts as one JSON object with sorted keys on both levels."""
    def side(x: Column, name: str) -> Column:
        return F.concat(F.lit(f'"{name}": '), _json_text(x[name]))

    inner = sorted([ours, theirs])
    items = F.transform(
        F.array_sort(conflicts),
        lambda x: F.concat(
            _json_text(x["field"]),
            F.lit(": {"),
            side(x, inner[0]),
            F.lit(", "),
            side(x, inner[1]),
            F.lit("}"),
        ),
    )
    return F.when(
        F.size(conflicts) > 0, F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    )


def merge_detail(
    listings: DataFrame,
    details: DataFrame,
    on: str,
    fields: Sequence[str],
    source: str | Column,
    *,
    offline: bool = False,
) -> DataFrame:
    """Detail fields onto listings, filling only, with provenance and conflicts.

    Adds ``filled_fields`` (array, in field order), ``conflicts`` (JSON or NULL)
    and one ``<field>_source`` column per field.  The offline rule judges presence
    on cleaned text, writes cleaned values and names the sides existing/detail;
    the online rule goes by plain truthiness and names them listing/detail.
    """
    fields = [f for f in fields if f in listings.columns]
    donor = details.select(on, *[T.field(f).alias(f"__d_{f}") for f in fields])
    joined = listings.join(donor, on, "left")
    source_value = F.lit(source) if isinstance(source, str) else source
    ours = "existing" if offline else "listing"

    def incoming(f: str) -> Column:
        return T.clean_text(T.field(f"__d_{f}")) if offline else T.text(T.field(f"__d_{f}"))

    def present(f: str) -> Column:
        return T.has_clean_value(T.field(f)) if offline else T.is_filled(T.field(f))

    fills = {f: ~present(f) & (incoming(f) != "") for f in fields}
    clashes = {
        f: present(f)
        & (incoming(f) != "")
        & (T.clean_text(T.field(f)) != T.clean_text(incoming(f)))
        for f in fields
    }
    filled = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in fills.items()]))
    conflicts = F.array_compact(
        F.array(
            *[
                F.when(
                    c,
                    F.struct(
                        F.lit(f).alias("field"),
                        T.clean_text(T.field(f)).alias(ours),
                        T.clean_text(incoming(f)).alias("detail"),
                    ),
                )
                for f, c in clashes.items()
            ]
        )
    )
    keep = [c for c in listings.columns if c not in fields]
    known = set(listings.columns)
    return joined.select(
        *[T.field(c) for c in keep],
        *[F.when(fills[f], incoming(f)).otherwise(T.field(f)).alias(f) for f in fields],
        *[
            F.when(fills[f], source_value).alias(f"{f}_source")
            for f in fields
            if f"{f}_source" not in known
        ],
        filled.alias("filled_fields"),
        _conflict_json(conflicts, ours, "detail").alias("conflicts"),
    )


# -- vendor attributes, fallbacks, records ---------------------------------------


def attach_vendor(
    listings: DataFrame, vendors: DataFrame, on: str, site_link: str, run_id: str = ""
) -> DataFrame:
    """Vendor id, name and postcode onto listings, with provenance."""
    info = vendors.select(
        on, F.col("Händlername"), F.col("PLZ"), T.field(site_link).alias("source_vendor_url")
    )
    drop = [c for c in ("Händlername", "PLZ", "source_vendor_url") if c in listings.columns]
    return listings.drop(*drop).join(info, on, "inner").withColumns(
        {
            "vehicle_data_source": F.lit("listing_payload"),
            "fetch_strategy": F.lit("listing_payload"),
            "parse_status": F.lit("fallback"),
            "run_id": F.lit(run_id),
        }
    )


def listing_after_failure(
    listings: DataFrame, outcomes: DataFrame, on: str, failed: str
) -> DataFrame:
    """Failed detail attempts fall back to the listing row and keep the attempt's
    metadata; other rows stay as they are."""
    names = [c for c in fixed.DETAIL_METADATA_FIELDS if c in outcomes.columns]
    meta = outcomes.select(on, F.col(failed).alias("__failed"), *[F.col(c).alias(f"__m_{c}") for c in names])
    joined = listings.join(meta, on, "left")
    bad = F.coalesce(F.col("__failed"), F.lit(False))
    updates = {}
    for c in names:
        own = T.field(c) if c in listings.columns else F.lit(None).cast("string")
        taken = F.col(f"__m_{c}").cast("string")
        updates[c] = F.when(bad & T.is_filled(taken), taken).otherwise(own)
    own_source = (
        F.col("vehicle_data_source")
        if "vehicle_data_source" in listings.columns
        else F.lit(None).cast("string")
    )
    updates["vehicle_data_source"] = F.when(bad, F.lit("listing_fallback")).otherwise(own_source)
    return joined.withColumns(updates).drop("__failed", *[f"__m_{c}" for c in names])


def finalize_records(df: DataFrame, run_id: str, scraped_at: Column) -> DataFrame:
    """Defaults for provenance columns.  Only NULL (absent) takes a default, empty
    text stays."""
    have = set(df.columns)

    def own(name: str) -> Column:
        return T.field(name) if name in have else F.lit(None).cast("string")

    scored = [
        c
        for c in df.columns
        if c not in {"parse_status", "vehicle_data_source", "fetch_strategy", "fetch_status"}
    ]
    first = df.withColumns(
        {
            "run_id": F.coalesce(own("run_id"), F.lit(run_id)),
            "source_vendor_url": F.coalesce(own("source_vendor_url"), F.lit("")),
            "source_vehicle_url": F.coalesce(own("source_vehicle_url"), own("Vehicle_URL")),
            "scraped_at": F.coalesce(own("scraped_at"), scraped_at),
        }
    )
    names = list(dict.fromkeys([*scored, "run_id", "source_vendor_url", "source_vehicle_url", "scraped_at"]))
    counted = T.record_score([c for c in names if c in first.columns]) + sum(
        (
            F.coalesce(T.scores_as_value(own(c)), F.lit(False)).cast("int")
            for c in ("vehicle_data_source", "fetch_strategy", "fetch_status")
        ),
        F.lit(0),
    )
    source = F.coalesce(
        own("vehicle_data_source"),
        F.when(T.is_filled(own("fetch_strategy")), F.lit("detail_page")).otherwise(
            F.lit("listing_payload")
        ),
    )
    rows = first.withColumns(
        {
            "parse_status": F.coalesce(
                own("parse_status"), F.when(counted > 4, F.lit("ok")).otherwise(F.lit("partial"))
            ),
            "vehicle_data_source": source,
            "fetch_strategy": F.coalesce(own("fetch_strategy"), source),
            "fetch_status": F.coalesce(own("fetch_status"), F.lit("")),
        }
    )
    if "Financing" in have and "Finanzierung" in have:
        a, b = T.field("Finanzierung"), T.field("Financing")
        rows = rows.withColumns(
            {
                "Finanzierung": F.when(T.is_filled(b) & ~T.is_filled(a), b).otherwise(a),
                "Financing": F.when(T.is_filled(a) & ~T.is_filled(b), a).otherwise(b),
            }
        )
    return rows


def normalize_errors(df: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Error records of either shape to the 14 columns, extras kept at the right."""
    have = set(df.columns)

    def own(name: str) -> Column:
        return T.field(name).cast("string") if name in have else F.lit(None).cast("string")

    stage = T.first_filled(own("stage"), own("type"))
    message = T.first_filled(own("error_message"), own("error"))
    values = {
        "run_id": T.first_filled(own("run_id"), F.lit(run_id)),
        "timestamp": T.first_filled(own("timestamp"), now.cast("string")),
        "stage": stage,
        "type": stage,
        "status_code": own("status_code").try_cast("int"),
        "attempt": own("attempt").try_cast("int"),
        "error_message": message,
        "error": message,
    }
    return df.select(
        *[values.get(c, T.text(own(c))).alias(c) for c in fixed.ERROR_FIELDS],
        *[T.field(c) for c in df.columns if c not in fixed.ERROR_FIELDS],
    )


# -- targets -------------------------------------------------------------------


def in_targets(df: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the target set."""
    return df.join(targets.select(*on), list(on), "left_semi")


def not_done(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the completed set."""
    return df.join(done.select(*on), list(on), "left_anti")


def detail_outcomes(jobs: DataFrame, *, policy: str, open_strategy: str = "") -> DataFrame:
    """Needed, skipped, blocked, failed or success for every detail job.

    Jobs hold the listing columns, ``Vehicle_URL``, and the attempt's
    ``last_status``, ``last_error``, ``fetch_status``, ``fetch_strategy``,
    ``detail_status`` and ``fetch_fallback_reason``.
    """
    needed = P.needs_detail(
        F.col("Vehicle_URL"), policy, available=jobs.columns, open_strategy=open_strategy
    )
    status = P.detail_status_code(F.col("last_status"), F.col("fetch_status"))
    message = T.text("last_error")
    texts = F.concat_ws(
        " ", message, T.text("fetch_fallback_reason"), T.text("parse_status"), T.text("fetch_status")
    )
    failed = P.detail_failed(status, texts, F.col("fetch_strategy"), F.col("detail_status"))
    blocked = (
        F.coalesce(status.isin(403, 503), F.lit(False))
        | message.contains("blocked_or_503")
        | F.lower(message).contains("edgesuite")
    )
    return jobs.withColumns(
        {
            "status_code": status,
            "outcome": F.when(~needed, F.lit("skipped"))
            .when(blocked, F.lit("blocked"))
            .when(failed, F.lit("failed"))
            .otherwise(F.lit("success")),
        }
    )


