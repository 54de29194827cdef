"""URL and identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.site import DEFAULT_SITE, Marketplace

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(T.text(c), _URL, 1))


def url_host(c: Column) -> Column:
    return F.regexp_extract(T.text(c), _URL, 2)


def url_path(c: Column) -> Column:
    return F.regexp_extract(T.text(c), _URL, 3)


def url_query(c: Column) -> Column:
    return F.regexp_extract(T.text(c), _URL, 4)


def _decode(c: Column) -> Column:
    return F.try_url_decode(c)


def _encode(c: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(
        F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def query_pairs(c: Column) -> Column:
    """Query parameters in order as an array of (key, value)."""
    parts = F.filter(F.split(url_query(c), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            _decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def query_value(c: Column, *names: str) -> Column:
    """First value of the first parameter that is there with a value."""
    q = F.concat(F.lit("&"), url_query(c))
    found = []
    for name in names:
        raw = F.regexp_extract(q, rf"&{T.quote(name)}=([^&]+)", 1)
        found.append(
            T.null_if_empty(_decode(raw))
        )
    return F.coalesce(*found, F.lit(""))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def dealer_url(c: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """Canonical dealer home page: absolute, https, upper-case slug, no query."""


    def absolute(raw: Column) -> Column:
        return (
            F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
            .when(raw.startswith("/"), F.concat(F.lit(site.dealer_base), raw))
            .when(raw.startswith("http"), raw)
            .otherwise(F.concat(F.lit(site.dealer_base + "/"), F.ltrim(raw, F.lit("/"))))
        )

    def parts(url: Column) -> Column:
        path = url_path(url)
        return F.struct(
            url.alias("url"),
            url_host(url).alias("host"),
            path.alias("path"),
            path_segments(path).alias("segments"),
        )

    def canonical(p: Column) -> Column:
        slug = F.concat(F.lit("/"), F.upper(F.get(p["segments"], F.lit(0))))
        tail = F.when(F.size(p["segments"]) == 1, slug).otherwise(F.rtrim(p["path"], F.lit("/")))
        foreign = (p["host"] != "") & (p["host"] != site.dealer_host)
        return F.when(foreign, p["url"]).otherwise(F.concat(F.lit(site.dealer_base), tail))

    raw = F.trim(F.trim(T.strip(c), F.lit('"')), F.lit("'"))
    url = T.let(T.let(T.let(raw, absolute), parts), canonical)
    return F.when(T.text(c) == "", F.lit("")).otherwise(url)


def vehicle_url(c: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """Listing id or partial URL to an absolute detail URL."""


    def absolute(u: Column) -> Column:
        return (
            F.when(u == "", F.lit(""))
            .when(
                u.rlike(r"^\d+$"),
                F.concat(F.lit(f"{site.search_base}/fahrzeuge/details.html?id="), u),
            )
            .when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when(u.startswith("/"), F.concat(F.lit(site.search_base), u))
            .when(~u.startswith("http"), F.concat(F.lit("https://"), u))
            .otherwise(u)
        )

    return T.let(T.clean_text(c), absolute)


def dealer_slug(c: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """First path part of the canonical dealer URL."""
    path = F.trim(url_path(dealer_url(c, site)), F.lit("/"))
    return F.substring_index(path, "/", 1)


def listing_id(c: Column | str) -> Column:
    """Listing id of a detail URL: a numeric ``id`` parameter, else eight or more
    digits standing as a path part."""


    def find(u: Column) -> Column:
        by_query = F.regexp_extract(query_value(u, "id"), r"^\d+$", 0)
        by_path = F.regexp_extract(u, r"(?:[?&]id=|/)(\d{8,})(?:[&#/?]|$)", 1)
        return F.coalesce(T.null_if_empty(by_query), by_path)

    return T.let(T.clean_text(c), find)


def is_listing_id(c: Column | str) -> Column:
    return T.text(c).rlike(r"^\d{8,}$")


def is_dealer_link(c: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """Link that can be a dealer home page."""


    def home_page(url: Column) -> Column:
        segments = path_segments(url_path(url))
        slug = F.lower(F.get(segments, F.lit(0)))
        return (
            (url_host(url) == site.dealer_host)
            & (F.size(segments) == 1)
            & ~slug.isin(fixed.BLOCKED_DEALER_SLUGS)
            & (F.length(slug) > 1)
        )

    def decide(href: Column) -> Column:
        return (
            (href != "")
            & ~href.rlike(r"^(?:#|mailto:|tel:)|/regional/|\.html$")
            & T.let(dealer_url(href, site), home_page)
        )

    return F.coalesce(T.let(T.strip(c), decide), F.lit(False))


def is_detail_url(c: Column | str) -> Column:
    return T.contains_any(T.text(c), fixed.DETAIL_PATHS)


def is_vehicle_href(c: Column | str) -> Column:
    href = T.text(c)
    return ~href.rlike(r"^(?:#|mailto:|tel:)") & T.contains_any(href, fixed.DETAIL_PATHS)


def is_vehicle_url(c: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """Widest rule: detail paths, the search host, or any ``id=``."""
    return T.contains_any(T.text(c), [*fixed.DETAIL_PATHS, site.search_host, "id="])


def category_url(c: Column | str, category: Column | str, site: Marketplace = DEFAULT_SITE) -> Column:
    """Inventory URL of one category: paging dropped, ``vc`` set.

    A repeated parameter keeps its first place and takes its last value, so the
    appended ``vc`` also replaces an earlier one in its place.
    """
    u = T.text(c)
    wanted = F.struct(F.lit("vc").alias("key"), T.col(category).alias("value"))
    pairs = F.concat(
        F.filter(query_pairs(u), lambda p: ~p["key"].isin("page", "pageNumber")), F.array(wanted)
    )

    def put(acc: Column, p: Column) -> Column:
        replaced = F.transform(acc, lambda q: F.when(q["key"] == p["key"], p).otherwise(q))
        return F.when(F.exists(acc, lambda q: q["key"] == p["key"]), replaced).otherwise(
            F.concat(acc, F.array(p))
        )

    merged = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), put)
    encoded = F.transform(merged, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"])))
    scheme = F.coalesce(T.null_if_empty(url_scheme(u)), F.lit("https"))
    host = F.coalesce(T.null_if_empty(url_host(u)), F.lit(site.dealer_host))
    path = F.coalesce(T.null_if_empty(F.rtrim(url_path(u), F.lit("/"))), F.lit("/"))
    return F.concat(scheme, F.lit("://"), host, path, F.lit("?"), F.array_join(encoded, "&"))


def category_of_href(c: Column | str) -> Column:
    """Category code in a link's query, empty unless it is a known code."""
    codes = "|".join(fixed.CATEGORY_LABELS)
    value = T.without_placeholder(query_value(T.text(c), "vc", "vehicleCategory"))
    return F.regexp_extract(value, f"^(?:{codes})$", 0)


def synthetic_url(
    dealer: Column, page: Column, position: Column, brand: Column, model: Column, category: Column
) -> Column:
    """Key URL for a card without a link.  ``page`` and ``position`` start at 0."""
    title = F.concat_ws(
        " ", F.nullif(T.text(brand), F.lit("")), F.nullif(T.text(model), F.lit(""))
    )
    slug = F.trim(F.regexp_replace(T.strip(title), r"[^A-Za-z0-9ÄÖÜäöüß-]+", "-"), F.lit("-"))
    tag = F.when(T.is_filled(category), F.concat(category, F.lit("-"))).otherwise(F.lit(""))
    return F.concat(
        F.rtrim(T.text(dealer), F.lit("/")),
        F.lit("#listing-"),
        tag,
        (page + 1).cast("string"),
        F.lit("-"),
        (position + 1).cast("string"),
        F.lit("-"),
        F.url_encode(F.substring(slug, 1, 80)),
    )


def entry_key(
    url: Column, *parts: Column, site: Marketplace = DEFAULT_SITE
) -> Column:
    """Canonical URL, else the cleaned identity fields joined by pipes."""
    joined = F.concat_ws("|", *[T.clean_text(p) for p in parts])
    return F.coalesce(T.null_if_empty(vehicle_url(url, site)), joined)


def state_label(c: Column | str) -> Column:
    """State slug to its name; unknown slugs become title case."""
    slug = T.text(c)
    return F.coalesce(T.literal_map(fixed.STATE_LABELS)[slug], F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def config_fingerprint(settings: Column) -> Column:
    """SHA-256 over the twelve run settings as sorted-key JSON.

    ``settings`` is a struct with the twelve fields; text is quoted, numbers and
    booleans are not.
    """
    parts = []
    for key in fixed.CONFIG_FINGERPRINT_KEYS:
        item = F.to_json(F.array(settings[key]))
        parts.append(F.concat(F.lit(f'"{key}": '), F.substring(item, F.lit(2), F.length(item) - 2)))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)
