"""Row decisions over fetch rows, attempt rows and listing records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T
from lotwise.functions import urls as U
from lotwise.site import DEFAULT_SITE, Marketplace

# -- fetch rows --------------------------------------------------------------


def fetch_ok(error_type: Column, html: Column, status: Column) -> Column:
    return (
        ~T.is_filled(error_type)
        & T.is_filled(html)
        & F.coalesce((status >= 200) & (status < 400), F.lit(True))
    )


def static_page(error_type: Column, error_message: Column, status: Column, html: Column) -> Column:
    """Whether a plain fetch is usable, and why not."""
    body = T.text(html)
    lowered = F.lower(body)
    reason = (
        F.when(T.is_filled(error_type), T.first_filled(error_message, error_type))
        .when(
            status.isNotNull() & ~((status >= 200) & (status < 400)),
            F.concat(F.lit("HTTP "), status.cast("string")),
        )
        .when(F.length(T.strip(body)) < 200, F.lit("static_html_too_short"))
        .when(
            T.contains_any(lowered, fixed.BLOCK_TEXT_MARKERS),
            F.lit("static_html_blocked_or_challenge"),
        )
        .when(
            T.contains_any(lowered, fixed.SCRIPT_NEEDED_MARKERS),
            F.lit("static_html_requires_browser"),
        )
        .otherwise(F.lit(""))
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def looks_blocked(c: Column | str) -> Column:
    return T.contains_any(F.lower(T.text(c)), fixed.BLOCK_TEXT_MARKERS)


def looks_edge_error(c: Column | str) -> Column:
    return T.contains_any(F.lower(T.text(c)), fixed.EDGE_ERROR_MARKERS)


def edge_reference(c: Column | str) -> Column:
    return F.regexp_extract(T.text(c), r"(?i)Reference\s*#?([A-Za-z0-9_.-]+)", 1)


# -- attempt rows ------------------------------------------------------------


def attempt_blocked(texts: Sequence[Column], status: Column) -> Column:
    """Any block marker in the joined texts or the status code."""
    joined = F.concat_ws(
        " ", *[F.lower(T.clean_text(t)) for t in texts], T.text(status)
    )
    return T.contains_any(joined, fixed.ATTEMPT_BLOCK_MARKERS)


def detail_status_code(last_status: Column, fetch_status: Column) -> Column:
    """Browser status unless zero or missing, else the recorded status if numeric."""
    seen = F.when(last_status != 0, last_status.cast("int"))
    recorded = F.when(
        T.strip(fetch_status).rlike(r"^[+-]?\d+$"), T.strip(fetch_status).try_cast("int")
    )
    return F.coalesce(seen, recorded)


def detail_failed(
    status: Column,
    error_text: Column,
    strategy: Column,
    detail_status: Column,
    click_strategy: str = "uc-popup",
) -> Column:
    """A detail attempt failed: by code, by refusal text, or by its outcome state."""
    refused = T.contains_any(F.lower(T.text(error_text)), ["access denied", "site protection"])
    outcome = F.when(
        T.text(strategy) == click_strategy, T.text(detail_status) != "real_detail_page"
    ).otherwise(T.text(detail_status).isin(fixed.FAILED_DETAIL_STATES))
    return F.coalesce(status.isin(fixed.FAILED_STATUS_CODES), F.lit(False)) | refused | outcome


# -- detail policy -----------------------------------------------------------


def missing_fields(names: Sequence[str], *, cleaned: bool = True) -> Column:
    """The named fields that hold no value, in the given order."""
    present = T.has_clean_value if cleaned else T.has_value
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(present(T.field(n)), F.lit(False)), F.lit(n))
                for n in names
            ]
        )
    )


def needs_detail(
    url: Column,
    policy: str,
    *,
    available: Sequence[str],
    open_strategy: str = "",
    skip_details: bool = False,
) -> Column:
    """Whether a listing still needs its detail page under the policy.

    ``available`` names the columns the listing rows have; a policy field that is
    not among them counts as missing.
    """
    no = F.lit(False)
    if skip_details or open_strategy == "listing-only" or policy == "never":
        return no

    def present(name: str) -> Column:
        return F.coalesce(T.has_value(T.field(name)), no) if name in available else no

    real = U.is_detail_url(url)
    if policy == "financing-only":
        wanted = F.lit(True)
        for name in fixed.FINANCING_FLAG_FIELDS:
            wanted = wanted & ~present(name)
    elif policy == "missing-required":
        fields = (
            fixed.LOW_COVERAGE_FIELDS
            if open_strategy == "uc-popup"
            else fixed.LISTING_REQUIRED_FIELDS
        )
        wanted = no
        for name in fields:
            wanted = wanted | ~present(name)
    else:
        wanted = F.lit(True)
    return real & wanted


# -- source audit ------------------------------------------------------------


def is_api_endpoint(url: Column, content_type: Column, resource: Column) -> Column:
    return (
        T.text(resource).isin("xhr", "fetch")
        | F.lower(T.text(content_type)).contains("json")
        | T.contains_any(T.text(url), ["/api/", "/svc/"])
    )


def keeps_body(
    url: Column, content_type: Column, resource: Column, site: Marketplace = DEFAULT_SITE
) -> Column:
    return U.url_host(url).endswith(site.domain) & (
        F.lower(T.text(content_type)).contains("json") | T.text(resource).isin("xhr", "fetch")
    )


def body_suffix(content_type: Column) -> Column:
    kind = F.lower(T.text(content_type))
    return (
        F.when(kind.contains("json"), F.lit(".json"))
        .when(kind.contains("html"), F.lit(".html"))
        .when(kind.contains("javascript"), F.lit(".js"))
        .otherwise(F.lit(".txt"))
    )


def small_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _v: F.lower(k).isin(fixed.HEADER_KEEP))


def valid_target_value(field_name: Column, value: Column) -> Column:
    """Extracted value that is data and not a filter caption."""
    v = T.text(value)
    lowered = F.lower(v)
    shape = (
        F.when(field_name == fixed.CO2_LABEL, v.rlike(T.insensitive(r"\d+\s*g/km")))
        .when(field_name == "Anzahl der Fahrzeughalter", v.rlike(r"(?U)\b\d+\b"))
        .otherwise(F.lit(True))
    )
    return (
        (v != "")
        & ~T.contains_any(lowered, fixed.TARGET_VALUE_REJECTS)
        & (F.length(v) <= 120)
        & shape
    )
