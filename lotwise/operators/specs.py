"""Specifications, financing, title and price of saved detail pages.

Every extractor yields an array of (label, value) pairs in the page's own row; the
assembly concatenates them in their fixed order and keeps the first value per
label.  The whole job is projections, staged with ``withColumn`` so that no
pattern runs twice; it shuffles nothing.

Arrays are exploded with the ``outer`` form and a filter on the element after it:
a plain ``explode`` infers a size filter and computes the whole array a second time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import html as H
from lotwise.functions import payload as J
from lotwise.functions import predicates as P
from lotwise.functions import text as T
from lotwise.functions import titles
from lotwise.functions import urls as U
from lotwise.site import DEFAULT_SITE, Marketplace

_PAIRS = "array<struct<label:string,value:string>>"


def _pair(label: Column | str, value: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(label.alias("label"), value.alias("value"))


def _canonical_names() -> dict[str, str]:
    names = {label.lower(): label for label in fixed.SPEC_LABELS}
    names.update({alias.lower(): label for alias, label in fixed.SPEC_LABEL_ALIASES.items()})
    return names


def canonical_label(c: Column, ready: bool = False) -> Column:
    """Listed spelling of a label or alias; NULL for unknown labels.  ``ready`` says the text is clean."""
    names, co2 = _canonical_names(), "|".join(fixed.CO2_LABEL_PREFIXES)
    table = T.literal_map(names)  # searched from its start, so only for words that it holds
    return T.let(
        F.lower(F.rtrim(c, F.lit(":")) if ready else H.without_colon(c)),
        lambda x: F.when(x.startswith("co") & x.rlike(f"^(?:{co2})"), F.lit(fixed.CO2_LABEL)).when(x.isin(list(names)), table[x]),
    )


def neighbour_pairs(texts: Column) -> Column:
    """Labels followed by their value in the next element, and ``Label: value`` texts.

    ``texts`` are the page's leaf texts, so this covers flat neighbours only.
    """
    listed = sorted([*fixed.SPEC_LABELS, *fixed.SPEC_LABEL_ALIASES], key=len, reverse=True)
    inline = T.insensitive("^(" + "|".join(T.quote(x) for x in listed) + r")\s*[:\-]\s*(.+)$")

    def of(item: Column) -> Column:
        return F.when(
            item["label"].isNotNull(), _pair(item["label"], F.coalesce(item["next"], F.lit("")))
        ).otherwise(
            F.when(
                item["text"].contains(":") | item["text"].contains("-"),
                T.let(
                    F.regexp_extract(item["text"], inline, 1),
                    lambda label: _pair(
                        label,
                        F.when(label != "", F.trim(F.regexp_extract(item["text"], inline, 2), F.lit(" :"))).otherwise(F.lit("")),
                    ),
                ),
            ).otherwise(_pair("", F.lit("")))
        )

    def with_next(all_texts: Column) -> Column:
        following = F.slice(all_texts, F.lit(2), F.size(all_texts))
        return F.zip_with(
            all_texts,
            following,
            lambda t, n: F.struct(
                t.alias("text"), canonical_label(t, ready=True).alias("label"), n.alias("next")
            ),
        )

    return F.transform(T.let(texts, with_next), of)


def state_pairs(objects: Column) -> Column:
    """Pairs out of the page's initial-state objects: label/value and tag/value."""
    tags = T.literal_map(fixed.STATE_TAG_LABELS)

    def of(o: Column) -> Column:
        return T.let(F.from_json(o, "label string, value string, tag string"), pairs)

    def pairs(parsed: Column) -> Column:
        value = T.without_placeholder(parsed["value"])
        return F.array(
            _pair(T.without_placeholder(parsed["label"]), value),
            _pair(F.coalesce(tags[T.without_placeholder(parsed["tag"])], F.lit("")), value),
        )

    return F.flatten(F.transform(objects, of))


def initial_state_text(html: Column) -> Column:
    """The initial-state assignment of a page, from its first brace on."""
    found = F.regexp_extract(
        T.text(html), r"(?is)window\.__INITIAL_STATE__[^{]*(\{.*?)</script", 1
    )
    return T.let(found, lambda state: F.when(state != "", F.array(state)))


def quick_stats(words: Column) -> Column:
    """Mileage, power, date, fuel, gearbox, emissions and capacity named in a text."""


    def stats(folded: Column) -> Column:
        def found(pattern: str) -> Column:
            return F.when(T.contains_any(folded, _needs(pattern)), T.first_match(words, pattern, 1)).otherwise(F.lit(""))

        return F.array(*[_pair(label, found(pattern)) for pattern, label in fixed.QUICK_STAT_PATTERNS])

    return T.let(_folded(words), stats)


def _folded(words: Column) -> Column:
    """Text in which a pattern without regard to case finds its words in lower case.

    The dotted capital i, which such a pattern takes for an i, would become two characters.
    """
    return F.lower(F.upper(F.replace(words, F.lit("İ"), F.lit("i"))))


def _needs(pattern: str) -> list[str]:
    """Words of which a text must hold one for the pattern to match: its longest run of letters, or its alternatives."""
    choice = re.search(r"\((?:\?:)?([A-Za-z]{3,}(?:\|[A-Za-z]{3,})+)\)", pattern)
    if choice:
        return [w.lower() for w in choice.group(1).split("|")]
    runs = re.findall(r"(?<![\\A-Za-z])[A-Za-z]{2,}", re.sub(r"\\[A-Za-z]|\[[^\]]*\]", " ", pattern))
    return [max(runs, key=len).lower()]


def labelled_pairs(words: Column) -> Column:
    """``Label: value`` for every known label, up to a separator or 80 characters."""
    labels = [*fixed.SPEC_LABELS, "CO2-Emissionen"]
    return F.array(
        *[
            _pair(
                label,
                F.when(
                    words.contains(label),
                    T.clean_text(F.regexp_extract(words, rf"(?U){T.quote(label)}\s*[:\-]\s*([^|•]{{1,80}})", 1)),
                ).otherwise(F.lit("")),
            )
            for label in labels
        ]
    )


# Words of which a text must hold one for the trim-line pattern of the same place to match.
_TRIM_LINE_NEEDS = [["design-"], ["ausstattungslinie"], ["amg", "line", "sport", "edition"]]


def trim_line(words: Column) -> Column:
    """Equipment line named in a description, cut at option codes and packages."""
    return T.let(_folded(words), lambda folded: _trim_line(words, folded))


def _trim_line(words: Column, folded: Column) -> Column:
    tries = []
    for (pattern, group), needs in zip(fixed.TRIM_LINE_PATTERNS, _TRIM_LINE_NEEDS, strict=True):
        value = F.when(T.contains_any(folded, needs), F.regexp_extract(words, T.insensitive(pattern), group))
        value = F.get(F.split(value, r"(?U)\s+(?:[A-Z]\d{2,3}|\d{3}[A-Z]?|[A-Z]{2,4}\d?)\s+", 2), F.lit(0))
        value = F.get(
            F.split(
                value,
                T.insensitive(r"\s+[A-Za-z0-9-]*Paket\b|\s+Exterieur\b|\s+Interieur\b"),
                2,
            ),
            F.lit(0),
        )
        value = F.regexp_replace(
            value, T.insensitive(r"\b(?:Paket|Exterieur|Interieur|Sicherheit)\b.*$"), ""
        )
        value = F.trim(T.clean_text(value), F.lit(" -"))
        rejects = "|".join(fixed.TRIM_LINE_REJECTS)
        tries.append(T.null_if_empty(F.regexp_replace(value, T.insensitive(f"^(?:{rejects})$"), "")))
    return F.coalesce(*tries, F.lit(""))


def first_values(pairs: Column) -> Column:
    """Pairs to a label map: unknown labels and dashes dropped, first value kept.

    Pairs without a value, which are most of a page's, drop before their label is looked up.
    """
    canonical = F.filter(
        F.transform(F.filter(pairs, lambda p: p["value"] != ""), lambda p: _pair(canonical_label(p["label"]), T.clean_text(p["value"]))),
        lambda p: p["label"].isNotNull()
        & (p["value"] != "")
        & ~p["value"].rlike(T.insensitive(r"^[-–—]+\s*(?:g\s*/?\s*km|cm³|ccm)?$")),
    )
    return keep_first_pairs(canonical)


def keep_first_pairs(pairs: Column) -> Column:
    """Array of pairs to a map, the first value of every label."""
    def firsts(p: Column) -> Column:
        return T.let(F.transform(p, lambda q: q["label"]), lambda labels: F.filter(p, lambda q, i: F.array_position(labels, q["label"]) == i + 1))

    return F.map_from_entries(T.let(pairs, firsts))


def keep_last_pairs(pairs: Column) -> Column:
    return keep_first_pairs(F.reverse(pairs))


def with_specs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``page_text`` and ``specs`` (label map) to pages."""
    page = F.col(html)
    rows = pages if "payloads" in pages.columns else pages.withColumn("payloads", J.payload_texts(page))
    rows = rows.withColumn("__state_texts", F.coalesce(initial_state_text(page), F.array().cast("array<string>")))
    rows = _with_stated(rows, html).withColumns(
        {
            "page_text": H.markup_text(page),
            "__state": J.objects_with(F.col("__state_texts"), ["label", "tag"], prefix=True),
            "__strings": T.clean_text(
                F.array_join(
                    F.filter(
                        F.flatten(F.transform("payloads", lambda p: J.string_leaves(p))),
                        lambda s: F.length(s) < 200,
                    ),
                    " ",
                )
            ),
        }
    )
    has_strings = F.col("__strings") != ""
    none = F.array().cast(_PAIRS)
    rows = rows.withColumn(
        "__pairs",
        F.concat(
            F.col("__stated"),
            neighbour_pairs(H.leaf_texts(page)),
            F.when(F.size("__state") > 0, state_pairs(F.col("__state"))).otherwise(none),
            F.when(has_strings, quick_stats(F.col("__strings"))).otherwise(none),
            F.when(has_strings, labelled_pairs(F.col("__strings"))).otherwise(none),
            quick_stats(F.col("page_text")),
            F.array(_pair("Ausstattungslinie", trim_line(F.col("page_text")))),
        ),
    )
    rows = rows.withColumn("__first", first_values(F.col("__pairs")))
    kind = F.col("__first")["Fahrzeugtyp"]
    specs = F.when(
        F.col("__first")["Kategorie"].isNull() & kind.isNotNull(),
        F.map_concat("__first", F.create_map(F.lit("Kategorie"), kind)),
    ).otherwise(F.col("__first"))
    return rows.withColumn("specs", specs).drop("__state", "__state_texts", "__strings", "__pairs", "__first", *_new(pages, "__stated"))


def _with_stated(pages: DataFrame, html: str) -> DataFrame:
    """Adds the pairs of definition lists and tables (``__stated``), unless they are there."""
    page = F.col(html)
    return pages.withColumn("__stated", F.concat(H.definition_pairs(page), H.table_pairs(page))) if "__stated" not in pages.columns else pages


def _new(pages: DataFrame, name: str) -> list[str]:
    """The name, unless the pages have such a column of their own."""
    return [] if name in pages.columns else [name]


# -- financing ----------------------------------------------------------------------


def with_financing(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``financing`` (field map): list and table pairs, the last of a field
    wins; then ``Label:`` texts; then the rate pattern.  Needs ``page_text``."""
    names = T.literal_map({label.lower(): f for label, f in fixed.FINANCING_LABELS.items()})
    words, folded = F.col("page_text"), F.col("__folded")
    rows = _with_stated(pages, html).withColumn("__folded", _folded(T.clean_text("page_text")))
    stated = F.filter(
        F.transform(
            "__stated",
            lambda p: _pair(names[F.lower(p["label"])], p["value"]),
        ),
        lambda p: p["label"].isNotNull() & (p["value"] != ""),
    )
    by_text = F.array(
        *[
            _pair(
                f,
                # The folded text has single blanks, so a label stands there with its colon or not at all.
                F.when(
                    T.contains_any(folded, [f"{label.lower()}:", f"{label.lower()} :"]),
                    T.clean_text(
                        F.regexp_extract(
                            words,
                            T.insensitive(rf"(?=[{label[0]}])(?<!\S){T.quote(label)}\s*[:]\s*([^|•]{{1,80}})"),
                            1,
                        )
                    ),
                ).otherwise(F.lit("")),
            )
            for label, f in fixed.FINANCING_LABELS.items()
        ]
    )
    named = T.contains_any(folded, ["finanzierung", "rate"])
    rate = F.array(_pair("Financing", F.when(named, T.first_match(words, fixed.RATE_PATTERN, 1)).otherwise(F.lit(""))))
    rows = rows.withColumn("__all", F.concat(F.reverse(stated), by_text, rate))
    return rows.withColumn(
        "financing", keep_first_pairs(F.filter("__all", lambda p: p["value"] != ""))
    ).drop("__all", "__folded", *_new(pages, "__stated"))


# -- title and price ------------------------------------------------------------------

_LD_VEHICLE = "`@type` string, name string, brand string, model string, offers string"


def ld_vehicle(html: Column) -> Column:
    """First ld+json object that describes a vehicle; NULL where none."""
    item = F.get(
        F.filter(
            H.ld_json_items(html, _LD_VEHICLE),
            lambda o: o["@type"].isin("Vehicle", "Car", "Product"),
        ),
        F.lit(0),
    )
    clean = T.without_placeholder

    def record(x: Column) -> Column:
        named = F.get_json_object(x["brand"], "$.name")
        brand = F.when(x["brand"].startswith("{"), named).otherwise(x["brand"])
        return F.when(
            x.isNotNull(),
            F.struct(
                clean(x["name"]).alias("name"),
                clean(brand).alias("brand"),
                clean(x["model"]).alias("model"),
                clean(F.get_json_object(x["offers"], "$.price")).alias("price"),
            ),
        )

    return T.let(item, record)


def with_title_and_price(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``brand``, ``model`` and ``price``.  Uses ``page_text`` if it is there."""
    page = F.col(html)
    rows = pages if "page_text" in pages.columns else pages.withColumn("page_text", H.markup_text(page))
    has_ld = T.text(page).contains("ld+json")
    in_title = r"""data-testid=["'][^"']*title[^"']*["']"""
    heading = T.first_filled(
        H.first_text(page, "h1"),
        H.markup_text(H.element_with(page, r"""data-testid=["']listing-title["']""")),
        H.markup_text(
            F.regexp_extract(T.text(page), rf"(?is){in_title}[^>]*>.*?<h3\b[^>]*>(.*?)</h3", 1)
        ),
        H.markup_text(
            F.regexp_extract(
                T.text(page), r"""(?is)<div\b[^>]*class=["'][^"']*\blisting-title\b[^>]*>(.*?)</div""", 1
            )
        ),
        H.first_text(page, "title"),
    )
    labels = [
        r"""data-testid=["']price-label["']""",
        r"""data-testid=["']main-price-label["']""",
        r"""class=["'][^"']*mainPrice""",
    ]
    shown = [T.without_footnotes(H.markup_text(H.element_with(page, x))) for x in labels]
    rows = rows.withColumns(
        {
            "__ld": F.when(has_ld, ld_vehicle(page)),
            "__heading": titles.without_price(heading),
            "__shown": F.coalesce(*[T.null_if_empty(F.regexp_extract(s, r"(?s)^.*€.*$", 0)) for s in shown]),
        }
    )
    rows = rows.withColumn("__split", titles.split_title("__heading"))
    ld, split = F.col("__ld"), F.col("__split")
    by_ld = T.is_filled(ld["brand"])
    ld_model = F.when(ld["model"] != "", ld["model"]).otherwise(
        titles.without_brand(ld["name"], ld["brand"])
    )
    ld_price = F.when(T.is_filled(ld["price"]), F.concat(ld["price"], F.lit(" €")))
    in_text = T.clean_text(F.regexp_extract("page_text", f"(?U){T.led(fixed.PRICE_TEXT_PATTERN)}", 0))
    return rows.withColumns(
        {
            "brand": F.when(by_ld, ld["brand"]).otherwise(split["brand"]),
            "model": F.when(by_ld, ld_model).otherwise(split["model"]),
            "price": F.coalesce("__shown", ld_price, in_text),
        }
    ).drop("__ld", "__heading", "__split", "__shown")


# -- detail records ---------------------------------------------------------------------

DETAIL_FIELDS = [
    "Markes", "Models", "Preis",
    *["Fahrzeugtyp" if f == "Kategorie" else f for f in fixed.DETAIL_SPEC_FIELDS],
    *dict.fromkeys([*fixed.FINANCING_LABELS.values(), "Finanzierung"]),
]


def detail_records(pages: DataFrame, key: str | Sequence[str], html: str = "html") -> DataFrame:
    """All record fields of detail pages; empty where a page does not state them."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = with_title_and_price(with_financing(with_specs(_with_stated(pages, html), html), html), html)
    specs, fin = F.col("specs"), F.col("financing")

    def or_empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return rows.select(
        *keys,
        F.col("brand").alias("Markes"),
        F.col("model").alias("Models"),
        F.col("price").alias("Preis"),
        *[
            or_empty(specs[f]).alias("Fahrzeugtyp" if f == "Kategorie" else f)
            for f in fixed.DETAIL_SPEC_FIELDS
        ],
        *[or_empty(fin[f]).alias(f) for f in dict.fromkeys(fixed.FINANCING_LABELS.values())],
        or_empty(fin["Financing"]).alias("Finanzierung"),
    )


def target_fields(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The four target fields with a valid value, as rows."""
    rows = with_specs(pages, html)
    wanted = F.array(
        *[_pair(f, F.coalesce(F.col("specs")[f], F.lit(""))) for f in fixed.LOW_COVERAGE_FIELDS]
    )
    found = rows.select(key, F.explode_outer(wanted).alias("p")).select(
        key, F.col("p.label").alias("field"), F.col("p.value").alias("value")
    )
    return found.filter(P.valid_target_value(F.col("field"), F.col("value")))


# -- page class ---------------------------------------------------------------------------


def classify_pages(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    title: str | None = None,
    site: Marketplace = DEFAULT_SITE,
) -> DataFrame:
    """Class, reason and signals of captured pages."""
    rows = with_title_and_price(with_specs(pages, html), html)
    page, words = T.text(F.col(html)), F.lower("page_text")
    shown = T.clean_text(F.col(title)) if title else F.lit("")
    address = F.lower(T.text(F.col(url)))
    lower_html, lower_title = F.lower(page), F.lower(shown)
    marker = F.coalesce(
        *[
            F.when(lower_html.contains(m) | lower_title.contains(m) | address.contains(m), F.lit(m))
            for m in fixed.ERROR_PAGE_MARKERS
        ]
    )
    detail = T.contains_any(address, fixed.DETAIL_PATHS)
    listing = address.contains("search.html") | address.contains("/fahrzeuge/search")
    home_root = (U.url_host(F.col(url)) == site.dealer_host) & (
        F.size(F.split(F.trim(U.url_path(F.col(url)), F.lit("/")), "/")) <= 1
    )
    home_title = F.lit(True)
    for word in site.home_title_markers:
        home_title = home_title & lower_title.contains(word)
    content = T.contains_any(words, fixed.DETAIL_CONTENT_MARKERS)
    rows = rows.withColumns(
        {
            "__marker": marker,
            "__detail": detail,
            "__content": content,
            "__home": home_title,
            "__who": ((F.col("brand") != "") | (F.col("model") != "")) & ~home_title,
            "__data": (F.col("price") != "") | (F.size("specs") > 0),
        }
    )
    is_detail, has_text = F.col("__detail"), F.col("__content")
    who, data = F.col("__who"), F.col("__data")
    stranger = ~who & ~has_text

    def verdict(kind: str, reason: Column | str) -> Column:
        return F.struct(
            F.lit(kind).alias("classification"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    found = (
        F.when(
            (T.clean_text(page) == "") & (shown == "") & (T.text(F.col(url)) == ""),
            verdict("blank_page", "empty_capture"),
        )
        .when(
            address.isin("about:blank", "data:,") | ((F.length(T.strip(page)) < 80) & (shown == "")),
            verdict("blank_page", "blank_or_too_short"),
        )
        .when(F.col("__marker").isNotNull(), verdict("error_page", F.col("__marker")))
        .when(F.col("__home") & stranger, verdict("home_redirect", "home_title_without_vehicle_signals"))
        .when(home_root & stranger, verdict("home_redirect", "home_url_without_vehicle_signals"))
        .when(listing & ~is_detail, verdict("listing_page", "search_listing_url"))
        .when(
            is_detail & who & (data | has_text),
            verdict("real_detail_page", "detail_url_with_vehicle_signals"),
        )
        .when(
            who & data & has_text,
            verdict("real_detail_page", "vehicle_signals_without_detail_url"),
        )
        .when(is_detail, verdict("unknown", "detail_url_without_enough_vehicle_signals"))
        .otherwise(verdict("unknown", "no_known_detail_or_error_signals"))
    )
    rows = rows.withColumn("__v", found)
    reason = F.col("__v.reason")
    signals = F.when(
        F.col("__v.classification") == "error_page",
        F.create_map(F.lit("error_marker"), reason),
    ).when(
        (F.col("__v.classification") == "real_detail_page")
        | (reason == "detail_url_without_enough_vehicle_signals"),
        F.create_map(
            F.lit("brand"), F.col("brand"),
            F.lit("model"), F.col("model"),
            F.lit("price"), F.col("price"),
            F.lit("spec_count"), F.size("specs").cast("string"),
        ),
    )
    return rows.withColumns(
        {"classification": F.col("__v.classification"), "reason": reason, "signals": signals}
    ).drop("__marker", "__detail", "__content", "__home", "__who", "__data", "__v")


def static_vehicle(pages: DataFrame, html: str = "html") -> DataFrame:
    """Whether a plain page names a vehicle and its price or specs, and why not."""
    rows = with_title_and_price(with_specs(pages, html), html)
    reason = (
        F.when((F.col("brand") == "") & (F.col("model") == ""), F.lit("missing_vehicle_title_in_static_html"))
        .when((F.col("price") == "") & (F.size("specs") == 0), F.lit("missing_vehicle_fields_in_static_html"))
        .otherwise(F.lit(""))
    )
    return rows.withColumns({"invalid_reason": reason, "valid": reason == ""})


def static_vendor(vendors: DataFrame, site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """Whether a vendor record has identity, a place, and a contact or a count."""
    def filled(*names: str) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | T.is_filled(T.field(n))
        return hit

    ok = (
        filled("Händlername")
        & filled(site.link_field)
        & filled("PLZ", "Städte")
        & (
            filled("Telephone Number", "Email ID", "Hauptseite")
            | T.field(fixed.VENDOR_COUNT_FIELD).isNotNull()
        )
    )
    return vendors.withColumns(
        {
            "valid": ok,
            "invalid_reason": F.when(ok, F.lit("")).otherwise(
                F.lit("missing_vendor_fields_in_static_html")
            ),
        }
    )


# -- directory pages ------------------------------------------------------------------------

_BLOCK = r"(?is)(?=<(?:article|li|section|tr|div|p)\b)"


def static_directory(pages: DataFrame, html: str = "html", site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """Whether a plain directory page names a dealer at all, by a link or a URL in a script."""
    page = T.text(F.col(html))
    linked = F.exists(
        F.split(page, _BLOCK),
        lambda b: F.exists(H.anchors(b), lambda a: U.is_dealer_link(a["href"], site)),
    )
    urls = F.regexp_extract_all(page, F.lit(rf"https?://{T.quote(site.dealer_host)}/[A-Za-z0-9][A-Za-z0-9_-]*"), F.lit(0))
    rows = pages.withColumn("valid", linked | F.exists(urls, lambda u: U.is_dealer_link(u, site)))
    return rows.withColumn(
        "invalid_reason", F.when(F.col("valid"), F.lit("")).otherwise(F.lit("no_dealers_in_static_html"))
    )


def directory_dealers(
    pages: DataFrame, key: str, html: str = "html", site: Marketplace = DEFAULT_SITE
) -> DataFrame:
    """Dealer rows of directory pages, from links and then from URLs in scripts.

    The address is read in the block around the link, or the link itself where the
    block holds no more than 20 characters.  The last link of a URL wins.
    """
    page = F.col(html)
    blocks = F.split(T.text(page), _BLOCK)
    linked = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.filter(H.anchors(b), lambda a: U.is_dealer_link(a["href"], site)),
                lambda a: F.struct(
                    U.dealer_url(a["href"], site).alias("url"),
                    a["markup"].alias("link"),
                    b.alias("block"),
                ),
            ),
        )
    )
    mentioned = F.transform(
        F.regexp_extract_all(
            T.text(page), F.lit(rf"https?://{T.quote(site.dealer_host)}/[A-Za-z0-9][A-Za-z0-9_-]*"), F.lit(0)
        ),
        lambda u: U.dealer_url(u, site),
    )
    rows = pages.select(key, linked.alias("linked"), mentioned.alias("mentioned"))
    extra = F.filter(
        F.array_except("mentioned", F.transform("linked", lambda x: x["url"])),
        lambda u: U.is_dealer_link(u, site),
    )
    empty = F.lit("")
    every = F.concat(
        F.col("linked"),
        F.transform(extra, lambda u: F.struct(u.alias("url"), empty.alias("link"), empty.alias("block"))),
    )
    # Folding from the end keeps the last entry of every URL.
    start = F.array().cast("array<struct<url:string,link:string,block:string>>")
    last = F.aggregate(
        F.reverse(every),
        start,
        lambda acc, x: F.when(F.exists(acc, lambda y: y["url"] == x["url"]), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    found = rows.select(key, F.explode_outer(last).alias("x")).select(key, "x.url", "x.link", "x.block")
    found = found.filter(F.col("url").isNotNull())
    marked = F.coalesce(
        *[T.null_if_empty(H.first_text(F.col("link"), t)) for t in ("strong", "b", "h1", "h2", "h3")],
        T.null_if_empty(H.markup_text(H.element_with(F.col("link"), r"""data-testid=["'][^"']*title"""))),
        H.markup_text(F.col("link")),
    )
    own = H.markup_text(F.col("link"))
    card = T.let(
        H.markup_text(F.col("block")), lambda b: F.when(F.length(b) > 20, b).otherwise(own)
    )
    found = found.withColumn("__address", T.address_parts(card))
    return found.select(
        key,
        marked.alias("name"),
        "url",
        F.col("__address.street").alias("street"),
        F.col("__address.plz").alias("plz"),
        F.col("__address.city").alias("city"),
    )
