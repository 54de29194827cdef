"""Listing, financing, category and vendor records out of page payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import html as H
from lotwise.functions import numbers as N
from lotwise.functions import payload as J
from lotwise.functions import text as T
from lotwise.functions import titles
from lotwise.functions import urls as U
from lotwise.operators import audit
from lotwise.operators import listings as L
from lotwise.operators import location
from lotwise.operators.merge import fold_sightings
from lotwise.site import DEFAULT_SITE, Marketplace

_LISTING = (
    "id string, listingId string, title string, shortTitle string, subTitle string, "
    "make string, model string, vc string, segment string, category string, "
    "attr map<string,string>, isDamageCase boolean, hasDamage boolean, "
    "readyToDrive boolean, price string, p string, financePlans array<string>"
)

# Record field -> attribute keys, tried in order.
ATTRIBUTE_KEYS = {
    "Erstzulassung": ["fr", "firstRegistration"],
    "Kilometerstand": ["ml", "mileage"],
    "Kraftstoffart": ["ft", "fuel"],
    "Leistung": ["pw", "power"],
    "Anzahl Sitzplätze": ["sc", "seats"],
    "Getriebe": ["tr", "transmission"],
    "Schadstoffklasse": ["emc", "emissionClass"],
    "Farbe": ["ecol", "color"],
    "Baureihe": ["sr", "series"],
    "Ausstattungslinie": ["trim", "trimLine"],
    "Hubraum": ["cc", "ccm", "displacement"],
    "Anzahl der Türen": ["door", "doors"],
    "Anzahl der Fahrzeughalter": [
        "owners", "owner", "pvo", "pv", "vehicleOwners", "previousOwners", "numberOfOwners",
    ],
}
CO2_KEYS = ["co2", "co2Emissions", "co2Emission", "co₂", "envkvCo2"]
FINANCE_KEYS = {
    "Anzahlung": "downPayment",
    "Jährliche Kilometerleistung": "yearlyMileage",
    "Schlussrate": "finalInstallment",
    "Fester Sollzins p.a.": "interestRateNominal",
    "Effektiver Jahreszins": "interestRateEffective",
    "Gesamtzins": "totalInterest",
    "Gesamtbetrag": "totalAmount",
}
COUNT_KEYS = [
    "count", "cnt", "numResults", "numResultsTotal", "resultCount", "resultsCount",
    "total", "hits",
]
REGION_KEYS = ["region", "state", "federalState", "addressRegion"]

LISTING_FIELDS = [
    "Markes", "Models", "Fahrzeugtyp", "Fahrzeugzustand", *ATTRIBUTE_KEYS,
    "CO₂-Emissionen", "Preis", "Fahrzeugtyp_Raw", "Vehicle_Category", "Financing", "Bank",
    "Darlehensvermittler", "Fahrzeugpreis", *FINANCE_KEYS, "Laufzeit",
]


def with_payloads(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the page's payload texts."""
    return pages.withColumn("payloads", J.payload_texts(F.col(html)))


def localized(c: Column) -> Column:
    """Text of a value that may be an object with a localized name."""

    def read(x: Column) -> Column:
        parts = [F.get_json_object(x, f"$.{k}") for k in ("localized", "name", "value", "id")]
        return F.when(T.text(x).startswith("{"), T.first_present(*parts)).otherwise(
            T.without_placeholder(x)
        )

    return T.let(c, read)


def meaningful_strings(json_text: Column, holding: str | None = None) -> Column:
    """String values of an object that read like content, cleaned, in order; ``holding`` as in :func:`J.string_leaves`."""
    cleaned = F.transform(J.string_leaves(json_text, holding), lambda s: T.clean_text(s))
    return F.filter(
        cleaned,
        lambda s: (s != "")
        & ~s.isin("$undefined", "undefined", "null")
        & ~s.contains("__")
        & ~s.startswith("$")
        & ~F.lower(s).contains("module")
        & ~s.contains("classistatic")
        & ~s.rlike(r"^[0-9a-fA-F-]{20,}$")
        & ~s.startswith("listing-")
        & ~s.startswith("srp/"),
    )


def search_listings(pages: DataFrame, key: str) -> DataFrame:
    """Raw listings of all search results: one row per listing, in page order."""
    objects = J.objects_with(F.col("payloads"), ["searchResults"], members=["searchResults"])
    rows = pages.select(key, F.posexplode_outer(objects).alias("object_pos", "object"))
    parsed = F.from_json("object", "searchResults struct<listings array<string>>")
    return (
        rows.select(key, "object_pos", F.posexplode_outer(parsed["searchResults"]["listings"]).alias("pos", "listing"))
        .filter(F.col("listing").startswith("{"))
    )


def listing_names(parsed: Column) -> Column:
    """``make`` and ``model`` of a parsed search listing; the title is split only where the listing does not state both."""
    title = T.first_present(
        parsed["title"],
        F.concat_ws(
            " ",
            F.when(T.without_placeholder(parsed["shortTitle"]) != "", parsed["shortTitle"]),
            F.when(T.without_placeholder(parsed["subTitle"]) != "", parsed["subTitle"]),
        ),
    )
    given = {
        "title": title, "make": localized(parsed["make"]), "model": localized(parsed["model"]),
        "subtitle": T.without_placeholder(parsed["subTitle"]),
    }

    def choose(x: Column) -> Column:
        make, title = x["make"], x["title"]
        led = (title != "") & (make != "") & F.lower(title).startswith(F.lower(make))
        stated = F.when(led, T.clean_text(F.substring(title, F.length(make) + 1, F.length(title)))).when(
            (x["model"] != "") | (x["subtitle"] != ""), T.clean_text(F.concat_ws(" ", x["model"], x["subtitle"]))
        )

        def split(s: Column) -> Column:
            return F.struct(F.when(make != "", make).otherwise(s["brand"]).alias("make"), F.coalesce(stated, s["model"]).alias("model"))

        whole = (make != "") & (led | (x["model"] != "") | (x["subtitle"] != ""))
        return F.when(whole, F.struct(make.alias("make"), stated.alias("model"))).otherwise(T.let(titles.split_title(title), split))

    return T.let(F.struct(*[c.alias(n) for n, c in given.items()]), choose)


def first_plan(plans: Column) -> Column:
    """The first financing plan that is an object: whether ``there`` is one, its ``offer`` and what that has ``local``."""
    plan = F.get(F.filter(plans, lambda p: p.startswith("{")), F.lit(0))

    def opened(p: Column) -> Column:
        offer = F.from_json(p, "offer map<string,string>")["offer"]
        return T.let(offer, lambda o: F.struct(p.isNotNull().alias("there"), o.alias("offer"), F.from_json(o["localized"], "map<string,string>").alias("local")))

    return T.let(plan, opened)


def listing_columns(
    parsed: Column, raw: Column, site: Marketplace = DEFAULT_SITE, names: Column | None = None, plan: Column | None = None
) -> dict[str, Column]:
    """Record fields of one parsed search listing; empty where absent.

    ``parsed`` is the listing read with the listing schema, ``raw`` its JSON text.  ``names`` and
    ``plan`` are :func:`listing_names` and :func:`first_plan` where they are columns already.
    """
    attr = parsed["attr"]
    listing_id = T.first_filled(parsed["id"], parsed["listingId"])
    names = listing_names(parsed) if names is None else names
    body = T.first_present(parsed["category"], attr["c"])
    category = T.first_filled(parsed["vc"], parsed["segment"])
    price = parsed["price"]
    cost = F.when(
        T.text(price).startswith("{"),
        T.first_present(
            F.get_json_object(price, "$.grs.localized"), F.get_json_object(price, "$.nt.localized")
        ),
    ).otherwise(T.first_present(parsed["p"], price))
    by_text = T.first_match(
        F.array_join(meaningful_strings(raw, "g/km"), " • "), r"\b\d{1,4}\s*g/km\b"
    )
    co2 = T.first_filled(T.first_present(*[attr[k] for k in CO2_KEYS]), by_text)
    columns = {
        "Vehicle_URL": F.when(U.is_listing_id(listing_id), U.vehicle_url(listing_id, site)).otherwise(F.lit("")),
        "Markes": names["make"],
        "Models": names["model"],
        "Fahrzeugtyp": L.listing_type(category, body),
        "Fahrzeugzustand": L.listing_condition(
            parsed["isDamageCase"], parsed["hasDamage"], parsed["readyToDrive"]
        ),
        **{f: T.first_present(*[attr[k] for k in keys]) for f, keys in ATTRIBUTE_KEYS.items()},
        "CO₂-Emissionen": co2,
        "Preis": cost,
        "Fahrzeugtyp_Raw": body,
        "Vehicle_Category": T.first_present(parsed["vc"], parsed["segment"]),
    }
    columns.update(financing_columns(first_plan(parsed["financePlans"]) if plan is None else plan, cost))
    return columns


def financing_columns(plan: Column, vehicle_price: Column) -> dict[str, Column]:
    """Financing fields of a listing's :func:`first_plan`; localized before raw."""
    offer, local = plan["offer"], plan["local"]

    def value(name: str) -> Column:
        return T.first_present(local[name], offer[name])

    return {
        "Financing": T.monthly_rate(value("monthlyInstallment")),
        "Bank": T.first_present(offer["bankName"]),
        "Darlehensvermittler": T.first_present(offer["loanBroker"]),
        "Fahrzeugpreis": F.when(plan["there"], vehicle_price).otherwise(F.lit("")),
        **{f: value(k) for f, k in FINANCE_KEYS.items()},
        "Laufzeit": T.credit_term(T.first_filled(local["creditTerm"], offer["creditTerm"])),
    }


# -- loose listing objects -------------------------------------------------------

# Strings that are never a listing title.
NO_TITLES = [
    "default", "Header", "ResultList", "SemiTrailer", "Trailer", "Car", "Truck",
    "Motorbike", "Vehicle",
]


def choose_title(strings: Column) -> Column:
    return F.coalesce(
        F.get(
            F.filter(
                strings,
                lambda s: ~s.isin(NO_TITLES)
                & ~T.contains_any(s, ["€", "MwSt", "data:image"])
                & ~s.rlike(r"(?U)\b(?:EZ|km|kW|PS)\b")
                & F.length(s).between(4, 140)
                & s.rlike("[A-Za-zÄÖÜäöüß]"),
            ),
            F.lit(0),
        ),
        F.lit(""),
    )


def choose_price(strings: Column) -> Column:
    prices = F.transform(strings, lambda s: F.regexp_extract(s, f"(?U){T.led(fixed.PRICE_TEXT_PATTERN)}", 0))
    return T.clean_text(F.get(F.filter(prices, lambda p: p != ""), F.lit(0)))


def choose_attributes(strings: Column) -> Column:
    return F.array_join(
        F.filter(
            strings,
            lambda s: s.contains("•")
            | s.rlike(r"(?U)\b(?:EZ|km|kW|PS|Benzin|Diesel|Automatik)\b"),
        ),
        " • ",
    )


def attribute_line_columns(attrs: Column, km: str) -> dict[str, Column]:
    """Fields that a card's attribute line states."""
    parts = titles.attribute_fields(attrs)
    return {
        "Kilometerstand": T.first_match(attrs, km),
        "Erstzulassung": F.replace(T.first_match(attrs, fixed.DATE_PATTERN), F.lit("EZ "), F.lit("")),
        "Leistung": T.first_match(attrs, fixed.POWER_PATTERN),
        "Kraftstoffart": T.first_match(attrs, fixed.FUEL_PATTERN),
        "Getriebe": T.first_match(attrs, fixed.GEAR_PATTERN),
        "Fahrzeugtyp": parts["type"],
        "Fahrzeugzustand": parts["condition"],
    }


def loose_columns(raw: Column, strings: Column, site: Marketplace = DEFAULT_SITE) -> dict[str, Column]:
    """Record fields guessed from the strings of an object with a listing id."""
    listing_id = F.get_json_object(raw, "$.listingId")
    attrs = choose_attributes(strings)
    split = titles.split_title(choose_title(strings))
    line = attribute_line_columns(attrs, r"\b[\d.]+\s*km\b")
    named = T.first_match(attrs, fixed.CONDITION_PATTERN)
    return {
        "Vehicle_URL": F.when(U.is_listing_id(listing_id), U.vehicle_url(listing_id, site)).otherwise(F.lit("")),
        "Markes": split["brand"],
        "Models": split["model"],
        "Preis": choose_price(strings),
        "Schadstoffklasse": T.first_match(attrs, fixed.EMISSION_CLASS_PATTERN),
        **line,
        "Fahrzeugzustand": F.when(line["Fahrzeugzustand"] != "", line["Fahrzeugzustand"]).otherwise(named),
    }


def listing_sightings(pages: DataFrame, key: str, site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """Every sighting of a listing in page payloads, in payload order.

    One walk per page hands out search results and objects with a listing id; each
    object gives its search listings first, then itself.
    """
    objects = J.objects_with(F.col("payloads"), ["searchResults", "listingId"])
    rows = pages.select(key, F.posexplode_outer(objects).alias("object_pos", "object"))
    rows = rows.withColumn("found", F.from_json("object", "searchResults struct<listings array<string>>, listingId string"))
    found = F.col("found")
    inner = F.transform(
        F.filter(
            F.coalesce(found["searchResults"]["listings"], F.array().cast("array<string>")),
            lambda s: s.startswith("{"),
        ),
        lambda s: F.struct(F.lit(True).alias("search"), s.alias("raw")),
    )
    itself = F.when(
        U.is_listing_id(found["listingId"]),
        F.array(F.struct(F.lit(False).alias("search"), F.col("object").alias("raw"))),
    ).otherwise(F.array().cast("array<struct<search:boolean,raw:string>>"))
    items = rows.select(key, "object_pos", F.posexplode_outer(F.concat(inner, itself)).alias("pos", "item"))
    items = items.select(
        key,
        (F.shiftleft(F.col("object_pos").cast("bigint"), 32) + F.col("pos")).alias("ord"),
        F.col("item.search").alias("search"),
        F.col("item.raw").alias("raw"),
    )
    items = items.withColumns(
        {
            "parsed": F.when(F.col("search"), F.from_json("raw", _LISTING)),
            "strings": F.when(~F.col("search"), meaningful_strings(F.col("raw"))),
        }
    )
    parsed = F.col("parsed")
    items = items.withColumns(
        {"names": F.when(F.col("search"), listing_names(parsed)), "plan": F.when(F.col("search"), first_plan(parsed["financePlans"]))}
    )
    from_search = listing_columns(parsed, F.col("raw"), site, F.col("names"), F.col("plan"))
    from_strings = loose_columns(F.col("raw"), F.col("strings"), site)
    empty = F.lit("")
    fields = ["Vehicle_URL", *LISTING_FIELDS]
    record = F.struct(
        *[F.when(F.col("search"), from_search.get(f, empty)).otherwise(from_strings.get(f, empty)).alias(f"f{i}") for i, f in enumerate(fields)]
    )
    # Out of an array of one, as filters on plain expressions would compute them a second time.
    rows = items.select(key, "ord", F.array(record).alias("records")).select(key, "ord", F.explode_outer("records").alias("r"))
    return rows.select(key, "ord", *[F.col(f"r.f{i}").alias(f) for i, f in enumerate(fields)]).filter(F.col("Vehicle_URL") != "")


def listing_records(pages: DataFrame, key: str, site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """One record per page and listing URL, its sightings folded."""
    return fold_sightings(listing_sightings(pages, key, site), [key, "Vehicle_URL"], "ord", LISTING_FIELDS)


def detail_links(pages: DataFrame, key: str, html: str = "html", site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """Detail URLs per page: links, then payload ids, then ids in the raw page."""
    hrefs = F.transform(
        F.filter(H.anchors(F.col(html)), lambda a: U.is_vehicle_href(a["href"])),
        lambda a: U.vehicle_url(a["href"], site),
    )
    ids = F.filter(
        F.transform(
            J.objects_with(F.col("payloads"), ["listingId"]),
            lambda o: T.text(F.get_json_object(o, "$.listingId")),
        ),
        lambda i: U.is_listing_id(i),
    )
    raw_ids = F.regexp_extract_all(T.text(F.col(html)), F.lit(r'"listingId"\s*:\s*(\d{5,})'), F.lit(1))
    rows = pages.withColumns({"__hrefs": hrefs, "__ids": ids, "__raw": raw_ids})
    urls = F.array_distinct(
        F.concat(
            F.col("__hrefs"),
            F.transform(F.concat(F.col("__ids"), F.col("__raw")), lambda i: U.vehicle_url(i, site)),
        )
    )
    return rows.select(key, F.posexplode_outer(urls).alias("pos", "url")).filter(
        F.col("url").isNotNull()
    )


# -- categories ---------------------------------------------------------------------


def _object_count(obj: Column) -> Column:
    counts = [N.count_value(_scalar(obj, k)) for k in COUNT_KEYS]
    return F.coalesce(*counts)


def _scalar(obj: Column, name: str) -> Column:
    """Value of a key as text; objects, lists and booleans give NULL."""
    return T.let(
        F.get_json_object(obj, f"$.{name}"),
        lambda value: F.when(~value.rlike(r"^(?:[\[{]|true$|false$)"), value),
    )


def _option(value: Column, label: Column, count: Column, url: Column, rank: int) -> Column:
    return F.struct(
        T.without_placeholder(value).alias("value"),
        T.without_placeholder(label).alias("label"),
        count.alias("count"),
        T.without_placeholder(url).alias("url"),
        F.lit(rank).alias("rank"),
    )


def _category_candidates(html: Column, objects: Column, positive: bool) -> Column:
    none, empty = F.lit(None).cast("bigint"), F.lit("")
    # Sidebar inputs inside their labels.
    boxes = F.filter(
        F.regexp_extract_all(
            T.text(html), F.lit(r"(?is)<label\b[^>]*>.*?</label\s*>"), F.lit(0)
        ),
        lambda box: F.lower(box).contains("<input"),
    )

    def sidebar(box: Column) -> Column:
        value = H.attribute(F.regexp_extract(box, r"(?is)<input\b[^>]*>", 0), "value")
        words = H.markup_text(box)
        count = F.coalesce(N.category_count(words, value), N.count_in_brackets(words))
        chip = H.markup_text(H.element_with(box, r"""class=["'][^"']*vehicleCategoryChipLabel"""))
        label = F.when(chip != "", chip).otherwise(L.label_in_text(words, value))
        return _option(value, label, count, empty, 0)

    side = F.filter(
        F.transform(boxes, sidebar),
        lambda o: o["value"].isin(list(fixed.CATEGORY_LABELS)) & (o["count"] > 0),
    )

    def of_object(obj: Column) -> Column:
        count = _object_count(obj)
        label = T.first_present(*[_scalar(obj, k) for k in ("label", "name", "localized")])
        values = F.from_json(F.get_json_object(obj, "$.values"), "array<string>")
        options = F.from_json(F.get_json_object(obj, "$.options"), "array<string>")
        listed = (
            F.array().cast("array<struct<value:string,label:string,count:bigint,url:string,rank:int>>")
            if positive
            else F.coalesce(
                F.transform(values, lambda v: _option(v, empty, none, empty, 1)),
                F.array().cast("array<struct<value:string,label:string,count:bigint,url:string,rank:int>>"),
            )
        )
        chosen = F.coalesce(
            F.transform(
                F.filter(options, lambda o: o.startswith("{")),
                lambda o: _option(
                    _scalar(o, "value"),
                    T.first_present(*[_scalar(o, k) for k in ("label", "name", "localized")]),
                    _object_count(o),
                    empty,
                    1,
                ),
            ),
            F.array().cast("array<struct<value:string,label:string,count:bigint,url:string,rank:int>>"),
        )
        return F.concat(
            F.array(
                _option(_scalar(obj, "vc"), label, count, empty, 1),
                _option(_scalar(obj, "vehicleCategory"), label, count, empty, 1),
            ),
            listed,
            chosen,
        )

    def of_control(tag: Column) -> Column:
        head = F.regexp_extract(tag, r"(?is)^<\w+\b[^>]*>", 0)
        href = T.without_placeholder(
            T.first_filled(H.attribute(head, r"(?<!-)href"), H.attribute(head, "data-href"))
        )
        value, words = U.category_of_href(href), H.markup_text(tag)
        return F.struct(
            *[
                x.alias(n)
                for n, x in {
                    "value": F.when(words != "", value).otherwise(empty),
                    "label": L.label_in_text(words, value),
                    "count": N.category_count(words, value),
                    "url": href,
                    "rank": F.lit(2),
                }.items()
            ]
        )

    controls = F.regexp_extract_all(
        T.text(html), F.lit(r"(?is)<(a|button|label)\b[^>]*>.*?</\1\s*>"), F.lit(0)
    )
    others = F.concat(
        F.flatten(F.transform(objects, of_object)),
        F.transform(controls, of_control),
    )
    return F.when(F.size(side) > 0, side).otherwise(others)


_CATEGORY_KEYS = ["vc", "vehicleCategory", "values", "options"]


def category_options(
    pages: DataFrame, key: str, html: str = "html", *, require_positive_count: bool = False
) -> DataFrame:
    """Category filters per page with label, count and URL.

    Sidebar inputs win outright; repeats fill what the first find left open; zero
    counts drop.  A page has at most twelve categories, all kept in its row until
    the final explode.
    """
    rows = _with_options(pages, html, require_positive_count)
    return rows.select(key, F.posexplode_outer("__options").alias("place", "o")).select(
        key, "place", "o.value", "o.label", "o.count", "o.url"
    ).filter(F.col("value").isNotNull())


def _with_options(pages: DataFrame, html: str, require_positive_count: bool) -> DataFrame:
    """Pages with their payload objects (``__objects``) and category filters (``__options``)."""
    rows = pages.withColumn("__objects", J.objects_with(F.col("payloads"), _CATEGORY_KEYS))
    rows = rows.withColumn(
        "__all", _category_candidates(F.col(html), F.col("__objects"), require_positive_count)
    )
    usable = F.filter(
        F.transform(F.col("__all"), lambda o, i: F.struct(i.alias("pos"), o.alias("o"))),
        lambda x: x["o"]["value"].isin(list(fixed.CATEGORY_LABELS))
        & (
            (x["o"]["count"] > 0)
            if require_positive_count
            else F.coalesce(x["o"]["count"] > 0, F.lit(True))
        ),
    )
    rows = rows.withColumn("__use", usable)

    def of_value(value: Column) -> Column:
        mine = F.filter(F.col("__use"), lambda x: x["o"]["value"] == value)

        def first(name: str, empty: bool) -> Column:
            return F.get(
                F.filter(
                    F.transform(mine, lambda x: x["o"][name]),
                    lambda v: (v != "") if empty else v.isNotNull(),
                ),
                F.lit(0),
            )

        own = F.get(mine, F.lit(0))["o"]["label"]
        return F.struct(
            F.get(mine, F.lit(0))["pos"].alias("pos"),
            value.alias("value"),
            F.when(own != "", own).otherwise(L.category_label(value)).alias("label"),
            first("count", False).alias("count"),
            F.coalesce(first("url", True), F.lit("")).alias("url"),
        )

    codes = F.array(*[F.lit(c) for c in fixed.CATEGORY_LABELS])
    found = F.array_sort(F.filter(F.transform(codes, of_value), lambda o: o["pos"].isNotNull()))
    return rows.withColumn("__options", found).drop("__all", "__use")


def category_values(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Category codes per page with their place: counted options first, then all payload mentions.

    All of it is arrays of the page's own row: one walk over the payload, no shuffle.
    """
    rows = _with_options(pages, html, True)
    none = F.array().cast("array<string>")

    def mentions(obj: Column) -> Column:
        options = F.coalesce(F.from_json(F.get_json_object(obj, "$.options"), "array<string>"), none)
        return F.concat(
            F.array(_scalar(obj, "vc"), _scalar(obj, "vehicleCategory")),
            F.coalesce(F.from_json(F.get_json_object(obj, "$.values"), "array<string>"), none),
            F.transform(F.filter(options, lambda o: o.startswith("{")), lambda o: _scalar(o, "value")),
        )

    named = F.transform(F.flatten(F.transform("__objects", mentions)), lambda x: T.without_placeholder(x))
    every = F.concat(F.transform("__options", lambda o: o["value"]), F.coalesce(named, none))
    known = F.filter(every, lambda x: x.isin(list(fixed.CATEGORY_LABELS)))
    return rows.select(key, F.posexplode_outer(F.array_distinct(known)).alias("ord", "value")).filter(
        F.col("value").isNotNull()
    ).select(key, "value", F.col("ord").cast("bigint").alias("ord"))


# -- vendors --------------------------------------------------------------------------

_DEALER = (
    "dealerData struct<customerId string, uniqueIdentifier string, name string, email string, "
    "homepageUrl string, externalHomepageUrl string, location map<string,string>, "
    "legalData map<string,string>, phoneNumbers map<string,string>>, "
    "dealerHomepageData map<string,string>"
)
# Payload phone key -> vendor field; the later of two keys wins.
PHONE_KEYS = [
    ("phone", "Telephone Number"),
    ("phone2", "2. Telephone Number"),
    ("cellPhone", "MobilTelefon"),
    ("mobile", "MobilTelefon"),
    ("fax", "Fax Number"),
]
_IMPRINT_NUMBER = r"(?:\.|:)?\s*([+\d][+\d\s()./-]{5,})"
_LD_VENDOR = (
    "`@type` string, name string, telephone string, email string, url string, "
    "address struct<streetAddress string, postalCode string, addressLocality string, "
    "addressRegion string, addressCountry string>"
)


def _phone(c: Column) -> Column:
    def joined(parts: Column) -> Column:
        return T.phone_from_parts(parts["internationalPrefix"], parts["prefix"], parts["number"], parts["normalized"])

    parts = F.from_json(c, "internationalPrefix string, prefix string, number string, normalized string")
    return F.when(T.text(c).startswith("{"), T.let(parts, joined)).otherwise(T.without_placeholder(c))


def payload_vendor(objects: Column, site: Marketplace = DEFAULT_SITE) -> Column:
    """Vendor record of the first object with dealer data, gaps filled from the
    imprint.  NULL where the page has none."""
    def usable(o: Column) -> Column:
        return T.let(F.get_json_object(o, "$.dealerData"), lambda d: d.startswith("{") & (F.length(T.strip(d)) > 2))

    # The object is searched, read and its parts cleaned once each, whatever number of fields names them.
    raw = F.get(F.filter(objects, usable), F.lit(0))
    return T.let(raw, lambda o: F.when(o.isNotNull(), T.let(F.from_json(o, _DEALER), lambda data: _dealer_record(data, site))))


def _dealer_record(data: Column, site: Marketplace) -> Column:
    dealer, home = data["dealerData"], data["dealerHomepageData"]
    place, phones = dealer["location"], dealer["phoneNumbers"]
    by_field: dict[str, Column] = {}
    for key, name in PHONE_KEYS:
        found = T.null_if_empty(_phone(phones[key]))
        by_field[name] = F.coalesce(found, by_field[name]) if name in by_field else found

    def record(imprint: Column) -> Column:
        def imprint_number(word: str) -> Column:
            return T.null_if_empty(T.first_match(imprint, rf"\b{word}{_IMPRINT_NUMBER}", 1))

        return F.struct(
            T.without_placeholder(dealer["customerId"]).alias("customer_id"),
            T.without_placeholder(dealer["uniqueIdentifier"]).alias("unique_identifier"),
            T.without_placeholder(dealer["name"]).alias("name"),
            T.without_placeholder(place["street"]).alias("street"),
            T.without_placeholder(place["zipcode"]).alias("plz"),
            T.without_placeholder(place["city"]).alias("city"),
            T.first_present(*[place[k] for k in REGION_KEYS]).alias("region"),
            location.country_name(T.without_placeholder(place["country"])).alias("country"),
            T.first_filled(
                T.without_placeholder(dealer["email"]), F.regexp_extract(imprint, f"(?U){fixed.EMAIL_PATTERN}", 0)
            ).alias("email"),
            U.dealer_url(T.without_placeholder(dealer["homepageUrl"]), site).alias("url"),
            T.first_present(
                dealer["externalHomepageUrl"], home["userDefinedLink"], home["externalHomepageUrl"]
            ).alias("homepage"),
            F.coalesce(by_field["Telephone Number"], imprint_number("Telefon"), F.lit("")).alias("telephone"),
            F.coalesce(by_field["2. Telephone Number"], F.lit("")).alias("telephone2"),
            F.coalesce(by_field["MobilTelefon"], F.lit("")).alias("mobile"),
            F.coalesce(by_field["Fax Number"], imprint_number("Fax"), F.lit("")).alias("fax"),
        )

    return T.let(T.without_placeholder(dealer["legalData"]["imprint"]), record)


def ld_vendor(html: Column) -> Column:
    """Vendor record of the first fitting ld+json object; NULL where none."""
    item = F.get(
        F.filter(
            H.ld_json_items(html, _LD_VENDOR),
            lambda o: o["@type"].isin("AutoDealer", "LocalBusiness", "Store", "Organization"),
        ),
        F.lit(0),
    )
    clean = T.without_placeholder

    def record(o: Column) -> Column:
        place = o["address"]
        return F.struct(
            clean(o["name"]).alias("name"),
            clean(o["telephone"]).alias("telephone"),
            clean(o["email"]).alias("email"),
            clean(o["url"]).alias("url"),
            clean(place["streetAddress"]).alias("street"),
            clean(place["postalCode"]).alias("plz"),
            clean(place["addressLocality"]).alias("city"),
            clean(place["addressRegion"]).alias("region"),
            location.country_name(clean(place["addressCountry"])).alias("country"),
        )

    # The page is searched and its scripts are read once, not once for each field.
    return T.let(item, lambda o: F.when(o.isNotNull(), record(o)))


# Nouns that a page puts behind its number of listings.
COUNT_NOUNS = "Fahrzeuge|Angebote|Pkw|Lkw|Motorräder|Motorrad|Auflieger|Anhänger"


def inventory_count(html: Column, objects: Column) -> Column:
    """Number of listings that a vendor page states: payload total, then patterns
    over the page, then its text."""
    totals = F.filter(
        F.transform(objects, lambda o: _scalar(o, "numResultsTotal")), lambda t: t.rlike(r"^\d+$")
    )
    page = T.text(html)
    tries = [
        r'"numResultsTotal"\s*:\s*(\d+)',
        r"""data-testid=["']srp-header-title["'][^>]*>\s*(\d+)""",
        rf"\b(\d{{1,6}})\s+(?:{COUNT_NOUNS})\b",
        r"\((\d{1,6})\)",
    ]
    by_page = []
    for pattern in tries:
        found = T.match_or_null(page, T.insensitive(pattern), 1).try_cast("bigint")
        by_page.append(T.let(found, lambda n: F.when(n < 1_000_000, n)))
    by_text = T.match_or_null(
        H.markup_text(html),
        T.insensitive(r"\b(\d{1,6})\s+(?:Fahrzeuge|Angebote|Pkw|Lkw|Auflieger|Anhänger)\b"),
        1,
    ).try_cast("bigint")
    return F.coalesce(F.get(totals, F.lit(0)).try_cast("bigint"), *by_page, by_text)


_DEALER_FIELDS = [
    ("Händlername", "name"), ("Standort", "street"), ("PLZ", "plz"), ("Städte", "city"),
    ("Bundesland", "region"), ("Land", "country"),
]


def vendor_records(
    pages: DataFrame, key: str, html: str = "html", site: Marketplace = DEFAULT_SITE
) -> DataFrame:
    """One vendor record per page: page defaults, then payload, then ld+json, then
    the listing count and the corrected location.

    ``pages`` holds the page and may hold vendor columns found before.
    """
    rows = with_payloads(pages, html) if "payloads" not in pages.columns else pages
    read = ["dealerData", "dealerHomepageData", "numResultsTotal"]
    rows = rows.withColumn("__objects", J.objects_with(F.col("payloads"), ["dealerData", "numResultsTotal"], members=read))
    rows = rows.withColumns(
        {
            "__p": payload_vendor(F.col("__objects"), site),
            "__l": ld_vendor(F.col(html)),
            "__n": inventory_count(F.col(html), F.col("__objects")),
        }
    )
    have = set(pages.columns)
    pay, ld = F.col("__p"), F.col("__l")

    def own(name: str) -> Column:
        default = "Deutschland" if name == "Land" else ""
        return T.text(T.field(name)) if name in have else F.lit(default)

    columns = {f: T.first_filled(ld[s], pay[s], own(f)) for f, s in _DEALER_FIELDS}
    columns["Telephone Number"] = T.first_filled(
        T.phone_spacing(ld["telephone"]), pay["telephone"], own("Telephone Number")
    )
    columns["2. Telephone Number"] = T.first_filled(pay["telephone2"], own("2. Telephone Number"))
    columns["MobilTelefon"] = T.first_filled(pay["mobile"], own("MobilTelefon"))
    columns["Fax Number"] = T.first_filled(pay["fax"], own("Fax Number"))
    columns["Email ID"] = T.first_filled(ld["email"], pay["email"], own("Email ID"))
    columns["Hauptseite"] = T.first_filled(pay["homepage"], own("Hauptseite"))
    columns[site.link_field] = T.first_filled(pay["url"], own(site.link_field))
    count = fixed.VENDOR_COUNT_FIELD
    before = F.col(f"`{count}`").cast("bigint") if count in have else F.lit(None).cast("bigint")
    columns[count] = F.coalesce("__n", before)
    wanted = [f for f in site.vendor_fields if f in columns]
    return location.finalize_location(rows.select(key, *[columns[f].alias(f) for f in wanted]))


# -- contact blocks ---------------------------------------------------------------------

_DIGITS = r"([\+\d\s\(\)/-]+?)"
_CONTACT_PATTERNS = {
    "Telephone Number": rf"Tel\.?:\s*{_DIGITS}(?=\s*(?:Tel|Mobil|Fax|Wir|Bei|Internet|$))",
    "2. Telephone Number": rf"Tel\.?\s*2:\s*{_DIGITS}(?=\s*(?:Mobil|Fax|Wir|Bei|Internet|$))",
    "MobilTelefon": rf"Mobil\.?:\s*{_DIGITS}(?=\s*(?:Fax|Wir|Bei|Internet|$))",
    "Fax Number": rf"Fax\.?:\s*{_DIGITS}(?=\s*(?:Wir|Bei|Internet|Impressum|$))",
}


def contact_fields(html: Column, site: Marketplace = DEFAULT_SITE) -> dict[str, Column]:
    """Phones, homepage, address and e-mail that a contact block states."""
    words = H.markup_text(html)
    columns = {}
    for name, pattern in _CONTACT_PATTERNS.items():
        found = T.first_match(words, pattern, 1)
        columns[name] = F.regexp_extract(found, r"(?s)^.{6,}$", 0)
    links = H.anchors(html)

    def homepage(a: Column) -> Column:
        shown = F.replace(H.markup_text(a["markup"]), F.lit(" "), F.lit(""))
        outside = a["href"].startswith("http") & ~a["href"].contains(site.domain) & (F.length(a["href"]) > 10)
        return F.when(outside, a["href"]).when(
            shown.contains("www.") | shown.contains("http"),
            F.when(shown.startswith("http"), shown).otherwise(F.concat(F.lit("https://"), shown)),
        )

    columns["Hauptseite"] = F.coalesce(
        F.get(F.filter(F.transform(links, homepage), lambda h: h.isNotNull()), F.lit(0)), F.lit("")
    )
    columns["Standort"] = T.clean_text(
        F.regexp_extract(words, r"Adresse\s+(.*?)(?=\s*DE-|\s*Kontakt)", 1)
    )
    place = r"(?U)DE-(\d{5})\s+(\w[\w\s]*?)(?=\s*(?:Kontakt|Wir|Bei|$))"
    columns["PLZ"] = F.regexp_extract(words, place, 1)
    columns["Städte"] = T.clean_text(F.regexp_extract(words, place, 2))
    columns["Land"] = F.when(columns["PLZ"] != "", F.lit("Deutschland")).otherwise(F.lit(""))
    mails = F.filter(
        F.transform(
            F.filter(links, lambda a: a["href"].startswith("mailto:")),
            lambda a: T.strip(F.replace(a["href"], F.lit("mailto:"), F.lit(""))),
        ),
        lambda m: m.contains("@"),
    )
    columns["Email ID"] = F.coalesce(
        F.get(mails, F.lit(0)), F.regexp_extract(words, f"(?U){fixed.EMAIL_PATTERN}", 0)
    )
    return columns


# -- evidence ------------------------------------------------------------------------------


def payload_key_hits(listings: DataFrame, keys: list[str], raw: str = "listing") -> DataFrame:
    """Target keywords in the keys of raw listings: field, path and 300 characters."""
    words = sorted({w for ws in fixed.TARGET_KEYWORDS.values() for w in ws})
    found = J.keyed_values(F.array(F.col(raw)), words)
    rows = listings.select(*keys, F.posexplode_outer(found).alias("n", "v"))
    rows = rows.withColumn("field", F.explode_outer(audit.key_fields(F.col("v.key"))))
    return rows.filter(F.col("field").isNotNull()).select(
        *keys,
        "n",
        "field",
        F.col("v.path").alias("path"),
        F.substring(T.clean_text(F.col("v.value")), 1, 300).alias("value_excerpt"),
    )


#: Keyword hits that an audited page shows.
AUDIT_HITS = 100


def vendor_audit(pages: DataFrame, key: str, html: str = "html", site: Marketplace = DEFAULT_SITE) -> DataFrame:
    """Per page the listing count of the best of three sources, distinct detail URLs, and keyword hits.

    One projection: the payload is walked once, and all counts are sizes of arrays in the page's
    row.  ``hits`` holds the first hundred target keywords in the keys of the raw listings.
    """
    from lotwise.operators.cards import card_markup, card_url

    none = F.array().cast("array<string>")
    rows = pages.withColumn("__objects", F.coalesce(J.objects_with(F.col("payloads"), ["searchResults", "listingId"]), none))
    results = F.transform(
        F.filter("__objects", lambda o: o.contains('"searchResults"')),
        lambda o: F.coalesce(F.from_json(o, "searchResults struct<listings array<string>>")["searchResults"]["listings"], none),
    )
    text_of = lambda o, name: T.text(F.get_json_object(o, f"$.{name}"))
    rows = rows.withColumns(
        {
            "__raw": F.filter(F.flatten(results), lambda r: r.startswith("{")),
            "__own": F.transform("__objects", lambda o: text_of(o, "listingId")),
            "__cards": card_markup(html),
            "__hrefs": F.filter(H.anchors(F.col(html)), lambda a: U.is_vehicle_href(a["href"])),
            "__named": F.regexp_extract_all(T.text(F.col(html)), F.lit(r'"listingId"\s*:\s*(\d{5,})'), F.lit(1)),
        }
    )
    urls_of = lambda ids: F.transform(F.filter(ids, lambda i: U.is_listing_id(i)), lambda i: U.vehicle_url(i, site))
    searched = F.transform("__raw", lambda r: T.first_filled(F.get_json_object(r, "$.id"), F.get_json_object(r, "$.listingId")))
    rows = rows.withColumns(
        {
            "__records": F.array_distinct(urls_of(F.concat(searched, F.col("__own")))),
            "__links": F.concat(F.transform("__hrefs", lambda a: U.vehicle_url(a["href"], site)), urls_of(F.col("__named"))),
            "__card_urls": F.transform("__cards", lambda c: card_url(c, site)),
        }
    )
    urls = F.filter(F.array_distinct(F.concat("__records", "__links", "__card_urls")), lambda u: u.contains("details.html"))
    words = sorted({w for ws in fixed.TARGET_KEYWORDS.values() for w in ws})
    whole = F.concat(F.lit("["), F.array_join("__raw", ","), F.lit("]"))
    rows = rows.withColumn("__keys", F.coalesce(J.keyed_values(F.when(F.size("__raw") > 0, F.array(whole)), words), F.array().cast("array<struct<key:string,path:string,value:string>>")))

    def of_key(v: Column) -> Column:
        excerpt = F.substring(T.clean_text(v["value"]), 1, 300)
        return F.transform(
            audit.key_fields(v["key"]), lambda f: F.struct(f.alias("field"), v["path"].alias("path"), excerpt.alias("value_excerpt"))
        )

    return rows.select(
        key,
        F.greatest(F.size("__records"), F.size("__raw"), F.size("__cards")).cast("bigint").alias("listing_count"),
        F.size(urls).cast("bigint").alias("real_detail_url_count"),
        F.slice(F.flatten(F.transform("__keys", of_key)), 1, AUDIT_HITS).alias("hits"),
    )
