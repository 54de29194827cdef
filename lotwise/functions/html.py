"""Saved pages as columns: text, elements, links, label/value pairs.

Pages are read with patterns inside the JVM; a page is one row and everything
found in it stays in arrays of that row, so nothing in this module shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions import text as T

# Named entities that listing pages use; the ampersand comes last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&euro;": "€", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä",
    "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&eacute;": "é", "&euml;": "ë",
    "&egrave;": "è", "&agrave;": "à", "&sup2;": "²", "&sup3;": "³", "&deg;": "°",
    "&bull;": "•", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&copy;": "©",
    "&reg;": "®", "&shy;": "\u00ad", "&amp;": "&",
}

_HIDDEN = r"(?is)<(?=[!st])(?:!--.*?-->|(script|style|template)\b.*?</\1\s*>)"
# A script's content up to its end tag, passed over from one "<" to the next.
_SCRIPT_BODY = r"([^<]*+(?:<(?!/script>)[^<]*+)*+)</script>"
# Hidden parts, and tags, which may hold such parts and other "<"; neighbours and the blanks behind them are one run.
_MARKUP = (
    r"(?is)(?:<(?:(?=[!st])(?:!--.*?-->|(script|style|template)\b.*?</\1\s*+>)"
    r"|/?[a-z!][^<>]*+(?:<(?:(?=[!st])(?:!--.*?-->|(script|style|template)\b.*?</\2\s*+>))?+[^<>]*+)*+>)\s*+)++"
)


def _numeric_entities(t: Column, pattern: str, prefix: str, base: int) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))

    def put(acc: Column, code: Column) -> Column:
        digits = code if base == 16 else F.hex(code.cast("bigint"))
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        return F.replace(acc, F.concat(F.lit(prefix), code, F.lit(";")), char)

    return F.aggregate(codes, t, put)


def unescape(c: Column) -> Column:
    """Named and numeric character references resolved."""


    def numeric(t: Column) -> Column:
        hexadecimal = T.let(
            t, lambda x: _numeric_entities(x, r"&#x([0-9a-fA-F]{1,6});", "&#x", 16)
        )
        return T.let(hexadecimal, lambda x: _numeric_entities(x, r"&#(\d{1,7});", "&#", 10))

    def resolve(t: Column) -> Column:
        return F.when(t.contains("&"), T.let(F.when(t.contains("&#"), numeric(t)).otherwise(t), named)).otherwise(t)

    def named(t: Column) -> Column:
        # Only the entities that the text holds are replaced; none but the ampersand, which comes last, can make another.
        table = T.literal_map(ENTITIES)
        there = F.array_distinct(F.regexp_extract_all(t, F.lit("&[A-Za-z]+[23]?;"), F.lit(0)))
        others = F.filter(there, lambda e: e != "&amp;")
        plain = F.aggregate(others, t, lambda acc, e: F.replace(acc, e, F.coalesce(table[e], e)))
        return F.replace(plain, F.lit("&amp;"), F.lit("&"))

    return T.let(c, resolve)


def markup_text(c: Column) -> Column:
    """Visible text: comments, scripts and styles dropped, tags become blanks."""
    def visible(t: Column) -> Column:
        shown = F.when(t.contains("<"), F.regexp_replace(t, _MARKUP, " ")).otherwise(t)
        return F.when(t.contains("<") | t.contains("&"), unescape(shown)).otherwise(t)

    return T.clean_text(T.let(T.text(c), visible))


def inner_markup(html: Column, tag: str) -> Column:
    """Contents of every element of a tag, as markup."""
    return F.regexp_extract_all(
        T.text(html), F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>"), F.lit(1)
    )


def first_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag; empty where none."""
    return markup_text(
        F.regexp_extract(T.text(html), rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>", 1)
    )


def attribute(markup: Column, name: str) -> Column:
    """Attribute value in the first tag that has it; empty where none."""
    pattern = rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def value(found: Column) -> Column:
        quoted = found.startswith('"') | found.startswith("'")
        return F.when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)

    return unescape(T.let(F.regexp_extract(markup, pattern, 1), value))


def element_with(html: Column, condition: str) -> Column:
    """Markup inside the first element whose tag meets an attribute pattern.

    Markup that holds the attribute nowhere is passed over by one search for it.
    """
    markup = T.text(html)
    found = F.regexp_extract(markup, rf"(?is)<([a-z][a-z0-9]*)\b[^>]*{condition}[^>]*>(.*?)</\1\s*>", 2)
    return F.when(markup.rlike(f"(?is){condition}"), found).otherwise(F.lit(""))


def anchors(html: Column) -> Column:
    """Links in page order as (href, markup)."""
    tags = F.regexp_extract_all(T.text(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    links = F.transform(
        tags, lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href").alias("href"), a.alias("markup"))
    )
    return F.filter(links, lambda x: x["href"] != "")


def scripts(html: Column) -> Column:
    return F.regexp_extract_all(T.text(html), F.lit(rf"(?is)<script[^>]*>{_SCRIPT_BODY}"), F.lit(1))


def ld_json_items(html: Column, schema: str) -> Column:
    """Objects of all ld+json scripts, parsed; a script holds one or a list."""
    texts = F.transform(
        F.regexp_extract_all(
            T.text(html),
            F.lit(rf"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>{_SCRIPT_BODY}"""),
            F.lit(1),
        ),
        lambda s: T.strip(s),
    )
    lists = F.transform(texts, lambda s: F.regexp_replace(s, r"(?s)^([^\[].*)$", r"[$1]"))
    parsed = F.transform(lists, lambda s: F.from_json(s, f"array<struct<{schema}>>"))
    return F.filter(F.flatten(F.filter(parsed, lambda a: a.isNotNull())), lambda o: o.isNotNull())


def _pair(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def without_colon(c: Column) -> Column:
    return F.rtrim(T.clean_text(c), F.lit(":"))


def definition_pairs(html: Column) -> Column:
    """Every ``dt`` with the next ``dd`` of its list."""
    tokens = F.transform(
        F.regexp_extract_all(
            T.text(html), F.lit(r"(?is)<(?:d[td]\b[^>]*+>[^<]*+(?:<(?!/d[td]\s*+>)[^<]*+)*+</d[td]\s*+>|/dl\s*+>)"), F.lit(0)
        ),
        lambda t: F.struct(
            F.lower(F.substring(t, 2, 2)).alias("kind"),  # dt, dd, or the slash of a list's end
            markup_text(F.regexp_extract(t, r"(?s)^<[^>]*>(.*)<[^<]*$", 1)).alias("text"),
        ),
    )
    # A term takes the first definition behind it, over other terms, but not over a list's end.
    def pairs(all_tokens: Column) -> Column:
        def following(i: Column) -> Column:
            rest = F.filter(F.slice(all_tokens, i + 2, F.size(all_tokens)), lambda t: t["kind"] != "dt")
            return F.get(rest, F.lit(0))

        def pair(t: Column, i: Column) -> Column:
            value = T.let(following(i), lambda n: F.when(n["kind"] == "dd", n["text"]).otherwise(F.lit("")))
            return F.when(t["kind"] == "dt", _pair(F.rtrim(t["text"], F.lit(":")), value))

        return F.array_compact(F.transform(all_tokens, pair))

    return T.let(tokens, pairs)


def table_pairs(html: Column) -> Column:
    """First two cells of every table row that has two."""
    rows = F.regexp_extract_all(T.text(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.transform(
        rows,
        lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1)),
    )
    return F.transform(
        F.filter(cells, lambda c: F.size(c) >= 2),
        lambda c: _pair(F.rtrim(markup_text(F.get(c, F.lit(0))), F.lit(":")), markup_text(F.get(c, F.lit(1)))),
    )


def leaf_texts(html: Column) -> Column:
    """Texts of the elements without nested markup, in page order."""
    visible = F.regexp_replace(T.text(html), _HIDDEN, " ")
    found = F.regexp_extract_all(
        visible, F.lit(r"(?is)<([a-z][a-z0-9]*)\b[^>]*>([^<]*)</\1\s*>"), F.lit(2)
    )
    return F.transform(found, lambda inner: T.clean_text(unescape(inner)))  # no markup is left in it
