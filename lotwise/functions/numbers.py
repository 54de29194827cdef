"""Numbers out of German-formatted text.  Pure columns, NULL where nothing parses.

``ready=True`` says the text went through ``normalize_text`` already, so a job that
normalises a row once does not pay for it again in every parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T


def _ready(c: Column | str, ready: bool) -> Column:
    return T.col(c) if ready else T.normalize_text(c)


class Parser:
    """A number out of a text in two steps: the piece of text that holds it, and its value.

    As a function it does both.  A job stages the pieces as columns first: the value names its
    piece several times, and a staged column is computed once and stays in generated code.
    """

    def __init__(self, piece: Callable[[Column], Column], value: Callable[[Column], Column], doc: str):
        self.piece, self.value, self.__doc__ = piece, value, doc

    def __call__(self, c: Column | str, ready: bool = False) -> Column:
        return T.let(self.piece(_ready(c, ready)), self.value)


def _double(piece: Column) -> Column:
    return F.nullif(piece, F.lit("")).try_cast("double")


def _whole(piece: Column) -> Column:
    return F.nullif(piece, F.lit("")).try_cast("bigint")


def _extract(pattern: str, group: int) -> Callable[[Column], Column]:
    return lambda c: F.regexp_extract(c, pattern, group)


def _amount(run: Column) -> Column:
    """Value of one digit run; the separators decide what is a thousands mark."""
    comma, dot = run.contains(","), run.contains(".")
    last_comma = F.length(F.substring_index(run, ",", -1))
    last_dot = F.length(F.substring_index(run, ".", -1))
    return _double(
        F.when(comma & dot, F.replace(F.replace(run, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & (last_comma == 3), F.replace(run, F.lit(","), F.lit("")))
        .when(comma, F.replace(run, F.lit(","), F.lit(".")))
        .when(dot & (last_dot == 3), F.replace(run, F.lit("."), F.lit("")))
        .otherwise(run)
    )


def _percentage(run: Column) -> Column:
    german = F.replace(F.replace(run, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _double(F.when(run.contains(","), german).otherwise(run))


def _decimal(piece: Column) -> Column:
    return _double(F.replace(piece, F.lit(","), F.lit(".")))


def _first_number(c: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(c, r"[\d.,]+", 0), fixed.MONEY_PATTERN, 0)


money = Parser(
    _extract(fixed.MONEY_PATTERN, 0), _amount,
    "First amount in a price text.  One decimal digit is not an amount's decimal part, so ``3.5`` reads as 3.",
)
number = Parser(_first_number, _amount, "First run of digits, dots and commas, read as money.")
whole = Parser(_extract(r"\d+", 0), _whole, "First whole number anywhere.")
leading_whole = Parser(_extract(r"^\d+", 0), _whole, "Whole number at the start only.")
kilowatts = Parser(_extract(r"(\d+(?:[.,]\d+)?)\s*kW", 1), _decimal, "Power in kW.")
horsepower = Parser(_extract(r"(\d+(?:[.,]\d+)?)\s*PS", 1), _decimal, "Power in PS.")
percent = Parser(
    _extract(r"([\d,.]+)\s*%", 1), _percentage, "Percentage; dots are thousands marks only if a comma is there too."
)
year = Parser(_extract(r"\d{4}", 0), _whole, "First four digits.")
month = Parser(
    _extract(r"(?U)\b(0?[1-9]|1[0-2])[/.-]\d{4}\b", 1), _whole, "Month 1 to 12 in front of a four-digit year."
)
months = Parser(_extract(r"\d+", 0), _whole, "A duration, given in months.")


def count_value(c: Column | str) -> Column:
    """Result count with thousands marks; text forms of booleans are no count."""
    run = F.regexp_extract(T.clean_text(c), r"\d[\d.\s]*", 0)
    return _whole(F.regexp_replace(run, r"\D", ""))


def count_in_brackets(c: Column | str) -> Column:
    """Last count in round or square brackets."""
    runs = F.regexp_extract_all(
        T.clean_text(c), F.lit(r"[\(\[]\s*(\d{1,6}(?:[.\s]\d{3})*)\s*[\)\]]"), F.lit(1)
    )
    return count_value(F.get(F.reverse(runs), F.lit(0)))


_COUNT_RUN = r"(\d{1,6}(?:[.\s]\d{3})*)"


def category_aliases(value: str) -> list[str]:
    names = [value, fixed.CATEGORY_LABELS.get(value, ""), *fixed.CATEGORY_ALIASES.get(value, [])]
    return [name for name in dict.fromkeys(names) if name]


def category_count(c: Column | str, value: Column) -> Column:
    """Count standing next to any name of the category, on either side."""
    return count_value(
        T.let(
            F.struct(T.clean_text(c).alias("t"), value.alias("v")),
            lambda x: _category_run(x["t"], x["v"]),
        )
    )


def _category_run(t: Column, value: Column) -> Column:
    run = F.lit(None).cast("string")
    for code in fixed.CATEGORY_LABELS:
        names = dict.fromkeys(alias.lower() for alias in category_aliases(code))
        tries = [
            T.match_or_null(t, T.insensitive(pattern), 1)
            for name in map(T.quote, names)
            for pattern in (
                rf"\b{name}\b\s*[\(\[]?\s*{_COUNT_RUN}",
                rf"{_COUNT_RUN}\s*\b{name}\b",
            )
        ]
        run = F.when(value == code, F.coalesce(*tries)).otherwise(run)
    return run


def price_per_kilowatt(price: Column, kw: Column) -> Column:
    """NULL for zero power, where float arithmetic would give infinity."""
    return F.try_divide(price, kw)


def price_per_kilometre(price: Column, km: Column) -> Column:
    return F.try_divide(price, km + F.lit(1))
