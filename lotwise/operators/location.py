"""Country and state of a vendor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import fixed
from lotwise.functions import text as T

_GERMANY = "Deutschland"
STATE_NAMES = sorted({state for _, _, state in fixed.POSTCODE_RANGES})


def country_name(c: Column | str) -> Column:
    """Country code or name to its German name; unknown text stays."""


    def known(t: Column) -> Column:
        upper = F.upper(t)
        names = [
            F.when(upper.isin(words), F.lit(name)) for name, words in fixed.COUNTRY_WORDS.items()
        ]
        return F.coalesce(*names, t)

    return T.let(T.clean_text(c), known)


def is_germany(c: Column | str) -> Column:
    return country_name(c) == _GERMANY


def state_of_postcode(c: Column | str) -> Column:
    """State by postcode, empty where the text holds none or the range has none.

    All ranges start and end on full thousands, so the range join is a look-up in
    a literal array of 100 states.
    """
    by_thousand = [""] * 100
    for first, last, state in fixed.POSTCODE_RANGES:
        thousands = range(first // 1000, last // 1000 + 1)
        by_thousand[thousands.start : thousands.stop] = [state] * len(thousands)
    states = F.array(*[F.lit(s) for s in by_thousand])
    thousand = T.match_or_null(T.clean_text(c), r"(?U)\b(\d{2})\d{3}\b", 1).try_cast("int")
    return F.coalesce(F.get(states, thousand), F.lit(""))


def actual_region(country: Column, postcode: Column, region: Column) -> Column:
    """Postcode state inside Germany, else the given region."""
    given = T.clean_text(region)
    by_postcode = T.null_if_empty(state_of_postcode(postcode))
    return F.when(is_germany(country), F.coalesce(by_postcode, given)).otherwise(given)


def finalize_location(df: DataFrame) -> DataFrame:
    """Land normalised, Bundesland corrected; German states abroad are blanked."""
    country = country_name("Land")
    region = T.clean_text("Bundesland")
    abroad = F.when(region.isin(STATE_NAMES), F.lit("")).otherwise(region)
    return df.withColumns(
        {
            "Bundesland": F.when(
                country == _GERMANY, actual_region(F.col("Land"), F.col("PLZ"), region)
            ).otherwise(abroad),
            "Land": country,
        }
    )
