"""Scalar functions under names in SQL.

Temporary SQL functions with plain SQL bodies; Catalyst inlines them like any other
expression.  They give the same results as the column functions of this package
(the tests hold the two together).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lotwise import fixed
from lotwise.functions import text as T


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: list[str]) -> str:
    return ", ".join(_quoted(w) for w in words)


def definitions() -> dict[str, tuple[str, str]]:
    """Name -> (result type, SQL body over the text ``x``), in order of use."""
    run = "CASE WHEN contains(x, ',') AND contains(x, '.') THEN replace(replace(x, '.', ''), ',', '.') " \
        "WHEN contains(x, ',') AND length(substring_index(x, ',', -1)) = 3 THEN replace(x, ',', '') " \
        "WHEN contains(x, ',') THEN replace(x, ',', '.') " \
        "WHEN contains(x, '.') AND length(substring_index(x, '.', -1)) = 3 THEN replace(x, '.', '') ELSE x END"
    money = _quoted(fixed.MONEY_PATTERN)
    percent = "CASE WHEN contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.') ELSE x END"
    states = " ".join(
        f"WHEN x BETWEEN '{a // 1000:02d}' AND '{b // 1000:02d}' THEN '{state}'" for a, b, state in fixed.POSTCODE_RANGES
    )
    countries = " ".join(
        f"WHEN upper(clean_text(x)) IN ({_words(words)}) THEN '{name}'"
        for name, words in fixed.COUNTRY_WORDS.items()
    )

    def unit(name: str) -> str:
        pattern = _quoted(rf"(\d+(?:[.,]\d+)?)\s*{name}")
        return f"try_cast(nullif(replace(regexp_extract(normalize_text(x), {pattern}, 1), ',', '.'), '') AS DOUBLE)"

    month = _quoted(r"(?U)\b(0?[1-9]|1[0-2])[/.-]\d{4}\b")
    return {
        "clean_text": ("STRING", f"trim(regexp_replace(coalesce(x, ''), {_quoted(T._BLANKS)}, '$1 '))"),
        "normalize_text": (
            "STRING",
            f"CASE WHEN clean_text(x) IN ({_words(fixed.NULL_WORDS)}) THEN '' ELSE clean_text(x) END",
        ),
        "number_of_run": ("DOUBLE", f"try_cast(nullif({run}, '') AS DOUBLE)"),
        "parse_money_de": ("DOUBLE", f"number_of_run(regexp_extract(normalize_text(x), {money}, 0))"),
        "parse_number_de": (
            "DOUBLE",
            f"number_of_run(regexp_extract(regexp_extract(normalize_text(x), {_quoted('[\\d.,]+')}, 0), {money}, 0))",
        ),
        "percent_of_run": ("DOUBLE", f"try_cast(nullif({percent}, '') AS DOUBLE)"),
        "parse_percent_de": (
            "DOUBLE",
            f"percent_of_run(regexp_extract(normalize_text(x), {_quoted(r'([\d,.]+)\s*%')}, 1))",
        ),
        "parse_kw": ("DOUBLE", unit("kW")),
        "parse_ps": ("DOUBLE", unit("PS")),
        "registration_year": (
            "BIGINT",
            f"try_cast(nullif(regexp_extract(normalize_text(x), {_quoted(r'\d{4}')}, 0), '') AS BIGINT)",
        ),
        "registration_month": (
            "BIGINT",
            f"try_cast(nullif(regexp_extract(normalize_text(x), {month}, 1), '') AS BIGINT)",
        ),
        "state_of_thousand": ("STRING", f"CASE {states} ELSE '' END"),
        "state_of_postcode": (
            "STRING",
            f"state_of_thousand(regexp_extract(clean_text(x), {_quoted(r'(?U)\b(\d{2})\d{3}\b')}, 1))",
        ),
        "country_name_de": ("STRING", f"CASE {countries} ELSE clean_text(x) END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session; returns their names."""
    for name, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(definitions())
