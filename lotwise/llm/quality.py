"""Quality rules with risk-controlled cutoffs.

Texts are measured once.  A rule is one whole number per document and rejects those above
a cutoff.  Cutoffs come from labelled documents, for each stratum apart:

1. The *fitting fold* proposes: for each step of ``STEPS`` a rule's cutoff is the value that
   so many thousandths of its good documents exceed at most.  A rule counts only where it
   then rejects at least ``CATCH`` per cent of the bad documents, and ``LIFT`` times the share
   of the good ones.
2. The *testing fold*, which had no say in this, decides: all rules together are put to its
   good documents, and a step is certified if rejecting as few as seen would have a
   probability of at most ``DELTA`` over the number of strata (Bonferroni), were the true share
   of rejected good documents above ``ALPHA``: the exact binomial (Clopper-Pearson) bound.
   Steps go from the mildest on and end with the first that fails (fixed sequence), so
   several steps need no further correction.

With probability 1 - DELTA no stratum loses more than ALPHA of its good documents.  A stratum
without a certified step rejects nothing beyond the base rules.

Defined cases: a null text has no words; a null stratum is one of its own; a document with
several labels has the worst of them; labels without a document, null labels and documents
that the base rules reject take no part; rows of one id are judged each by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.columns import EXACT, SPACED, grams, lean_batches, runs, utf8, word_hashes, word_spans
from lotwise.operators.durable import store

#: Share of good documents that a stratum may lose, and the probability that any loses more.
ALPHA, DELTA = 0.05, 0.05
#: Thousandths of the good documents that each rule may reject where it is fitted, mildest first.
STEPS = (0, 1, 2)
#: Per cent of the bad documents that a rule must reject to count, and how much more often than good ones.
CATCH, LIFT = 5, 5
#: One of so many labelled documents fits, the others test.
FOLDS = 4

_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LETTER = _UPPER | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))
_BANG = np.arange(256) == 0x21
_STARTS = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs"]

#: Rules: whole numbers that rise with what is wrong.
RULES: dict[str, str] = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "long_words": "100 * word_chars div greatest(n_words, 1)",
    "short_words": "-(100 * word_chars div greatest(n_words, 1))",
    "capitals": "1000 * n_upper div greatest(n_letters, 1)",
    "bangs": "1000 * n_bangs div greatest(n_words, 1)",
}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flagged bytes of each text."""
    upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _first_ones(text: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of names within texts: how often each occurs in its text, and whether it is the first of them."""
    order = np.lexsort((names, text))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (text[order][1:] != text[order][:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    times, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    times[order] = np.repeat(sizes, sizes)
    first[order[new]] = True
    return times, first


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The numbers of ``MEASURES`` for texts that begin at ``offsets``."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, SPACED)
    counts = np.diff(first)
    chars = _sums(SPACED[data] & _STARTS[data], offsets)
    # Lines with a word, told apart by all their bytes.
    begin, end, _ = word_spans(data, offsets, _LINE)
    worded = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[worded], end[worded]
    line_of = np.searchsorted(offsets, begin, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    distinct = np.zeros(n, np.int64)
    if len(begin):
        _, fresh = _first_ones(line_of, word_hashes(data, begin, end, _LINE, EXACT))
        distinct = np.bincount(line_of[fresh], minlength=n)
    # Words in windows of three words that occur again in the text.
    repeated = np.zeros(n, np.int64)
    if len(starts) >= 3:
        word_of = np.repeat(np.arange(n), counts)
        names = grams(word_hashes(data, starts, ends, SPACED, EXACT), 3)
        at = np.flatnonzero(word_of[2:] == word_of[:-2])
        times, _ = _first_ones(word_of[at], names[at])
        spots = at[times > 1]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[spots + k] = True
        repeated = np.bincount(word_of[covered], minlength=n)
    more = [_sums(rule[data], offsets) for rule in (_UPPER, _LETTER, _BANG)]
    return [counts, chars, _sums(_SYMBOL[data], offsets), lines - distinct, repeated, lines, *more]


@lean_batches
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in runs(offsets):
            found = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            kept = [batch.column(c).slice(a, b - a) for c in ("id", "stratum")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in found]], ["id", "stratum", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id``, ``stratum``, the measures and ``base_failed`` of every whole text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(_measured, "id bigint, stratum string, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return found.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def tail(k: int, n: int, share: float) -> float:
    """Probability of at most ``k`` of ``n`` at the given share, exactly; 1 where ``k`` is no less than expected."""
    if k >= n * share:
        return 1.0
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    total = term = 1.0
    for i in range(k, 0, -1):  # ratios shrink as i falls, so the sum ends where it no longer grows
        term *= i * (1 - share) / ((n - i + 1) * share)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log_top) * total)


def _tails(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([tail(int(a), int(b), ALPHA) for a, b in zip(k, n)], dtype="float64")


def _values() -> Column:
    """Rule names and values of a row, to be exploded."""
    return F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(v).cast("bigint").alias("value")) for r, v in RULES.items()]))


def proposed(fit: DataFrame) -> DataFrame:
    """Cutoff of each rule that counts, per stratum and step, from labelled rows (``good`` 0 or 1)."""
    values = fit.select("stratum", "good", _values().alias("v")).groupBy("stratum", "v.rule", "v.value").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    group = Window.partitionBy("stratum", "rule")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = values.select(
        "stratum", "rule", "value", F.sum("good").over(upto).alias("good_upto"), F.sum("bad").over(upto).alias("bad_upto"), F.sum("good").over(group).alias("goods"), F.sum("bad").over(group).alias("bads")
    )
    steps = sums.withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEPS])))
    # The least value that few enough good documents exceed.
    fits = steps.filter("goods > 0 AND 1000 * (goods - good_upto) <= step * goods").groupBy("stratum", "rule", "step").agg(
        F.min_by(F.struct(F.col("value").alias("cutoff"), (F.col("goods") - F.col("good_upto")).alias("good_hit"), (F.col("bads") - F.col("bad_upto")).alias("bad_hit"), "goods", "bads"), "value").alias("c")
    )
    return fits.select("stratum", "rule", "step", "c.*").filter(f"bads > 0 AND 100 * bad_hit >= {CATCH} * bads AND bad_hit * goods >= {LIFT} * good_hit * bads")


def _rejected(cutoff: str) -> Column:
    """Whether any rule's value is above its cutoff in the map column; rules without one reject nothing."""
    hits = [F.coalesce(F.expr(v).cast("bigint") > F.col(cutoff)[r], F.lit(False)) for r, v in RULES.items()]
    return reduce(lambda a, b: a | b, hits)


def certified(labelled: DataFrame) -> DataFrame:
    """The cutoffs (a map by rule) of every stratum with a certified step, its tests and its bound.

    ``labelled`` has the measures, ``stratum``, ``good`` and ``fits`` (of the fitting fold).
    """
    cutoffs = proposed(labelled.filter("fits")).groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    test = labelled.filter("NOT fits AND good = 1").alias("t")
    asked = test.join(cutoffs.alias("c"), F.col("t.stratum").eqNullSafe(F.col("c.stratum"))).select("t.*", "c.step", "c.cutoffs")
    counted = asked.groupBy("stratum", "step").agg(F.count("*").alias("tested"), F.count_if(_rejected("cutoffs")).alias("lost"), F.first("cutoffs").alias("cutoffs"))
    strata = labelled.agg(F.greatest(F.count_distinct("stratum") + F.coalesce(F.max(F.col("stratum").isNull().cast("int")), F.lit(0)), F.lit(1)).alias("strata")).scalar()
    p_value = F.pandas_udf(_tails, "double")
    judged = counted.withColumn("passed", p_value("lost", "tested") <= F.lit(DELTA) / strata)
    sequence = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = judged.withColumn("held", F.min("passed").over(sequence)).filter("held")
    return kept.groupBy("stratum").agg(F.max_by(F.struct("step", "cutoffs", "tested", "lost"), "step").alias("c")).select("stratum", "c.*")


def ruled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id_col``, all measures, ``base_failed`` and ``kept`` of every document."""
    rows = store(measured(docs, id_col, text_col, stratum_col))
    worst = labels.select(F.col(f"`{label_id}`").cast("bigint").alias("label_id"), F.col(f"`{label_col}`").alias("good")).filter("label_id IS NOT NULL AND good IS NOT NULL").groupBy("label_id").agg(F.min("good").cast("bigint").alias("good"))
    labelled = rows.filter("NOT base_failed").join(worst, F.col("id") == F.col("label_id")).withColumn("fits", F.crc32(F.col("id").cast("string")) % FOLDS == 0)
    cutoffs = certified(store(labelled.drop("label_id"))).select(F.col("stratum").alias("of"), "cutoffs")
    found = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return found.select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("base_failed") & ~_rejected("cutoffs")).alias("kept"))
