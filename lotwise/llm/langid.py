"""Language identification with a bit-sliced Bloom filter of n-grams.

One filter holds the frequent n-grams of all languages: a slot is a mask with a bit for
each language, and the slots of an n-gram's hashes, and-ed, give every language that
contains it (or seems to).  A text's n-grams are counted for each language, the counts
are corrected for the share of false positives that the language's fill makes likely,
and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.columns import LOWER, U64, lean_batches, mix, runs, utf8

NGRAM, HASHES = 4, 3
#: Slots of the filter, and n-grams of a language in it.
SLOTS, PER_LANGUAGE = 1 << 18, 20_000
#: Labelled rows that are learnt from, about; all are used where there are fewer.
SAMPLE_ROWS = 40_000

_LETTERS = r"\p{L}"
_GAP = np.zeros(256, bool)
_GAP[:0x41] = _GAP[0x5B:0x61] = _GAP[0x7B:0x80] = True


def ngram_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the byte n-grams of lower-cased text that hold a letter's byte, and the text of each.

    Bytes that are no letters count as one sort of gap; n-grams don't cross texts.
    """
    x = np.where(_GAP[data], np.uint8(32), LOWER[data]).astype(U64)
    n = len(x) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    name = x[:n].copy()
    for i in range(1, NGRAM):
        name = (name << U64(8)) | x[i : n + i]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + NGRAM <= offsets[1:][text]
    gaps = x == 32
    fits &= ~(gaps[:n] & gaps[1 : n + 1] & (gaps[2 : n + 2]))  # almost only gap
    return name[fits], text[fits]


def _slots(names: np.ndarray) -> list[np.ndarray]:
    h = mix(names)
    return [((h >> U64(20 * k)) & U64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass(frozen=True)
class Model:
    """``masks``: a row per 64 languages; ``fill``: each language's share of slots that are set."""

    languages: tuple[str, ...]
    masks: np.ndarray
    fill: np.ndarray

    def counts(self, names: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the words of its language mask."""
        slots = _slots(names)
        out = []
        for row in self.masks:
            m = row[slots[0]]
            for s in slots[1:]:
                m &= row[s]
            out.append(m)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of a text's n-grams in each language: a row per text."""
        n = len(offsets) - 1
        names, text = ngram_names(data, offsets)
        total = np.bincount(text, minlength=n).astype(float)
        out = np.zeros((n, len(self.languages)))
        if not len(names):
            return out
        masks = self.counts(names)
        for k in range(len(self.languages)):
            hit = (masks[k // 64] >> U64(k % 64)) & U64(1)
            found = np.bincount(text, weights=hit.astype(float), minlength=n)
            false = self.fill[k] ** HASHES
            out[:, k] = np.maximum(found - total * false, 0) / np.maximum(total * (1 - false), 1)
        return np.minimum(out, 1)


def fit(rows: DataFrame, text_col: str, lang_col: str, id_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from a sample of about ``sample_rows`` of the labelled rows, spread by a hash of the id.

    A row without label or text teaches nothing.  Every n-gram is counted once a row.  A language
    keeps its ``PER_LANGUAGE`` most frequent n-grams; what reaches the driver is bounded by that.
    """
    known = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter("lang is not null and text is not null")
    total = known.select("lang").count()
    if total > sample_rows:
        share = int(sample_rows / total * (1 << 32))
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 32)) < share)

    def work(batches):
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            names_of, which = lang.dictionary.to_pylist(), np.asarray(lang.indices)
            data, offsets = utf8(batch.column(1))
            for i, j in runs(offsets):
                names, text = ngram_names(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((names, text))
                names, text = names[order], text[order]
                new = np.ones(len(names), bool)
                new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
                names, kind = names[new], which[i + text[new]]
                both, count = np.unique(np.stack([kind.astype(np.int64), names.astype(np.int64)]), axis=1, return_counts=True) if len(names) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names_of[k] for k in both[0].tolist()], pa.string()), pa.array(both[1]), pa.array(count.astype(np.int64))], ["lang", "name", "n"]
                )

    counted = known.select("lang", "text").mapInArrow(lean_batches(work), "lang string, name long, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "name")
    best = counted.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= PER_LANGUAGE)
    kept = best.groupBy("lang").agg(F.collect_list("name").alias("names")).collect()
    languages = tuple(sorted(r["lang"] for r in kept))
    masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), U64)
    fill = np.zeros(len(languages))
    for r in kept:
        k = languages.index(r["lang"])
        slots = np.unique(np.concatenate(_slots(np.array(r["names"], np.int64).astype(U64))))
        masks[k // 64][slots] |= U64(1) << U64(k % 64)
        fill[k] = len(slots) / SLOTS
    return Model(languages, masks, fill)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(_LETTERS), F.lit(False))


def identify(rows: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with the predicted language and its score from 0 to 1 added.

    A text that is null or has no letter, and any text under a model without languages, is
    ``und`` with score 0.  A text none of whose n-grams is known takes the first language
    with score 0.  Ties go to the language first in order.  A column already named like a
    result is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop(out, score, "__letter")
    names = rows.columns
    flagged = rows.withColumn("__letter", has_letter(F.col(f"`{text_col}`")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flagged.schema.fields)

    def work(batches):
        model = shared.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            data, offsets = utf8(t[text_col])
            letters = np.asarray(pc.fill_null(t["__letter"].combine_chunks(), False))
            langs, scores = np.array(["und"] * len(letters), dtype=object), np.zeros(len(letters))
            for i, j in runs(offsets) if model.languages else ():
                s = model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best = s.argmax(1)
                ok = letters[i:j]
                langs[i:j][ok] = np.array(model.languages, dtype=object)[best][ok]
                scores[i:j][ok] = s[np.arange(j - i), best][ok]
            yield from t.append_column(out, pa.array(langs.tolist(), pa.string())).append_column(score, pa.array(scores)).to_batches()

    found = flagged.mapInArrow(lean_batches(work), f"{kinds}, `{out}` string, `{score}` double")
    return found.select(*[F.col(f"`{c}`") for c in names], out, score)


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    """Rows kept from learning: crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
