"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, as Parquet; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, langid, near_dedup, packing, suffix_dedup, tokens
from lotwise.operators.durable import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or without a letter go.  A missing label is filled in."""
    model = langid.fit(docs.filter(~langid.held_out("doc_id")), "text", "lang", "doc_id")
    found = langid.identify(docs.select(*COLUMNS), model, out="__lang", score="__score").filter("`__lang` <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id; of equal rows one."""
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["doc_id", "text"])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes and more that an earlier one has."""
    found = suffix_dedup.repeats(docs, carry=["lang", "source", "n_chars"])
    cut = F.col("n_removed") > 0
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(docs, items, keep=("text", "lang", "source", "n_chars"))
    return found.filter("n_hit = 0").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.public())


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizer, signatures and learnt filters have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
