"""From raw documents to token ids: five stages, each on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of `documents`.  Rows
with null ids or texts, empty texts and repeated rows are allowed: a text without letters leaves at the first stage,
of repeated rows one stays at the second; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm import bpe, decontaminate, jaccard_join, language, substring_dedup
from tidebar.llm.tables import read, written

NEAR_WORDS, NEAR_PERCENT = 5, 80
LEAST_SCORE = 0.5
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of no language in particular, go; `lang` becomes the predicted one."""
    found = language.predict(docs, language.train(docs))
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: that with the smallest id."""
    found = jaccard_join.components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    # rows repeated with id and text are copies of each other
    return kept.withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of an earlier document are cut out; a document left without words goes."""
    found = substring_dedup.remove_repeats(docs)
    found = found.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("n_removed") > 0
    return found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    found = decontaminate.annotate(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text as decoded from them."""
    both = bpe.round_trip(spark, RANKS, public_tokenizers.PATTERN)
    out = docs.select("doc_id", "lang", "source", both("text").alias("both"))
    return out.select("doc_id", "lang", "source", F.size("both.ids").cast("long").alias("n_tokens"),
                      F.col("both.ids").alias("token_ids"), F.col("both.decoded").cast("string").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: Language models and byte-pair merges are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
