"""A corpus pipeline of five stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes to the shared folder and reads again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlake.llm import language_id, mixing, ngram_join, packing, secret_scan
from variantlake.llm.common import python_ready, stored, table

LANGUAGE_DIM = 16_384  # unrelated vectors have cosines of deviation 1 / sqrt(dim) = 0.008
FIRST_DIM = 2_048  # settles the texts that are six deviations above the limit there
MIN_LANGUAGE_SCORE = 0.04  # five deviations; one known short word has about 0.08
RANDOM_LETTERS = 0.0035  # random letters hit learned trigrams: about 0.004 times the root of the words
MOST_LANGUAGE_SCORE = 0.3


def least_score(text: Column) -> Column:
    """The cosine a text must reach: chance, and what random letters of as many different words reach."""
    words = F.size(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")))
    return F.least(F.lit(MIN_LANGUAGE_SCORE) + F.lit(RANDOM_LETTERS) * F.sqrt(words), F.lit(MOST_LANGUAGE_SCORE))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those unlike every learned language.

    Cosines at 2,048 dimensions settle the texts that are clear of the limit; the others
    are decided at 16,384.
    """
    labelled = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out()).select("text", "lang")
    short, long = (language_id.learn(labelled, dim=dim) for dim in (FIRST_DIM, LANGUAGE_DIM))
    least = least_score(F.col("text"))
    known = language_id.identify(docs, short, lang_out="_lang", score_out="_score", dim=FIRST_DIM, limit=least, longer=long, longer_dim=LANGUAGE_DIM)
    return known.where((F.col("_lang") != "und") & (F.col("_score") >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word n-grams, 0.8) stays."""
    return ngram_join.one_per_class(docs, ngram_join.ngram_join(docs)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are masked."""
    python_ready(spark)
    masked = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of their sources takes them."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 2,048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None  # MinHash candidates, prototypes and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
