"""A corpus pipeline of five operators, each working on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcheck.llm import jaccard, language, mixing, packing, substrings
from veilcheck.llm.common import finished, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter or no language with a probability of a half."""
    return language.keep_identified(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs, size=5, percent=75)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that occur again go, and documents of which no word is left."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    cut = substrings.remove_repeats(docs.select(rest.alias("rest"), "text"), id_col="rest", width=35, keep_text=True)
    columns = [F.col("kept").alias("text") if c == "text" else F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("rest.n_chars")).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns]
    return cut.where("n_removed < n_words or n_words = 0").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mix(docs, weights=(5, 2, 1), most=3, share=1.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their sequences."""
    return packing.pack_documents(docs, most=2048)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, similarity joins and a tokenizer: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
