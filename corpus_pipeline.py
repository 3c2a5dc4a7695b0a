"""The corpus pipeline: five filtering stages from raw documents to a shuffled training mix.

Every stage works on all rows its predecessor kept, and its decisions take effect. The stages take
(spark, docs, sf_dir) and return the columns of ``documents``; the last adds the number of copies, the number of the copy
and the key of the global shuffle.

Defined cases, for every stage: an empty table gives an empty table; texts are read whole; all columns of the input come back
under their names, whatever these are. Null and empty texts have no words, so the first stage rejects them; given to a
later one, the language stage rejects them, near-dedup keeps one of them all, the last two keep them. Rows with a
null id are rows like others. Of repeated rows near-dedup keeps one; the other stages treat them alike, and mixing
gives them equal numbers of copies. Of equal rows of a component the smallest id stays, of equal ids the least text hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copperline.llm import decontamination, language_id, mixing, quality_rules, registry, simhash
from copperline.session import materialize

#: Language identification rejects what has no letter, and what the model is less sure of than of this share of the known rows
#: it was calibrated on.
KNOWN_SHARE = 0.995


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the quality rules."""
    return quality_rules.keep_documents(docs, "v1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model learns from the labelled rows of the whole table.

    The bar comes from the calibration rows: all but one in 200 of them reach it.
    """
    model = registry.language_model(spark, sf_dir)
    return language_id.keep_languages(docs, model, min_score=model.score_reached_by(KNOWN_SHARE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark windows."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in global random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: The language model cannot be expressed in SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
