"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last give back the columns that they took, in their order and
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.llm import column_bwt, hamming_join, language_mixture, packing, secret_scan
from surtido.llm.queries import tokenizer_path
from surtido.session import materialize


def _counted(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` as the texts now are."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold no letter. Which language it is, and in what proportion, decides about no row.

    Null and empty texts hold no letter; null ids and languages are no ground to
    go; repeated rows stay or go together. A table without a label loses the same rows.
    """
    return language_mixture.keep_identified(docs, language_mixture.fit_labelled(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of repeated rows one stays.

    Null and empty texts are near nothing and stay, one for each id; rows without an id come after those with one.
    """
    return hamming_join.one_of_each(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes that occur more than once in the corpus; all occurrences go, the first too.

    Every row stays. Null texts stay null; ids may be null or repeat; repeated rows are copies of one another.
    """
    return _counted(column_bwt.without_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked. Every row stays, repeated ones and those without an id too; null texts stay null."""
    return _counted(secret_scan.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens.

    Null and empty texts are documents of the end token alone; repeated rows and rows without an id are documents of their own.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packed),
]

#: Signatures, the order of suffixes and tokens go beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
