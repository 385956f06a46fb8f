"""The queries of this subpackage, over whole tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.llm import (
    bidiagonal_whitening,
    bpe_automaton,
    chat_snapshots,
    column_bwt,
    decontamination,
    diagonal_alignment,
    hamming_join,
    language_mixture,
    line_blocks,
    packing,
    quality_cascade,
    secret_scan,
    uniform_threshold,
)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; nothing else knows the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_automaton.bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return bpe_automaton.digests(coded)


def op2_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bwt.digests(column_bwt.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_blocks.extract_main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_mixture.identify(docs, language_mixture.fit_labelled(docs))
    return found.select("doc_id", language_mixture.held_out().alias("held_out"), "lang_pred", "score")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.assess(_table(spark, sf_dir, "documents"))


def op8_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_threshold.top_k(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render(_table(spark, sf_dir, "conversations"))


def op11_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bidiagonal_whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonal_alignment.align_tokenizers(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_automaton": op1_bpe_automaton,
    "op2_column_bwt": op2_column_bwt,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_blocks": op4_line_blocks,
    "op5_hamming_join": op5_hamming_join,
    "op6_language_mixture": op6_language_mixture,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_uniform_threshold": op8_uniform_threshold,
    "op9_packing": op9_packing,
    "op10_chat_snapshots": op10_chat_snapshots,
    "op11_bidiagonal_whitening": op11_bidiagonal_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_diagonal_alignment": op13_diagonal_alignment,
}

ORACLES: dict[str, str] = {
    "op8_uniform_threshold": uniform_threshold.SQL,
    "op10_chat_snapshots": chat_snapshots.SQL,
    "op12_decontamination": decontamination.SQL,
}
