"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .decontaminate import contamination, contamination_digest
from .language import identify_languages
from .line_dedup import dedup_lines
from .lm_scoring import score_texts
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .nearest import nearest_neighbours
from .pii import personal_data, pii_digest
from .token_files import tokens_of
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on sets of four-word shingles, similarity 0.8 or more."""
    return near_duplicates(_read(spark, sf_dir, "documents"), words=4, num=80, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from four fifths of the labelled ones."""
    return identify_languages(_read(spark, sf_dir, "documents"), folds=5, held_out=0, most_rows=4000)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of whole lines, over 50 words, that stand before in the table."""
    return dedup_lines(_read(spark, sf_dir, "documents"), least_words=50)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each document under a word-pair model of nine tenths of them."""
    return score_texts(_read(spark, sf_dir, "documents"), folds=10, held_out=0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: base spans and those that bootstrapped patterns add."""
    return pii_digest(personal_data(_read(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written range-coded and read back."""
    return tokens_of(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside benchmark windows of 13 words."""
    return contamination_digest(contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others, by inner product."""
    rows = _read(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document for weights 5, 2, 1 over the sources and 150 % of all words."""
    return mix_sources(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, ceiling=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from three quarters of the labelled ones."""
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=4, held_out=2, threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
}
#: Where SQL can express a query on whole tables.
SQL: dict[str, str | None] = {"op7_benchmark_decontamination": sql.CONTAMINATION, "op9_source_mixing": sql.MIXING}
