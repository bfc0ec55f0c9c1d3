"""A corpus pipeline: five stages, each one operator over all that the stage before has kept.

1. toxicity: documents that score at or above the threshold are rejected.
2. near-duplicates: of each group (five-word shingles, similarity 0.8 or more) the document with the least id stays.
3. decontamination: documents with at least one word in twenty inside a benchmark window are rejected.
4. mixing: documents are repeated or left out, so that sources come near their target weights.
5. token ids: what is left is written as range-coded ids, read back, and indexed.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. ``run`` writes every stage's
result to the shared folder and reads it for the next stage. Defined results: every row is judged by its own text, and
what is found takes effect on that row only, also where an id is null or repeats. A null id comes after all ids: in
stage 2 such a row goes if it is a near copy of any other that stays, and stage 4 gives it copies like all others. Rows
with one id and different texts are different documents. Rows without words are no near copies. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyze.llm.decontaminate import contamination, contamination_digest
from parcelyze.llm.mixing import mix_sources
from parcelyze.llm.near_dedup import near_duplicates
from parcelyze.llm.shared import written
from parcelyze.llm.token_files import tokens_of
from parcelyze.llm.toxicity import score_toxicity


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_pipeline_row``, a number of its own for each row, written once so that it holds."""
    return written(docs.withColumn("_pipeline_row", F.monotonically_increasing_id()), "rows", "zstd")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic, in the pass that scores them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, folds=4, held_out=2, threshold=0.3, carry=True).where("predicted <> 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the least id, of several the one with the least hash."""
    rows = _numbered(docs)
    group = near_duplicates(rows, id_col="_pipeline_row", words=5, num=80, den=100).select(F.col("doc_id").alias("_pipeline_row"), "component_id")
    group = written(group, "groups")
    # Only groups of several rows need a choice; the rows themselves are joined once, to those that go.
    several = group.where("component_id <> _pipeline_row").select("component_id").distinct()
    some = group.join(several, "component_id", "left_semi").join(rows.select("_pipeline_row", F.col("doc_id").alias("_pipeline_id"), F.xxhash64(*docs.columns).alias("_pipeline_hash")), "_pipeline_row")
    order = F.struct(F.col("_pipeline_id").isNull().alias("last"), "_pipeline_id", "_pipeline_hash", "_pipeline_row")
    first = some.groupBy("component_id").agg(F.min_by("_pipeline_row", order).alias("_pipeline_first"))
    gone = some.select("_pipeline_row", "component_id").join(first, "component_id").where("_pipeline_row <> _pipeline_first").select("_pipeline_row")
    return rows.join(gone, "_pipeline_row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages, in the pass that scans them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination_digest(contamination(docs, benchmark, window=13, carry=True), "row").where("not contaminated").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by the mix of sources."""
    rows = _numbered(docs)
    copies = mix_sources(rows, weights=(5, 2, 1), share=1.5, ceiling=2.0, row_col="_pipeline_row").where("copies > 0").select(F.col("row").alias("_pipeline_row"), F.col("copies").alias("_pipeline_copies"))
    return rows.join(copies, "_pipeline_row").select(*(F.col(c) for c in docs.columns), F.explode(F.expr("sequence(1, _pipeline_copies)")).alias("_pipeline_copy")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns the index read back."""
    return tokens_of(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near-duplicates", near_dedup), ("benchmark decontamination", decontamination), ("source mixing", mixing), ("token ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs


#: SQL expresses neither the learned toxicity score nor the tokenizer.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
