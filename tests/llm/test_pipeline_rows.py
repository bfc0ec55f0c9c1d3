"""Every row's own decision takes effect, also where an id is null or repeats."""

import collections

import corpus_pipeline
from parcelyze.llm import mixing, toxicity
from pyspark.sql import functions as F

TOXIC = "you are a stupid idiot and you are worthless trash"
CLEAN = "the quiet river runs past an old mill and under the stone bridge"
OTHER = "seven ships sailed at dawn with grain and timber for the northern ports"
BENCH = "a benchmark passage of more than thirteen words that no text should hold at all here"


def _texts(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_null_and_repeated_ids(spark, tmp_path):
    labels = [(k, 0, int(k % 2)) for k in range(100, 140)]
    rows = [(k, TOXIC + f" {k}" if toxic else CLEAN + f" {k}") for k, _, toxic in labels]
    rows += [(None, TOXIC), (None, CLEAN), (1, TOXIC), (1, OTHER), (None, BENCH), (2, BENCH), (2, OTHER + " and more")]
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = toxicity.score_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), carry=True).collect()
    bad = {r.row.text for r in judged if r.predicted == 1}
    assert TOXIC in bad and CLEAN not in bad and OTHER not in bad
    assert _texts(corpus_pipeline.toxicity(spark, docs, str(tmp_path))) == collections.Counter(r for r in rows if r[1] not in bad)
    assert _texts(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == collections.Counter(r for r in rows if r[1] != BENCH)


def test_near_copies_by_row(spark):
    rows = [(3, OTHER), (5, CLEAN), (5, OTHER), (None, OTHER), (None, CLEAN), (None, BENCH), (None, None), (7, TOXIC), (7, TOXIC)]
    docs = spark.createDataFrame([(i, t, "abc"[k % 3]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    assert _texts(corpus_pipeline.near_dedup(spark, docs, "")) == collections.Counter([(3, OTHER), (5, CLEAN), (None, BENCH), (None, None), (7, TOXIC)])


def test_copies_of_rows_without_an_id(spark):
    texts = ["w " * n for n in range(1, 30)]
    rows = [(n, t, "abc"[n % 3]) for n, t in enumerate(texts)]
    named = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter({texts[r.doc_id]: r.copies for r in mixing.mix_sources(named).collect() if r.copies})
    got = corpus_pipeline.mixing(spark, named.withColumn("doc_id", F.lit(None).cast("long")), "")
    assert collections.Counter(r.text for r in got.collect()) == want
    assert set(want) != set(texts) and max(want.values()) > 1
