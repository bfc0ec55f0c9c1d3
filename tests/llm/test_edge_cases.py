"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from parcelyze.llm import decontaminate, language, lm_scoring, mixing, near_dedup, nearest, pii, token_files, toxicity
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 9973}" for i in range(60_000))
CLASH = ["label", "component_id", "kept", "copies", "mark", "part", "size", "taken", "score", "row", "block", "items", "held_out", "root", "rep", "ahead", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
EXTRA = ("x",) * len(CLASH)
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "a document without an id stands here for all to see", "de", None, 3),
    (None, None, None, None, None),
    (5, " \t\n\r ", "de", "b", 4),
    (6, LONG, "de", "b", len(LONG)),
    (7, "12 34 !!", "fr", "c", 8),
    (8, "mail me at a.b@c.de or +1 (555) 555-0100 from 10.0.0.1 é 日本", "fr", "c", 9),
]
BENCH = [(1, "quick brown fox jumps over the lazy dog again and again the quick brown"), (2, None), (3, "lazy dog"), (None, "brown fox"), (3, "lazy dog"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_near_duplicates(docs, none):
    got = _rows(near_dedup.near_duplicates(docs, words=4))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5)) and by[7]["n_shingles"] == 1
    assert by[6]["n_shingles"] == 9973
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_one_id_with_several_texts_is_one_node(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (3, b)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in _rows(near_dedup.near_duplicates(df, words=4))} == {1: 1, 3: 1, 5: 1}


def test_language(docs, none):
    got = _rows(language.identify_languages(docs))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5, 7))
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6, 8)} <= {"en", "de", "fr"}
    assert language.identify_languages(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in _rows(language.identify_languages(unlabelled))} == {"und"}


def test_lm_scoring(docs, none):
    got = _rows(lm_scoring.score_texts(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_tokens"] for i in (3, 4, 5, 6)] == [1, 1, 1, 60_001]
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert lm_scoring.score_texts(none).count() == 0


def test_pii(docs, none):
    got = _rows(pii.pii_digest(pii.personal_data(docs)))
    assert len(got) == len(ROWS)
    one = next(r for r in got if r["doc_id"] == 8)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 0, 1)
    assert one["spans"].startswith("email:11:19,ip:") and one["base_sha256"] == hashlib.sha256(one["spans"].encode()).hexdigest()
    assert next(r for r in got if r["doc_id"] == 4)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(none).count() == 0


def test_token_files(docs, none):
    got = sorted((r.asDict() for r in token_files.tokens_of(docs, PATH).collect()), key=lambda r: r["start"])
    assert len(got) == len(ROWS) and got[0]["doc_id"] is None
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert token_files.tokens_of(none, PATH).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = _rows(decontaminate.contamination_digest(decontaminate.contamination(docs, bench)))
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(ROWS)
    assert by[1] == {**by[2], "doc_id": 1} and by[1]["n_items"] == 2 and by[1]["n_hit"] == 4 and by[1]["contaminated"]
    assert by[4]["n_words"] == 0 and not by[4]["contaminated"] and by[4]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(not r["contaminated"] for r in _rows(decontaminate.contamination_digest(decontaminate.contamination(docs, bench.limit(0)))))


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest_neighbours(df, df.where("vec_id in (1, 4, 5, 6)"), k=20).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.5), (1, 3, 3, 0.5)]
    empty = df.limit(0)
    assert nearest.nearest_neighbours(empty, empty).count() == 0
    assert nearest.nearest_neighbours(df, empty).count() == 0


def test_mixing(docs, none):
    got = _rows(mixing.mix_sources(docs))
    assert len(got) == len(ROWS)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    assert sum(1 for r in got if r["source"] is None) == 3
    assert mixing.mix_sources(none).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["target"], r["taken"]) for r in _rows(mixing.mix_sources(blank))} == {(0.0, 0)}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = _rows(toxicity.score_toxicity(docs, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < 4:
                assert now.columns == start.columns
                path = f"{tmp_path}/{start.count()}-{k}"
                now.write.parquet(path)
                now = spark.read.parquet(path)
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (now.count() > 0) == (start is docs)
