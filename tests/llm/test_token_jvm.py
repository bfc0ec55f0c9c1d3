"""Segments coded in the JVM: the bytes of the coder by arrays, and no Python worker to read them. Pieces found in tables of two ages."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from parcelyze.llm import jvm_coder, shared, token_files
from pyspark.sql import functions as F

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = np.random.default_rng(23)
IDS = [
    *(rng.integers(0, 1 << 16, n) for n in (1, 2, 3, 5000)),
    *(rng.integers(0, k, 6000) for k in (1, 2, 3, 20, 300)),
    *(np.tile(np.arange(k), 9000 // k) for k in (2, 7, 300, 900)),
    rng.zipf(1.3, 20_000) % (1 << 16),
    np.full(20_000, 65535),
]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def _cases():
    for ids in IDS:
        lengths = np.diff(np.concatenate([[0], np.unique(rng.integers(1, len(ids) + 1, 3)), [len(ids)]]))
        lengths = lengths[lengths > 0]
        names = [None, -5, 7, 1 << 40][: len(lengths)]
        for block in (512, 4096):
            yield names, lengths, ids, block


def test_bytes_and_rows_are_those_of_the_coder_by_arrays(spark):
    jvm_coder.register(spark)
    jvm_coder.register(spark)  # once more does no harm
    cases = list(_cases())
    rows = [(k, token_files._head(n, m, len(i), b), i.astype("<u2").tobytes()) for k, (n, m, i, b) in enumerate(cases)]
    packed = spark.createDataFrame(rows, "k int, head binary, ids binary").select("k", F.call_function(jvm_coder.PACK, "head", "ids").alias("data"))
    data = {r.k: bytes(r.data) for r in packed.collect()}
    back = {k: [] for k in data}
    for r in packed.select("k", F.inline(F.call_function(jvm_coder.UNPACK, "data"))).collect():
        back[r.k].append(tuple(r)[1:])
    for k, (names, lengths, ids, block) in enumerate(cases):
        assert data[k] == token_files.pack_segment(names, lengths, ids, block)
        ends = np.cumsum(lengths)
        assert back[k] == [(a, e - n, n, zlib.crc32(ids[e - n : e].astype("<u4").tobytes())) for a, e, n in zip(names, ends.tolist(), lengths.tolist())]


@pytest.mark.parametrize("harm", [lambda d: d[:-40] + bytes(40), lambda d: b"x" + d[1:]])
def test_a_damaged_segment_is_an_error(spark, harm):
    jvm_coder.register(spark)
    data = harm(token_files.pack_segment([1], np.array([3000]), rng.integers(0, 500, 3000)))
    with pytest.raises(Exception, match="is damaged|not a token segment"):
        spark.createDataFrame([(bytearray(data),)], "data binary").select(F.inline(F.call_function(jvm_coder.UNPACK, "data"))).collect()


def test_files_are_read_without_python_workers(docs, tmp_path):
    """Decoding by arrays in Python workers took a third of the whole."""
    out = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, out, PATH, segment_ids=50_000)
    read = token_files.read_token_files(docs.sparkSession, out)
    assert "Arrow" not in (plan := read._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan
    stored = [r for r in docs.sparkSession.read.parquet(out).collect()]
    told = {(n, m) for r in stored for n, m in zip(*(x if isinstance(x, list) else x.tolist() for x in token_files.unpack_segment(bytes(r.data))[:2]))}
    assert told == {(r.doc_id, r.n_tokens) for r in read.collect()}


def test_pieces_are_found_whenever_they_came():
    """New pieces go to a small table first; sorting them among all others for each slice took as long as tokenizing them."""
    pick, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyzàéß"
    pieces = token_files.PieceTokenizer(PATH)
    words, ages = [], set()
    for _ in range(12):
        words += ["".join(pick.choices(letters, k=pick.randint(1, 9))) for _ in range(300)]
        text = " ".join(pick.choices(words, k=500) + words[-300:])
        raw, at = shared.text_bytes(token_files.pa.array([text, "", None, text[:50]]))
        ids, count = pieces.encode(raw, at)
        expected = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "", text[:50])]
        assert ids.tolist() == sum(expected, []) and count.tolist() == [len(e) for e in expected]
        ages.add(len(pieces.tables[1][0]) > 0)
        assert pieces.known == sum(len(t[0]) for t in pieces.tables) and all((np.diff(t[0].astype(float)) >= 0).all() for t in pieces.tables)
    assert ages == {True, False}
