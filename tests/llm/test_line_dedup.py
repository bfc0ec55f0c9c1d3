"""Line dedup against a plain version, on documents and on built passages."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
from parcelyze.llm import line_dedup
from parcelyze.llm.queries import QUERIES
from parcelyze.llm.shared import mix, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hash(data):
    return int(word_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def _rolled(a, b):
    with np.errstate(over="ignore"):
        return int(mix(np.array([a], np.uint64) * line_dedup._ROLL + np.array([b], np.uint64))[0])


def _cut(seq, keys):
    """Lists of entries; one ends where its key is below both neighbours'."""
    out, now = [], []
    for i, x in enumerate(seq):
        now.append(x)
        if (i == 0 or keys[i] < keys[i - 1]) and (i == len(seq) - 1 or keys[i] < keys[i + 1]) or i == len(seq) - 1:
            out.append(now)
            now = []
    return out


def _chunks(raw):
    """(first word, word after the last) of each chunk, and the words' spans."""
    spans = [m.span() for m in WORD.finditer(raw)]
    lines, k = [], 0
    for physical in raw.split(b"\n"):
        n = len(WORD.findall(physical))
        own = list(range(k, k + n))
        hashes = [_hash(raw[spans[i][0] : spans[i][1]]) for i in own]
        lines += _cut(own, [_rolled(hashes[i - 1] if i else 0, h) for i, h in enumerate(hashes)])
        k += n
    hashes = [_hash(raw[spans[x[0]][0] : spans[x[-1]][1]]) for x in lines]
    groups = _cut(lines, [_rolled(hashes[i - 1] if i else 0, h) for i, h in enumerate(hashes)])
    return [(g[0][0], g[-1][-1] + 1) for g in groups], spans


def _plain(rows, least=50):
    """(doc_id, text), in order -> {(doc_id, text): (words, words removed, new text)}."""
    first, docs = {}, {}
    for i, text in rows:
        if text is None or (i, text) in docs:
            continue
        raw = text.encode()
        chunks, spans = _chunks(raw)
        docs[i, text] = (raw, chunks, spans)
        for p, (a, b) in enumerate(chunks):
            first.setdefault(raw[spans[a][0] : spans[b - 1][1]], (i, text, p))
    out = {}
    for name, (raw, chunks, spans) in docs.items():
        said = [raw[a:b] for a, b in spans]
        kept = [first[raw[spans[a][0] : spans[b - 1][1]]] for a, b in chunks]
        again = [k != (*name, p) for p, k in enumerate(kept)]
        gone = [False] * len(spans)
        p = 0
        while p < len(chunks):
            q = p
            while q < len(chunks) and again[q]:
                q += 1
            if q > p:
                a, b = chunks[p][0], chunks[q - 1][1]
                reach = []
                for at, step in ((p, -1), (q - 1, 1)):
                    text, other, spans2 = docs[kept[at][:2]]
                    words, n = [text[x:y] for x, y in spans2], 0
                    mine, his = (chunks[at][0] - 1, other[kept[at][2]][0] - 1) if step < 0 else (chunks[at][1], other[kept[at][2]][1])
                    while n < 64 and 0 <= mine < len(said) and 0 <= his < len(words) and said[mine] == words[his]:
                        n, mine, his = n + 1, mine + step, his + step
                    reach.append(n)
                a, b = a - reach[0], b + reach[1]
                if b - a > least:
                    gone[a:b] = [True] * (b - a)
            p = max(q, p + 1)
        text, k = b"", 0
        for w, (a, b) in enumerate(spans):
            if gone[w]:
                continue
            lead = raw[spans[w - 1][1] if w else 0 : a]
            if w and gone[w - 1]:  # of the spaces about what is gone, one stays
                v = w - 1
                while v >= 0 and gone[v]:
                    v -= 1
                before = raw[spans[v][1] if v >= 0 else 0 : spans[v + 1][0]]
                lead = lead if b"\n" in lead and b"\n" not in before else before
            text += lead + raw[a:b]
        end = raw[spans[-1][1] if spans else 0 :]
        out[name] = (len(spans), sum(gone), (text + end).decode())
    return out


def _results(df):
    return {(r.doc_id, r.text): r for r in df.collect()}


def test_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20_000][:400]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _plain(rows)
    for (i, _), (n, gone, text) in want.items():
        assert (got[i].n_words, got[i].words_removed, got[i].text) == (n, gone, text)
    assert sum(r.words_removed for r in got.values()) > 0
    every = QUERIES["op3_line_dedup"](spark, small)
    assert every.count() == docs.count() and every.columns[0] == "doc_id"


def test_passages_inside_lines_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passages = [prose(n) for n in [52, 60, 75, 120] * 10]
    rows = []
    for k, p in enumerate(passages):
        for c in range(3):
            rows.append((10 * k + c, f"{prose(rng.randint(3, 40))} {p} {prose(rng.randint(3, 40))}\n{prose(20)}"))
    rows += [(10_000 + k, prose(150)) for k in range(50)]
    rows.append((20_000, prose(30) + " " + passages[0][:200] + " " + prose(30)))  # fewer than 50 words of it
    want = _plain(rows)
    for most in (1 << 20, 0):  # by maps and broadcasts, and by joins
        got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most_mapped=most, most_ends=most).collect()}
        for (i, text), (_, gone, cut) in want.items():
            assert (got[i].words_removed, got[i].text) == (gone, cut)
            if i >= 10_000 or i % 10 == 0:
                assert got[i].text == text
    caught = sum(p not in got[10 * k + c].text and got[10 * k + c].words_removed == len(p.split()) for k, p in enumerate(passages) for c in (1, 2))
    assert caught >= 0.97 * 2 * len(passages)
    assert all(passages[k] in got[10 * k].text for k in range(len(passages)))


def test_nulls_repeats_and_odd_texts(spark):
    passage = "\n".join(" ".join(f"word{k}{c}" for c in "abcdefgh") for k in range(30))
    own = ["\n".join(f"own{t} has{t} line{k}of{t} alone{t}" for k in range(8)) for t in range(4)]
    rows = [(1, own[0] + "\n" + passage + "\n" + own[1]), (2, own[2] + "\n" + passage + "\n" + own[3]), (3, passage), (3, passage), (None, passage), (None, None), (None, None), (4, ""), (5, "short\nline"), (6, "short\nline"), (7, "\n\n \n"), (8, "a" * 300_000), (9, "the " * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string")
    got = [r.asDict() for r in line_dedup.dedup_lines(df).collect()]
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["words_removed"] == 0 and by[2][0]["text"] == own[2] + "\n" + own[3] and by[2][0]["lines_removed"] == 30
    assert by[3][0] == by[3][1] and by[3][0]["text"] == "" and by[3][0]["lines_removed"] == 30
    assert sorted(str(r["text"]) for r in by[None]) == ["", "None", "None"]
    assert all(r["n_lines"] == 0 for r in by[None] if r["text"] is None)
    assert [by[k][0]["text"] for k in (4, 5, 6, 7, 8, 9)] == [t for i, t in rows if i in (4, 5, 6, 7, 8, 9)]
    assert by[9][0]["n_words"] == 200_000
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_the_first_copy_stays_whole_when_others_only_share_a_part(spark):
    a = " ".join(f"alpha{k}" for k in range(200))
    part = " ".join(a.split()[60:140])
    rows = [(1, a), (2, f"something else {part} and more"), (3, f"once more {part}")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: "something else and more", 3: "once more"}


def test_texts_are_not_chunked_again_to_cut_runs(monkeypatch):
    """Chunks carry the numbers of their words: hashing texts anew took a third of the last pass. A run grows by what is common beside it."""
    monkeypatch.setattr(line_dedup, "Chunks", None)
    text = "a b c\nd e f\n\ng h"
    runs = [{"at": 2, "side": line_dedup._BEFORE, "beside": b"x  b"}, {"at": 5, "side": line_dedup._AFTER, "beside": b"f g y"}]
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.list_(pa.struct([("at", pa.int32()), ("side", pa.int32()), ("beside", pa.binary())])))]
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": text, "runs": runs}, {"doc_id": 2, "text": "p q", "runs": None}], pa.schema(kinds))
    (got,) = line_dedup._cut(3)(iter([batch]))
    assert [r | {"text": r["text"].split()} for r in got.to_pylist()] == [
        {"doc_id": 1, "n_lines": 4, "lines_removed": 1, "n_words": 8, "words_removed": 6, "text": ["a", "h"]},
        {"doc_id": 2, "n_lines": 1, "lines_removed": 0, "n_words": 2, "words_removed": 0, "text": ["p", "q"]},
    ]
