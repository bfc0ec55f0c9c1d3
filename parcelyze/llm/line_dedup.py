"""Line dedup: repeated passages are removed, found as content-defined chunks of lines.

1. Lines: a text is split at line feeds, and a line is split further after each word at which a hash that rolls over two
   words has a local minimum, as prose often has a whole paragraph in one line. A hash that rolls over two of these
   lines' hashes ends a chunk where it has a local minimum. What is cut depends on a few words about it only, so a
   passage falls to the same chunks wherever it stands, whether or not it begins with a line of its own.
2. Chunks are counted over the whole table by hash. The repeated hashes set bits of a map, which is broadcast if they are at
   most ``most_mapped``; beyond, chunks are joined to them. Only chunks that may repeat go on with their bytes.
3. Those are grouped by hash and bytes, so equal hashes of different bytes are different chunks. A chunk's first
   occurrence (in order of id, text, place) stays; the others are repeats of it.
4. A run of adjacent repeats grows at both ends by the words (``REACH`` at most) that it has in common there with the first
   occurrence, whose text is asked for them: boundaries differ only close to a passage's ends. A run of more than
   ``least_words`` words is removed, with the white space after it, or that before it if only the space after has a line
   feed or nothing follows. Of each removed word a copy stays that stands earlier, with the same neighbours.

A passage is not found if no chunk lies within it whole; chunks have about nine words, and at least four unless lines are
shorter.

Defined results. A null text has no lines and stays null; an empty one is one empty line. Rows that repeat an id
and a text are one document: they give equal rows and do not count as copies of each other. Null ids come last in the
order, and are told apart by their texts. Ties in the order do not arise otherwise. Very long texts are cut like all others;
a text of one repeated word, or without spaces, is one chunk. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, Words, byte_spans, drop_written, mix, slices, small_batches, word_bounds, written

_ROLL = np.uint64(0xD6E8FEB86659FD93)
#: Repeated hashes that a map of bits is made of at most, and run ends that are broadcast at most.
MOST_MAPPED, MOST_ENDS = 1 << 24, 1 << 20
#: Words by which a run grows at most at either end.
REACH = 64

SCHEMA = "doc_id long, n_lines long, lines_removed long, n_words long, words_removed long, text string"
_FOUND = ["doc_id", "text_key", "text_mark", "head", "tail", "hash", "bytes"]
_KEYS = ["text_key", "text_mark"]
_BEFORE, _AFTER = 0, 1


def rolled(hashes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A hash of each entry and the one before it; ``fresh`` entries have none before."""
    before = np.zeros_like(hashes)
    before[1:] = hashes[:-1]
    before[fresh] = 0
    with np.errstate(over="ignore"):
        return mix(before * _ROLL + hashes)


def minima(keys: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether each key is below both of its neighbours; ``fresh`` ones begin a sequence, and outside it nothing is lower."""
    out = np.ones(len(keys), bool)
    out[1:] &= fresh[1:] | (keys[1:] < keys[:-1])
    out[:-1] &= fresh[1:] | (keys[:-1] < keys[1:])
    return out


class Chunks:
    """The chunks of a slice of texts.

    words: its words; lines: how many line feeds stand before each word; head, tail: each chunk's first word and that
    after its last; hashes: of its bytes, from the first word's first to the last word's last; first: each row's first chunk.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = self.words = Words(raw, offsets, fold=False)
        n = len(w.starts)
        feeds = np.flatnonzero(raw == 10)
        self.feeds = np.diff(np.searchsorted(feeds, offsets))
        self.lines = np.searchsorted(feeds, w.starts)
        begins = np.zeros(n, bool)  # a row's first word
        begins[w.first[:-1][np.diff(w.first) > 0]] = True
        fresh = begins.copy()  # a line's first word
        fresh[1:] |= self.lines[1:] != self.lines[:-1]
        ends = minima(rolled(w.hashes, fresh), fresh)
        ends[:-1] |= fresh[1:]
        ends[-1:] = True
        last = np.flatnonzero(ends)
        line_head = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if n else last
        opens = begins[line_head]
        chunk_ends = minima(rolled(w.spans.hashes(w.starts[line_head], w.ends[last]), opens), opens)
        chunk_ends[:-1] |= opens[1:]
        chunk_ends[-1:] = True
        stop = np.flatnonzero(chunk_ends)
        start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64) if n else stop
        self.head, self.tail = line_head[start], last[stop] + 1
        self.starts, self.ends = w.starts[self.head], w.ends[self.tail - 1]
        self.hashes = w.spans.hashes(self.starts, self.ends)
        self.first = np.searchsorted(self.head, w.first)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> how often each chunk's hash occurs in a slice."""
    for batch in batches:
        for _, _, raw, at in slices(batch.column(0)):
            found, n = np.unique(Chunks(raw, at).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words each text has."""
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def _mapped(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _chunks(held):
    """(doc_id, text_key, text_mark, text) -> a row for each chunk, of those in the map if there is one (``_FOUND``).

    head, tail: the chunk's first word and that after its last, by their numbers in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in slices(batch.column(3)):
                c = Chunks(raw, at)
                some = np.arange(len(c.hashes)) if held is None else np.flatnonzero(_mapped(c.hashes, held.value))
                rows = np.repeat(np.arange(j - i), np.diff(c.first))[some]
                own = [batch.column(k).slice(i, j - i).take(pa.array(rows)) for k in range(3)]
                head, tail = (pa.array((x[some] - c.words.first[rows]).astype(np.int32)) for x in (c.head, c.tail))
                yield pa.RecordBatch.from_arrays([*own, head, tail, pa.array(c.hashes[some].view(np.int64)), byte_spans(raw, c.starts[some], c.ends[some])], _FOUND)

    return run


def _bits(twice: DataFrame, n: int) -> np.ndarray:
    """A map with a bit set for the top bits of each hash: 32 bits a hash, or as many as there may be."""
    size = min(27, max(20, math.ceil(math.log2(32 * n + 1))))
    at = F.shiftrightunsigned("hash", 64 - size)
    words = twice.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text_mark, text, asked: numbers of words and sides) -> the words beside each place asked for."""
    for batch in batches:
        asked = batch.column(3).to_pylist()
        for i, j, raw, at in slices(batch.column(2)):
            starts, ends, first = word_bounds(raw, at)
            out = []
            for r in range(j - i):
                a, b = int(first[r]), int(first[r + 1])
                for x in asked[i + r]:
                    k = a + x["at"]
                    p, q = (max(a, k - REACH), k) if x["side"] == _BEFORE else (k, min(b, k + REACH))
                    out.append((r, x["at"], x["side"], raw[starts[p] : ends[q - 1]].tobytes() if q > p else b""))
            own = [batch.column(k).slice(i, j - i).take(pa.array([o[0] for o in out], pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], ["kept_key", "kept_mark", "kept_at", "side", "beside"])


def common_head(a: list[bytes], b: list[bytes]) -> int:
    """How many words at the beginning of both are equal."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _gone(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, a: int, b: int, ends: list[dict], least_words: int) -> np.ndarray:
    """Which of the words a to b, a text's own, go. starts, stops: byte positions of words; ends: the runs' ends, by the number of
    the first word in or behind, their sides, and what stands there beside the first occurrence."""
    said = lambda p, q: raw[starts[p] : stops[q - 1]].tobytes().split() if p < q else []
    out = np.zeros(b - a, bool)
    heads, tails = (sorted((r["at"], r["beside"]) for r in ends if r["side"] == side) for side in (_BEFORE, _AFTER))
    for (first, before), (last, after) in zip(heads, tails):
        begin, end = a + first, a + last
        left, right = before.split(), after.split()
        begin -= common_head(said(max(a, begin - len(left)), begin)[::-1], left[::-1])
        end += common_head(said(end, min(b, end + len(right))), right)
        if end - begin > least_words:
            out[begin - a : end - a] = True
    return out


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int, stop: int, gone: np.ndarray) -> bytes:
    """A text without some of its words; starts, ends: byte positions of its words, begin, stop: its own."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    parts, at = [], begin
    for p, q in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        lead = raw[ends[p - 1] if p else begin : starts[p]]
        trail = raw[ends[q - 1] : starts[q] if q < len(starts) else stop]
        # One of the two spaces stays: that with a line feed, if only one has.
        if q == len(starts) or (trail == 10).any() and not (lead == 10).any():
            cut, on = (ends[p - 1] if p else begin), ends[q - 1]
        else:
            cut, on = starts[p], starts[q]
        parts.append(raw[at:cut].tobytes())
        at = on
    parts.append(raw[at:stop].tobytes())
    return b"".join(parts)


def _cut(least_words: int):
    """(doc_id, text, ends of runs) -> the result's rows. Only texts with runs are split into words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            counts = np.concatenate([word_counts(raw, at) for _, _, raw, at in slices(texts)]) if len(texts) else np.zeros(0, np.int64)
            lines = np.where(null, 0, np.concatenate([np.diff(np.searchsorted(np.flatnonzero(raw == 10), at)) + 1 for _, _, raw, at in slices(texts)]) if len(texts) else 0)
            lines_gone, words_gone = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            some = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            ends = batch.column(2).take(pa.array(some)).to_pylist()
            new: dict[int, bytes] = {}
            for i, j, raw, at in slices(texts.take(pa.array(some))):
                starts, stops, first = word_bounds(raw, at)
                feeds = np.flatnonzero(raw == 10)
                for r in range(j - i):
                    a, b = int(first[r]), int(first[r + 1])
                    gone = _gone(raw, starts, stops, a, b, ends[i + r], least_words)
                    if gone.any():
                        k = int(some[i + r])
                        words_gone[k] = gone.sum()
                        own = np.searchsorted(feeds, starts[a:b])
                        lines_gone[k] = len(np.unique(own)) - len(np.unique(own[~gone]))
                        new[k] = _kept(raw, starts[a:b], stops[a:b], int(at[r]), int(at[r + 1]), gone)
            if new:
                mask = np.zeros(len(texts), bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[k] for k in sorted(new)], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (lines, lines_gone, counts, words_gone)), texts], [f.split(" ")[0] for f in SCHEMA.split(", ")])

    return run


def _identity(text: Column, doc_id: Column) -> list[Column]:
    """128 bits that tell documents apart: of the id and the text's length, and of the text. Null texts match nothing."""
    return [F.when(text.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("none")), F.length(text))).alias("text_key"), F.xxhash64(text).alias("text_mark")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 50, most_mapped: int = MOST_MAPPED, most_ends: int = MOST_ENDS) -> DataFrame:
    """(doc_id, n_lines, lines_removed, n_words, words_removed, text) for each row; see the module's text.

    lines_removed: lines that had words and have none left.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", *_identity(F.col("text"), F.col("doc_id")), "text")
    some = rows.where("text is not null")
    counts = some.select("text").mapInArrow(_hashes, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    twice = written(counts.where("n > 1").select("hash"), "twice")
    n = twice.count()
    held = spark.sparkContext.broadcast(_bits(twice, n)) if n <= most_mapped else None
    found = some.mapInArrow(_chunks(held), "doc_id long, text_key long, text_mark long, head int, tail int, hash long, bytes binary")
    if held is None:
        found = found.join(twice.hint("merge"), "hash", "left_semi").select(_FOUND)
    found = written(found, "found")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_mark", "text_key", "head", "tail")
    first = found.groupBy("hash", "bytes").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("hash", "bytes", F.col("kept.text_key").alias("kept_key"), F.col("kept.text_mark").alias("kept_mark"), F.col("kept.head").alias("kept_head"), F.col("kept.tail").alias("kept_tail")), "first")
    again = found.join(first.hint("merge"), ["hash", "bytes"]).where("text_key <> kept_key or text_mark <> kept_mark or head <> kept_head")
    # Chunks are adjacent if one begins where the other ends. A row that repeats an id and a text gives its chunks again: one of them begins or ends a run.
    run = Window.partitionBy(*_KEYS).orderBy("head")
    again = again.select(*_KEYS, "head", "tail", "kept_key", "kept_mark", "kept_head", "kept_tail")
    again = again.withColumn("begins", F.coalesce(F.lag("tail").over(run) < F.col("head"), F.lit(True))).withColumn("ends", F.coalesce(F.lead("head").over(run) > F.col("tail"), F.lit(True)))
    kept = ["kept_key", "kept_mark", "kept_at"]
    end = lambda side, own: F.struct(F.lit(side).alias("side"), F.col(own).alias("at"), F.col(f"kept_{own}").alias("kept_at"))
    either = F.array_compact(F.array(F.when(F.col("begins"), end(_BEFORE, "head")), F.when(F.col("ends"), end(_AFTER, "tail"))))
    ends = written(again.where("begins or ends").select(*_KEYS, "kept_key", "kept_mark", F.inline(either)), "ends")
    asked = written(ends.select(*kept, "side").distinct().groupBy("kept_key", "kept_mark").agg(F.collect_list(F.struct(F.col("kept_at").alias("at"), "side")).alias("asked")).toDF(*_KEYS, "asked"), "asked")
    few = (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= most_ends
    told = some.join(F.broadcast(asked) if few else asked.hint("merge"), _KEYS).select(*_KEYS, "text", "asked")
    told = written(told.mapInArrow(_surroundings, "kept_key long, kept_mark long, kept_at int, side int, beside binary").dropDuplicates([*kept, "side"]), "told")
    runs = ends.join(told.hint("merge"), [*kept, "side"]).groupBy(*_KEYS).agg(F.collect_list(F.struct("at", "side", "beside")).alias("runs"))
    runs = written(runs, "runs")
    drop_written(twice, found, first, ends, asked, told)
    return rows.join(runs.hint("merge"), _KEYS, "left").select("doc_id", "text", "runs").mapInArrow(_cut(least_words), SCHEMA)
