"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

1. A document is the set of its distinct word shingles. For every element a pseudo-random permutation deals one
   slot to each rank, and the value rank + fraction competes in that slot; the least stays. Ranks are taken in
   turn, and a document is left as soon as each of its slots holds a value below the next rank (early stop).
2. Documents with equal sets fold into the least id of theirs, so groups of copies cost one row.
3. Bands of the signature are posted; bucket mates join the bucket's least id, and the components of these unverified
   edges hold every pair that shares a band: coarse groups, in each of which a document's set is held once.
4. Inside a coarse group links are confirmed on full sets, with union-find and an inverted index, so that
   pairs which are connected already are not compared and at most one edge a document comes out. A group beyond
   ``chunk`` documents is dealt to chunks that also get the group's least document; what then lies outside the
   group's largest part is compared with all of the group, chunk against chunk. No pairs are enumerated as rows.

A pair at similarity 0.8 shares no band of 5 out of 51 with probability 2e-9 (and then is linked only by way of
others); every link that is reported is exact, up to 64-bit hashes of shingles.

Defined results. Null text or text without words: empty set, n_shingles 0, a component of its own. A null id is
linked with nothing: component_id null, kept true. Rows that repeat an id and text give equal rows; an id with
several texts is one node with the links of all of them. Very long texts are whole sets like all others. Ties do not arise: a
component's id is its least. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import Words, binary_array, chained, drop_written, joined_ranges, mix, row_of, slices, small_batches, written

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each row's distinct shingle hashes, ascending; a row of fewer words has its whole sequence."""
    w = Words(raw, offsets)
    n = np.diff(w.first)
    runs = chained(w.hashes, words)
    count = np.maximum(n - words + 1, 0)
    at = joined_ranges(w.first[:-1], count)
    values, rows = runs[at], np.repeat(np.arange(len(n)), count)
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.array([chained(w.hashes[w.first[i] : w.first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
        values, rows = np.concatenate([values, mix(whole + n[short].astype(np.uint64))]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))


def superminhash(values: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows, slots) of sets of 64-bit values; rows without elements keep the largest value everywhere."""
    rows = len(bounds) - 1
    sig = np.full(rows * slots, _UNSET, np.uint64)
    own = row_of(bounds)
    perm: np.ndarray | None = None
    first = second = None
    for rank in range(slots):
        if not len(values):
            break
        with np.errstate(over="ignore"):
            r = mix(values + np.uint64(rank + 1) * _GAMMA)
        slot = rank + (((r & np.uint64(0xFFFF)).astype(np.int64) * (slots - rank)) >> 16)
        if rank == 0:
            first = slot
            dealt = slot
        elif rank == 1:  # after the first swap slot `first` holds 0
            second = slot
            dealt = np.where(slot == first, 0, slot)
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(values), 1))
                every = np.arange(len(values))
                perm[every, first] = 0
                perm[every, second] = perm[every, 1]
                # slot 1 itself held `first`'s swap only if first == 1, where perm[:, 1] is 0 by now
            every = np.arange(len(values))
            dealt = perm[every, slot].astype(np.int64)
            perm[every, slot] = perm[every, rank]
        np.minimum.at(sig, own * slots + dealt, (np.uint64(rank) << np.uint64(48)) | (r >> np.uint64(16)))
        open_rows = np.zeros(rows, bool)
        here = np.unique(own)
        open_rows[here] = sig.reshape(rows, slots)[here].max(axis=1) >= (np.uint64(rank + 1) << np.uint64(48))
        stay = open_rows[own]
        if not stay.all():
            values, own, first = values[stay], own[stay], first[stay]
            second = second[stay] if second is not None else None
            perm = perm[stay] if perm is not None else None
    return sig.reshape(rows, slots)


def _signatures(words: int, bands: int, rows_a_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in slices(batch.column(1)):
                values, bounds = shingle_sets(raw, at, words)
                n = np.diff(bounds)
                sig = superminhash(values, bounds, bands * rows_a_band).reshape(j - i, bands, rows_a_band)
                keys = np.zeros((j - i, bands), np.uint64)
                with np.errstate(over="ignore"):
                    keys += np.arange(1, bands + 1, dtype=np.uint64) * _GAMMA
                    for k in range(rows_a_band):
                        keys = mix(keys + sig[:, :, k])
                    ends = np.zeros(len(values) + 1, np.uint64)
                    marks = []
                    for salt in (1, 2):
                        np.cumsum(mix(values + np.uint64(salt) * _GAMMA), out=ends[1:])
                        marks.append((ends[bounds[1:]] - ends[bounds[:-1]]).view(np.int64))
                full = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(marks[0]), pa.array(marks[1]), full], ["doc_id", "n_shingles", "mark1", "mark2", "bands"])

    return run


def _sets(words: int):
    """(rep, coarse, parts, mark1, mark2, text) -> (coarse, rep, parts, n, shingles as bytes), for the text with those marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)]
            for i, j, raw, at in slices(batch.column(5)):
                values, bounds = shingle_sets(raw, at, words)
                ends = np.zeros(len(values) + 1, np.uint64)
                good = np.ones(j - i, bool)
                with np.errstate(over="ignore"):
                    for salt in (1, 2):
                        np.cumsum(mix(values + np.uint64(salt) * _GAMMA), out=ends[1:])
                        good &= (ends[bounds[1:]] - ends[bounds[:-1]]).view(np.int64) == want[salt - 1][i:j]
                data = values.tobytes()
                part = [data[8 * bounds[k] : 8 * bounds[k + 1]] for k in range(j - i)]
                cols = [batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), binary_array(part)]
                yield pa.RecordBatch.from_arrays(cols, ["coarse", "rep", "parts", "n", "shingles"]).filter(pa.array(good))

    return run


class _Finder:
    """Union-find over positions; the root is the least position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def link_block(sets: list[np.ndarray], parts: list[int], rows: list[int] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join all linked positions which ``parts`` does not join yet.

    rows: the positions to compare with all others; None: as many as it takes so that each pair in different parts has
    been compared. Each row is counted against the whole block through an inverted index, and left out if
    it needs no comparison.
    """
    n = len(sets)
    finder, seen = _Finder(n), {}
    for i, p in enumerate(parts):
        finder.union(seen.setdefault(p, i), i)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat := np.concatenate(sets) if n else np.zeros(0, np.uint64), kind="stable")
    flat, posted = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(flat)))
    keys = flat[begin]
    edges = []

    def compare(i: int) -> None:
        at = np.searchsorted(keys, sets[i])
        common = np.bincount(posted[joined_ranges(begin[at], length[at])], minlength=n)
        for j in np.flatnonzero(den * common >= num * (size[i] + size - common)):
            if j != i and common[j] and finder.union(i, int(j)):
                edges.append((i, int(j)))

    if rows is not None:
        for i in rows:
            compare(i)
        return edges
    done = np.zeros(n, bool)
    while True:
        roots = np.array([finder.root(i) for i in range(n)])
        names, counts = np.unique(roots, return_counts=True)
        if len(names) < 2:
            return edges
        left = np.flatnonzero(~done & (roots != names[counts.argmax()]))
        if not len(left):
            return edges
        if not done.any():
            left = np.array([int(size.argmax())])  # one wide comparison joins most of a tight group
        for i in left[: max(1, len(left) // 4)]:
            done[i] = True
            compare(int(i))


def _link(num: int, den: int, crossed: bool):
    """Groups of consecutive rows with one (coarse, block) -> edges (u, v)."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        # (coarse, block, rep, part, outside, shingles)
        once: dict[tuple, tuple] = {}  # a leader, or a row that asks, may come twice
        for r in rows:
            if (r[2], r[5]) not in once or r[4]:
                once[r[2], r[5]] = r
        rows = sorted(once.values(), key=lambda r: r[2])
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        ask = [i for i, r in enumerate(rows) if r[4]] if crossed else None
        return [(rows[a][2], rows[b][2]) for a, b in link_block(sets, [r[3] for r in rows], ask, num, den)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list[tuple[int, int]] = []
            for r in zip(*cols):
                if held and held[0][:2] != r[:2]:
                    out += solve(held) if len(held) > 1 else []
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["u", "v"])
        if len(held) > 1 and (out := solve(held)):
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _linked(blocks: DataFrame, num: int, den: int, crossed: bool) -> DataFrame:
    dealt = blocks.select("coarse", "block", "rep", "part", "outside", "shingles").repartition("coarse", "block").sortWithinPartitions("coarse", "block")
    return dealt.mapInArrow(_link(num, den, crossed), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, num: int = 80, den: int = 100, bands: int = 51, rows_a_band: int = 5, chunk: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; see the module's text.

    Two documents are linked if den * intersection >= num * union of their shingle sets.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = written(docs.mapInArrow(_signatures(words, bands, rows_a_band), "doc_id long, n_shingles long, mark1 long, mark2 long, bands array<long>"), "signatures")

    reps = written(sig.where("n_shingles > 0 and doc_id is not null").groupBy("mark1", "mark2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")
    posted = reps.select("rep", F.explode("bands").alias("band"))
    # Written, so that both sides of the join come straight from an exchange and a hot bucket's rows can be split.
    buckets = written(posted.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("band", "least"), "buckets")
    coarse = components(posted.join(buckets, "band").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    coarse = written(coarse.toDF("rep", "coarse"), "coarse")
    sizes = coarse.groupBy("coarse").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts"))
    wanted = coarse.join(sizes, "coarse").join(reps.select("rep", "mark1", "mark2"), "rep").select("rep", "coarse", "parts", "mark1", "mark2")
    sets = wanted.join(docs.where("doc_id is not null and text is not null"), F.col("rep") == F.col("doc_id")).select("rep", "coarse", "parts", "mark1", "mark2", "text")
    sets = written(sets.mapInArrow(_sets(words), "coarse long, rep long, parts int, n long, shingles binary"), "sets")

    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    part, no = F.col("rep").alias("part"), F.lit(False).alias("outside")
    inside = sets.select("coarse", own.alias("block"), "rep", part, no, "shingles")
    leaders = sets.where("parts > 1 and rep = coarse").select("coarse", F.explode(F.expr("sequence(0, parts - 1)")).alias("block"), "rep", part, no, "shingles")
    edges = written(_linked(inside.union(leaders), num, den, False), "links")

    large = sets.where("parts > 1")
    if large.select("rep").first() is not None:
        found = components(edges).toDF("rep", "root")
        found = written(large.select("rep", "coarse", "parts").distinct().join(found, "rep", "left").select("rep", "coarse", "parts", F.coalesce("root", "rep").alias("part")), "parts")
        main = found.groupBy("coarse", "part").agg(F.count("*").alias("n")).groupBy("coarse").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        found = found.join(main, "coarse").withColumn("outside", F.col("part") != F.col("main"))
        rest = found.where("outside").groupBy("coarse").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("rest"))
        full = found.join(rest, "coarse").join(large.select("rep", "shingles"), "rep")
        full = written(full.select("coarse", "rep", "part", "outside", "parts", "rest", "shingles"), "large")
        i, j = own, F.pmod(F.xxhash64("rep"), F.col("rest")).cast("int")
        every = full.select("coarse", F.explode(F.transform(F.expr("sequence(0, rest - 1)"), lambda k: k * F.col("parts") + i)).alias("block"), "rep", "part", no, "shingles")
        asked = full.where("outside").select("coarse", F.explode(F.transform(F.expr("sequence(0, parts - 1)"), lambda k: j * F.col("parts") + k)).alias("block"), "rep", "part", F.lit(True).alias("outside"), "shingles")
        more = written(_linked(every.union(asked), num, den, True), "links")
        edges = edges.union(more)
    # An id with several texts joins the nodes of all of them.
    several = sig.where("n_shingles > 0").groupBy("doc_id").agg(F.min("mark1").alias("a"), F.max("mark1").alias("b")).where("a <> b").select("doc_id")
    edges = edges.union(sig.join(several, "doc_id").join(reps, ["mark1", "mark2", "n_shingles"]).select("doc_id", "rep"))
    final = written(components(edges).toDF("rep", "root"), "components")
    drop_written(sets, coarse, buckets)
    named = reps.join(final, "rep", "left").select("mark1", "mark2", "n_shingles", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "n_shingles", "mark1", "mark2").join(named, ["mark1", "mark2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
