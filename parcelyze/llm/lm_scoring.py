"""Language-model scoring by a weighted backoff automaton.

The model: words and pairs of words, counted over all training documents; none is cut off. P(w) is the base estimate
(c(w) + 0.1) / (N + 0.1 (V + 1)); with absolute discounting P(w | u) = max(c(u w) - D, 0) / c(u) + D T(u) / c(u) P(w),
where T(u) counts the different words seen after u and D = n1 / (n1 + 2 n2) comes from the pairs seen once and twice;
it sums to one for any u. As an automaton: the root has an arc for each word; a state for each context u has arcs for
the pairs seen after u, with weight log10 P(w | u), and one failure arc to the root, with weight log10 D T(u) / c(u)
(0 for an unseen u). A text starts in the state of the boundary, is read once from left to right, and adds up weights; an
absent arc means the failure arc and the root's arc for the same word. Words that training lacks have the root's
arc of count 0.

How it scales: texts are read once and packed into blocks of tokens (dictionary and indices). Each block sends its
distinct words and pairs with their training counts, as sorted and compressed hash ranges, to shards; a shard adds up
counts and answers each block in the block's own order. So a block gets just the part of the automaton that
its documents can reach, whole counts included, and nothing is broadcast or collected but N, V, n1 and n2. T(u) takes
a second exchange: a shard names one owner among the blocks that hold a pair, owners count their pairs by context, and
the words' shards add these up. Shards grow in number with the entries sent, blocks with the tokens; a frequent word
is one entry a block.

Words are identified by 64-bit hashes. The model ends at pairs: counts of triples as well would go through the same
exchanges and about double what is shuffled. Defined results. Null or empty text: the end token only. A null id is scored,
never learned from, and not held out. Rows that repeat, or repeat an id, give a row each. Without training documents
N = V = 0 and all words are unknown. Very long texts are read whole. Ties do not arise. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import remainder
from .shared import Words, mix, slices, small_batches, written

END = np.uint64(0xE4D0E4D0E4D0E4D1)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: A shard is sent about so many entries, over all blocks.
SHARD_ENTRIES = 2_000_000


def squeeze(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def pair_hashes(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it; END stands before each document's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = END
    with np.errstate(over="ignore"):
        return mix(mix(before + _GAMMA) + tokens)


_BLOCK = "block long, ids array<long>, train array<boolean>, held_out array<boolean>, lengths binary, words binary, tokens binary, entries long"


def _pack(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([h[3] for h in held])
            lengths = np.concatenate([h[4] for h in held])
            words, index, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers: their high bytes compress away
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            flat = [pa.concat_arrays([h[k] for h in held]) for k in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(f)], pa.int32()), f) for f in flat]
            cells = [squeeze(lengths.astype(np.int64)), squeeze(words[order]), squeeze(rank[index].astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), *lists, *(pa.array([c], pa.binary()) for c in cells), pa.array([len(words) + len(tokens)], pa.int64())], ["block", "ids", "train", "held_out", "lengths", "words", "tokens", "entries"])

        for batch in batches:
            for i, j, raw, at in slices(batch.column(3)):
                w = Words(raw, at)
                n = np.diff(w.first)
                tokens = np.insert(w.hashes, w.first[1:], END)
                held.append((*(batch.column(k).slice(i, j - i) for k in range(3)), tokens, n + 1))
                size += len(tokens)
                if size >= block_tokens:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


class TokenBlock:
    """A packed block, opened: distinct words and pairs in ascending order, and each token's place among them."""

    def __init__(self, lengths: bytes, words: bytes, tokens: bytes):
        self.lengths = expand(lengths, np.int64)
        names, index = expand(words, np.uint64), expand(tokens, np.uint32)
        order = np.argsort(names)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.word_at = names[order], rank[index]
        self.pairs, self.pair_at = np.unique(pair_hashes(names[index], self.lengths), return_inverse=True)
        #: The state before each token: the word before it, or the boundary.
        self.states = np.empty_like(self.word_at)
        self.states[1:] = self.word_at[:-1]
        self.states[np.cumsum(self.lengths) - self.lengths] = np.searchsorted(self.words, END)
        some = np.zeros(len(self.pairs), np.int64)
        some[self.pair_at] = np.arange(len(self.pair_at))
        self.pair_context, self.pair_word = self.states[some], self.word_at[some]


def _edges(shards: int) -> np.ndarray:
    """Where the shards' hash ranges meet."""
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


def _request(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple]:
    cuts = [0, *np.searchsorted(keys, edges), len(keys)]
    return [(s, block, kind, squeeze_sorted(keys[x:y]), squeeze(counts[x:y].astype(np.uint32))) for s, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]


_REQUEST = "shard int, block long, kind int, keys binary, counts binary"
_REQUEST_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _requests(shards: int):
    """Kind 1: a block's words, kind 2: its pairs; each with the counts in its training documents."""
    edges = _edges(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, train, lengths, words, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                b = TokenBlock(lengths, words, tokens)
                learn = np.repeat(np.array(train, bool), b.lengths)
                rows = [r for kind, keys, at in ((1, b.words, b.word_at), (2, b.pairs, b.pair_at)) for r in _request(block, kind, keys, np.bincount(at[learn], minlength=len(keys)), edges)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_REQUEST_KINDS)], ["shard", "block", "kind", "keys", "counts"])

    return run


def _context_requests(shards: int):
    """Kind 3: a block's words, each with the number of pairs after it that the block owns."""
    edges = _edges(shards)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        answers = sorted((r["shard"], r["owned"], r["size"]) for r in right.to_pylist())
        for row in left.to_pylist():
            b = TokenBlock(row["lengths"], row["words"], row["tokens"])
            owned = np.concatenate([np.unpackbits(np.frombuffer(a[1], np.uint8), count=a[2]) for a in answers]).astype(bool)
            rows += _request(row["block"], 3, b.words, np.bincount(b.pair_context[owned], minlength=len(b.words)), edges)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_REQUEST_KINDS)], ["shard", "block", "kind", "keys", "counts"])

    return run


_ANSWER = "shard int, block long, kind int, size int, counts binary, owned binary, x long, y long"


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one shard: each request gets the total counts of its keys, in its order, and which pairs it owns.

    A row without a block has the shard's sums: distinct words and tokens of training, or pairs seen once and twice.
    """
    rows = table.to_pylist()
    out = []
    for kind in (1, 2, 3):
        mine = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["block"])
        if not mine:
            continue
        keys = [expand_sorted(r["keys"]) for r in mine]
        counts = np.concatenate([expand(r["counts"], np.uint32) for r in mine])
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(index, counts.astype(np.float64)).astype(np.uint64)
        got = total[index]
        owned = np.zeros(len(counts), bool)
        if kind == 2:  # the first block that has the pair in training
            there = np.flatnonzero(counts)
            owned[there[np.unique(index[there], return_index=True)[1]]] = True
        end = 0
        for r, k in zip(mine, keys):
            end += len(k)
            bits = np.packbits(owned[end - len(k) : end]).tobytes() if kind == 2 else None
            out.append((r["shard"], r["block"], kind, len(k), squeeze(got[end - len(k) : end]), bits, 0, 0))
        sums = {1: ((total > 0).sum(), total.sum()), 2: ((total == 1).sum(), (total == 2).sum()), 3: (0, 0)}[kind]
        out.append((mine[0]["shard"], None, kind, 0, None, None, int(sums[0]), int(sums[1])))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["shard", "block", "kind", "size", "counts", "owned", "x", "y"])


class BackoffAutomaton:
    """The part of the model that a block's documents can reach. States are words; the boundary's is that of END.

    root: weight of the root's arc for each word; fail: weight of each state's failure arc; source, target, arc: each pair's
    arc, with NaN as its weight where training lacks the pair.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, after: np.ndarray, pair_context: np.ndarray, pair_word: np.ndarray, boundary: int, n: int, v: int, discount: float):
        c = words.astype(np.float64)
        p = (c + 0.1) / (n + 0.1 * (v + 1))
        left = np.where(c > 0, discount * after.astype(np.float64) / np.maximum(c, 1), 1.0)
        self.boundary = boundary
        self.root = np.log10(p)
        self.fail = np.log10(left)
        seen = pairs.astype(np.float64)
        direct = np.maximum(seen - discount, 0) / np.maximum(c[pair_context], 1) + left[pair_context] * p[pair_word]
        self.source, self.target, self.arc = pair_context, pair_word, np.where(pairs > 0, np.log10(direct), np.nan)

    def traverse(self, lengths: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Each text's log10 probability: all texts of a block are read together, a token of each at a step.

        words, pairs: the word and the only pair that could leave its text's state, for each token. A step takes the arc of the
        state that is carried, or fails to the root and takes the root's arc; either leads to the next state.
        """
        order = np.argsort(-lengths, kind="stable")  # texts that are still read stay in front
        size, at = lengths[order], (np.cumsum(lengths) - lengths)[order]
        state, total = np.full(len(lengths), self.boundary), np.zeros(len(lengths))
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, k in enumerate(live.tolist()):
            w, p, now = words[at[:k] + t], pairs[at[:k] + t], state[:k]
            weight = self.arc[p]
            failed = np.isnan(weight) | (self.source[p] != now)
            total[:k] += np.where(failed, self.fail[now] + self.root[w], weight)
            state[:k] = np.where(failed, w, self.target[p])
        out = np.empty_like(total)
        out[order] = total
        return out


def _score(n: int, v: int, discount: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = sorted((r["kind"], r["shard"], r["counts"]) for r in right.to_pylist())
        for row in left.to_pylist():
            b = TokenBlock(row["lengths"], row["words"], row["tokens"])
            words, pairs, after = (np.concatenate([expand(a[2], np.uint64) for a in answers if a[0] == kind]) for kind in (1, 2, 3))
            machine = BackoffAutomaton(words, pairs, after, b.pair_context, b.pair_word, int(np.searchsorted(b.words, END)), n, v, discount)
            starts = np.cumsum(b.lengths) - b.lengths
            known, base = (np.add.reduceat(x, starts) for x in ((words > 0)[b.word_at].astype(np.int64), machine.root[b.word_at]))
            score = machine.traverse(b.lengths, b.word_at, b.pair_at)
            out.append(pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(b.lengths), pa.array(known), pa.array(np.full(len(b.lengths), n, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 10, held_out: int = 0, block_tokens: int = 1_500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; see the module's text.

    Learns from documents outside the held-out fold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = remainder(F.col("doc_id"), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(fold != held_out, F.lit(False)).alias("train"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    blocks = written(rows.mapInArrow(_pack(block_tokens), _BLOCK), "blocks")
    entries, count = blocks.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.count("*")).first()
    shards, tasks = max(1, math.ceil(entries / SHARD_ENTRIES)), max(2, count)  # a task a block, however many there are

    def answered(asked: DataFrame) -> DataFrame:
        return written(asked.repartition(max(shards, 2), "shard").groupBy("shard").applyInArrow(_answer, _ANSWER), "answers")

    first = answered(blocks.select("block", "train", "lengths", "words", "tokens").mapInArrow(_requests(shards), _REQUEST))
    sums = {r[0]: r[1:] for r in first.where("block is null").groupBy("kind").agg(F.sum("x"), F.sum("y")).collect()}
    (v, n), (once, twice) = sums.get(1, (0, 0)), sums.get(2, (0, 0))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    by_block = blocks.select("block", "lengths", "words", "tokens").repartition(tasks, "block").groupBy("block")
    owners = first.where("block is not null and kind = 2").select("block", "shard", "owned", "size").repartition(tasks, "block").groupBy("block")
    second = answered(by_block.cogroup(owners).applyInArrow(_context_requests(shards), _REQUEST))
    totals = first.union(second).where("block is not null").select("block", "shard", "kind", "counts").repartition(tasks, "block").groupBy("block")
    return blocks.select("block", "ids", "held_out", "lengths", "words", "tokens").repartition(tasks, "block").groupBy("block").cogroup(totals).applyInArrow(_score(n, v, discount), SCHEMA)
