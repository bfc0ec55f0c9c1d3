"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows scans each text once.

Texts and benchmark items are normalised to words: A-Z lower-cased, all other ASCII but 0-9 and a-z apart. A window is
``window`` consecutive words of an item (an item of fewer is one window). The automaton's symbols are the benchmark's
words, so a state is a run of words, and a word that no item has leads back to the root; matches give word positions,
which are mapped to code points of the original text.

The benchmark's windows are counted first. Up to ``most_windows`` of them are one automaton that is broadcast; beyond
that, items are dealt by hash to several automata, each scans the texts once, and hits are united by text.

Defined results. Null or empty text has no words, no hits. Null items have no windows; items without an id stand as
the empty string; rows that repeat an item's id are one item. Rows that repeat a document give equal rows. Very long texts are
scanned whole. Windows that several items share count for each; ties do not arise. An empty benchmark hits nothing, an empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # for lower-cased text: A-Z count as separators
_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"
HIT_SCHEMA = "key long, mark long, words binary, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    w = words_of(text)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


class Automaton:
    """Aho-Corasick over word windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            for run in windows_of(text, window):
                owners.setdefault(tuple(self.symbols.setdefault(w, len(self.symbols) + 1) for w in run), set()).add(name)
        self.owners = list(owners.values())
        self.lengths = [len(k) for k in owners]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, k in enumerate(owners):
            self.machine.add_word(k, i)
        if owners:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """(which words are inside a match, items matched), or None."""
        if not self.owners:
            return None
        get = self.symbols.get
        found = list(self.machine.iter(tuple([get(w, 0) for w in words])))
        if not found:
            return None
        steps, items = np.zeros(len(words) + 1, np.int64), set()
        for end, k in found:
            steps[end + 1 - self.lengths[k]] += 1
            steps[end + 1] -= 1
            items |= self.owners[k]
        return np.cumsum(steps[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code point spans of the original text."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["n_words", "n_hit", "n_items", "items", "spans"]


def _batch(own: list[pa.Array], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS))], [*names, *_NAMES])


def _row(text: str | None, n: int, hit: np.ndarray | None, items: list[str]) -> tuple:
    return (n, int(hit.sum()) if hit is not None else 0, len(items), items, _spans(text, hit) if hit is not None else [])


def _scan_once(held, window: int, carry: bool):
    """(doc_id, text, and row if it is carried) -> the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(held.value, window)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                got = machine.scan(words) if words else None
                out.append(_row(text, len(words), got and got[0], sorted(got[1]) if got else []))
            yield _batch([batch.column(0), *batch.columns[2:]], ["doc_id", *(["row"] if carry else [])], out)

    return run


def _scan_part(held, window: int):
    """(key, mark, text) -> only documents with hits, for one of several automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(held.value, window)
        for batch in batches:
            at, masks, items = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                if words and (got := machine.scan(words)):
                    at.append(i)
                    masks.append(np.packbits(got[0]).tobytes())
                    items.append(sorted(got[1]))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["key", "mark", "words", "items"])

    return run


def _unite(carry: bool):
    """(doc_id, text, masks, lists, and row if it is carried) -> the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, masks, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                n = len(words_of(text))
                hit = np.zeros(n, bool) if masks else None
                for m in masks or []:
                    hit |= np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)
                out.append(_row(text, n, hit, sorted({x for xs in items or [] for x in xs})))
            yield _batch([batch.column(0), *batch.columns[4:]], ["doc_id", *(["row"] if carry else [])], out)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 13, most_windows: int = 50_000, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) for each document; see the module's text.

    carry: also gives ``row``, a struct of all columns of the row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    schema = "doc_id long, " + (f"row {docs.schema['row'].dataType.simpleString()}, " if carry else "") + SCHEMA
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    # No item has more windows than one for each two characters.
    total = bench.agg(F.sum(F.ceil(F.length("text") / 2))).first()[0] or 0
    parts = max(1, -(-total // (most_windows * 3)))
    if parts == 1:
        held = spark.sparkContext.broadcast([tuple(r) for r in bench.collect()])
        return docs.mapInArrow(_scan_once(held, window, carry), schema)
    # What is found in a text depends on the text: two hashes of it stand for it.
    key, mark = F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), F.length("text"), F.col("text")).alias("mark")
    texts, found = docs.where("text is not null").select(key, mark, "text"), None
    for k in range(parts):
        held = spark.sparkContext.broadcast([tuple(r) for r in bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()])
        one = texts.mapInArrow(_scan_part(held, window), HIT_SCHEMA)
        found = one if found is None else found.union(one)
    found = written(found.distinct().groupBy("key", "mark").agg(F.collect_list("words").alias("masks"), F.collect_list("items").alias("lists")), "hits")
    met = docs.select("*", key, mark).join(found, ["key", "mark"], "left").select("doc_id", "text", "masks", "lists", *(["row"] if carry else []))
    return met.mapInArrow(_unite(carry), schema)


def contamination_digest(found: DataFrame, *more: str) -> DataFrame:
    """The thin query's columns, and ``more`` of what was found: contaminated if at least one word in twenty is hit."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *more)
