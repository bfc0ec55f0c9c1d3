"""Token ids written to compact files: range-coded, checksummed blocks, read back to ids.

Documents are dealt by ranges of their id (and a hash of the text, so that one id cannot fill a task) and sorted; each
task tokenizes its texts, appends the end id to each, and packs whole documents to segments. A segment is one
record of the dataset; its bytes, all integers little-endian:

    magic "PTK1"; uint32 block size; uint64 ids; uint32 documents; uint32 blocks
    documents: uint8 whether it has an id; int64 id; uint32 ids of the document (each as one array)
    blocks: uint32 bytes; uint32 crc32 of the block's ids as uint32 (each as one array)
    the blocks' coded bytes, one after another (see ``id_coder``; each block starts from nothing)

Records lie in a Parquet dataset with the columns part, segment, n_ids (long) and data, so Spark's committer makes a
lost task's output vanish, and offsets are summed without reading data. Part and segment order is document order.

Python workers tokenize; segments are coded and read by functions of the session in the executors' JVMs (see ``jvm_coder``).
``pack_segment`` and ``unpack_segment`` do the same, to the same bytes, without a session.

Words repeat, so only pieces that a task has not met go through the tokenizer: texts are cut at white space, and a
chunk whose characters are ASCII or Latin-1 letters is cut further where the tokenizer's own pattern would cut it.

Defined results. Null or empty text: the end id alone. Null ids come first, are kept, and read back as null. Rows
that repeat are written as often. Rows of equal ids stand in order of a hash of their texts; equal texts are alike. Very long texts
are tokenized whole; a document's ids all lie in one segment. An empty table gives no segments, and reads back as no rows. Other
columns are ignored, whatever their names. A damaged block raises an error, and so does a vocabulary of more than 65,536 ids.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jvm_coder
from .id_coder import decode, encode
from .shared import joined_ranges, session_dir, slices, small_batches, word_hashes

MAGIC = b"PTK1"
BLOCK_IDS = 4096
SEGMENT_IDS = 6 << 20
_CACHE_PIECES = 1 << 20
_TOGETHER = 512
#: Ids are kept and coded in 16 bits.
_MOST_IDS = 1 << 16

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other ASCII, 4 beyond, 5 an apostrophe or bar
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[0x80:] = 4
_CLASS[[0x27, 0x7C]] = 5
_CLASS = _CLASS.tobytes()
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) that the tokenizer treats independently of each other."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.frombuffer(bytearray(raw).translate(_CLASS), np.uint8)
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins = kind == 2
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins[edges] = True
    # From here on, runs of one kind within a row (a digit each) instead of bytes.
    at = np.flatnonzero(begins)
    kind = kind[at]
    solid = kind != 0
    fresh = np.ones(len(at), bool)
    fresh[1:] = ~solid[:-1]
    fresh[np.searchsorted(at, edges)] = True
    fresh &= solid
    chunk = np.cumsum(fresh, dtype=np.int32)  # 1-based number of each run's chunk
    odd = np.zeros(int(chunk[-1]) + 1, bool)
    odd[chunk[kind >= 4]] = True  # these stay whole
    begin = fresh | (solid & ~odd[chunk])
    # A piece ends where the next begins or at the space before that.
    stops = np.flatnonzero(begin | ~solid)
    kept = begin[stops]
    stops = at[stops]
    return stops[kept], np.append(stops[1:], n)[kept]


class PieceTokenizer:
    """A tokenizer with a memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > _MOST_IDS:
            raise ValueError(f"the vocabulary has more than {_MOST_IDS} ids")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(_MOST_IDS, bool)  # ids that end a word, where the vocabulary marks them
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        # Hashes, ascending, and the numbers of their pieces: most, and those that came last, as putting new ones among all takes long.
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.place, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used, self.store = 0, np.zeros(1 << 14, np.uint16)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """The numbers of hashed pieces; -1: not known."""
        found = np.full(len(names), -1)
        for hashes, numbers in self.tables:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, names), len(hashes) - 1)
                np.copyto(found, numbers[at], where=hashes[at] == names)
        return found

    def _keep(self, names: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Adds pieces: their hashes, ascending, how many ids each has, and the ids of all."""
        first, used = self.known, self.used
        self.known, self.used = first + len(names), used + len(ids)
        for name, size in (("place", self.known), ("length", self.known), ("store", self.used)):
            if size > len(have := getattr(self, name)):
                setattr(self, name, np.concatenate([have, np.zeros(2 * size - len(have), have.dtype)]))
        self.place[first : self.known] = used + np.cumsum(length) - length
        self.length[first : self.known] = length
        self.store[used : self.used] = ids
        most, late = self.tables
        late = _merged(late, (names, np.arange(first, self.known)))
        if 8 * len(late[0]) > len(most[0]):
            most, late = _merged(most, late), (late[0][:0], late[1][:0])
        self.tables = [most, late]

    def _words(self, groups: list[list[str]]) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """(ids of each word, all ids) of groups of words; without the first if it can't be told. Ids that end a word tell it, or else,
        by a slower call, the words' numbers."""
        texts = [" ".join(g) for g in groups]
        for words, text, e in zip(groups, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            last = np.flatnonzero(self.closing[ids])
            if len(last) == len(words) and last[-1] == len(ids) - 1:
                yield np.diff(last, prepend=-1), ids
                continue
            e = self.tokenizer.encode(text, add_special_tokens=False)
            count = np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
            yield count if len(count) == len(words) else None, np.array(e.ids, np.uint16)

    def _learn(self, raw: np.ndarray, names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """names: hashes of unknown pieces, ascending; starts, ends: where each occurs."""
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        # Pieces that are one word to the tokenizer go in groups.
        plain = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "\u0100"]
        odd = sorted(set(range(len(texts))) - set(plain))
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        length = np.zeros(len(texts), np.int64)
        parts: list[tuple[list[int], np.ndarray]] = []
        for group, (count, ids) in zip(groups, self._words([[texts[i] for i in g] for g in groups])):
            if count is None:
                odd += group
                continue
            length[group] = count
            parts.append((group, ids))
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
            length[i] = len(e.ids)
            parts.append(([i], np.array(e.ids, np.uint16)))
        ends_in = np.cumsum(length)
        flat = np.zeros(int(ends_in[-1]), np.uint16)
        for group, ids in parts:
            flat[joined_ranges(ends_in[group] - length[group], length[group])] = ids
        self._keep(names, length, flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has)."""
        if self.known > _CACHE_PIECES:
            self._forget()
        starts, ends = pieces(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        lower = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
        coded = pa.array(word_hashes(lower, starts, ends)).dictionary_encode()  # names, each once, and which of them each piece has
        names, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(names)  # looked up in order
        ranked = names[order]
        number = self._find(ranked)
        new = np.flatnonzero(number < 0)
        if len(new):
            first = np.empty(len(names), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the last to be written is the first piece
            first = first[order[new]]
            number[new] = self.known + np.arange(len(new))
            self._learn(raw, ranked[new], starts[first], ends[first])
        of_name = np.empty(len(names), np.int64)
        of_name[order] = number
        at = of_name[which]
        length = self.length[at]
        ids = self.store[joined_ranges(self.place[at], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        bounds = ends[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of ascending hashes as one."""
    hashes = np.concatenate([a[0], b[0]])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], np.concatenate([a[1], b[1]])[order]


_loaded: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


def _head(ids: list[int | None], lengths: np.ndarray, n_ids: int, block_ids: int) -> bytes:
    """A segment's bytes before its blocks."""
    head = MAGIC + np.array([block_ids], "<u4").tobytes() + np.array([n_ids], "<u8").tobytes() + np.array([len(ids), -(-n_ids // block_ids)], "<u4").tobytes()
    return head + np.array([x is not None for x in ids], "u1").tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + lengths.astype("<u4").tobytes()


def pack_segment(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of a segment."""
    blocks = [tokens[i : i + block_ids] for i in range(0, len(tokens), block_ids)]
    coded = encode(blocks)
    sizes = np.array([len(c) for c in coded], "<u4").tobytes() + np.array([zlib.crc32(b.astype("<u4").tobytes()) for b in blocks], "<u4").tobytes()
    return b"".join([_head(ids, lengths, len(tokens), block_ids), sizes, *coded])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids) of a segment; raises ValueError if a checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    block_ids = int(np.frombuffer(data, "<u4", 1, 4)[0])
    total = int(np.frombuffer(data, "<u8", 1, 8)[0])
    docs, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 16))
    at = 24
    there, names, lengths = np.frombuffer(data, "u1", docs, at), np.frombuffer(data, "<i8", docs, at + docs), np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    sizes, marks = np.frombuffer(data, "<u4", blocks, at).astype(np.int64), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    at += 8 * blocks
    ends = at + np.cumsum(sizes)
    counts = [min(block_ids, total - k * block_ids) for k in range(blocks)]
    got = decode([data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())], counts)
    for k, block in enumerate(got):
        if zlib.crc32(block.astype("<u4").tobytes()) != marks[k]:
            raise ValueError(f"block {k} is damaged")
    tokens = np.concatenate(got) if got else np.zeros(0, np.uint32)
    return [int(x) if ok else None for x, ok in zip(names, there)], lengths.astype(np.int64), tokens


def _write(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            head, raw = _head(names, np.concatenate(lengths), size, BLOCK_IDS), np.concatenate(tokens).astype("<u2", copy=False)
            cells = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, raw.nbytes], np.int32)), pa.py_buffer(raw)])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([size], pa.int64()), pa.array([head], pa.binary()), cells], ["part", "segment", "n_ids", "head", "ids"])

        for batch in batches:
            known = batch.column(0).to_pylist()
            for i, j, raw, at in slices(batch.column(1)):
                ids, count = _tokenizer(path).encode(raw, at)
                with_end = np.insert(ids, np.cumsum(count), np.uint16(end_id))
                names += known[i:j]
                lengths.append(count + 1)
                tokens.append(with_end)
                size += len(with_end)
                if size >= segment_ids:
                    yield flush()
                    names, lengths, tokens, size, made = [], [], [], 0, made + 1
        if names:
            yield flush()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes all documents' ids, in ascending order of their ids, as a dataset of segments at ``out``."""
    small_batches(docs.sparkSession)
    jvm_coder.register(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mark = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark)
    segments = dealt.mapInArrow(_write(tokenizer_path, end_id, segment_ids), "part int, segment int, n_ids long, head binary, ids binary")
    segments.select("part", "segment", "n_ids", F.call_function(jvm_coder.PACK, "head", "ids").alias("data")).write.parquet(out)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a dataset of segments, decoded."""
    jvm_coder.register(spark)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("of_part"))
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.join(parts, "part").select("part", "segment", (F.col("part_start") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("begin"))
    docs = stored.select("part", "segment", F.inline(F.call_function(jvm_coder.UNPACK, "data")))
    return docs.join(begins, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the token files below the session's shared folder and reads them back."""
    out = f"{session_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, out, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, out)
