"""What the operators of this folder share: text slices and word hashes (and, from the library, written tables)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..tables import drop_written, session_dir, written

__all__ = ["SPACE", "Spans", "Words", "binary_array", "byte_spans", "chained", "drop_written", "joined_ranges", "mix", "row_of", "session_dir", "slices", "small_batches", "text_bytes", "word_hashes", "written"]

#: Text bytes that one numpy step takes at most, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch: bound what one Python worker holds at once, unless a single row is larger.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to ``BATCH_ROWS`` and ``BATCH_BYTES``, where they are higher.

    They stay lowered: what an operator returns is planned after it has returned. Limits change no result.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < have <= most:
            spark.conf.set(key, str(most))


# ---- texts as bytes -------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of a string column and where each row's text begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most ``most`` bytes, or of one longer row."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


# ---- hashing --------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit values with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GAMMA)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of a slice of texts, as in ``Words``, without hashes."""
    inside = ~apart[raw]
    n = len(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as 64-bit hashes.

    hashes: one for each word, in order; first: index of each row's first word (rows + 1 entries);
    starts, ends: byte positions in the slice; spans: hashes of other byte spans. fold: A-Z count as a-z.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, fold: bool = True):
        self.starts, self.ends, self.first = word_bounds(raw, offsets, apart)
        self.spans = Spans(_LOWER[raw] if fold else raw)
        self.hashes = self.spans.hashes(self.starts, self.ends)


class Spans:
    """64-bit hashes of byte spans of some bytes, by one running polynomial sum over them."""

    def __init__(self, raw: np.ndarray):
        self.total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            values = _BYTE[raw]
            values *= _power(_BASE, len(raw))
            np.cumsum(values, out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[ends] - self.total[starts]) * _power(_BASE_INVERSE, len(self.total))[starts] + (ends - starts).astype(np.uint64) * _GAMMA)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(raw).hashes(starts, ends)


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (len - n + 1 of them), order-sensitive."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = mix(out + hashes[i : i + m] + np.uint64(i + 1) * _GAMMA)
    return out


def row_of(first: np.ndarray) -> np.ndarray:
    """For bounds (rows + 1), the row of each entry."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def joined_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of several ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def byte_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as a binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = raw[joined_ranges(starts, lengths)] if len(starts) else np.zeros(0, np.uint8)
    if offsets[-1] > np.iinfo(np.int32).max:
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
