"""Arrow text columns as byte arrays, words and word shingles as 64-bit hashes.

Everything here works on one Arrow batch inside a task. Batches are walked in pieces of a bounded
number of bytes, so that the temporary arrays do not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE = 1 << 20
SHINGLE = 5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PARQUET_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

#: Bytes of words that are runs without white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, since one row may be a very long text."""
    if int(spark.conf.get(BATCH_ROWS)) > rows or int(spark.conf.get(BATCH_ROWS)) <= 0:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None, read: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, and ``read`` rows at once from
    Parquet, for what is run inside; the settings are put back after."""
    before = {name: spark.conf.get(name) for name in (BATCH_ROWS, BATCH_BYTES, PARQUET_ROWS)}
    small_batches(spark, rows)
    for name, value in ((BATCH_BYTES, size), (PARQUET_ROWS, read)):
        if value is not None:
            spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if size not in _tables:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        powers = np.full(size, _BASE, np.uint64)
        inverses = np.full(size, inverse, np.uint64)
        powers[0] = inverses[0] = 1
        _tables.clear()
        _tables[size] = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)
    return _tables[size]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; a word never crosses rows."""
    inside = kind[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes in every batch."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        powers, inverses = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * inverses[s] + (e - s).astype(np.uint64) * _ODD[0]
        i = j
    return mix(out)


def row_words(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """n + 1 offsets of the rows in the list of words."""
    return np.searchsorted(starts, offsets)


def sequence_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words, over the whole list (rows are not minded)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _ODD[k % 5]
    return mix(total + np.uint64(width))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a text column.

    Words are runs without white space, A-Z lower-cased. A row of one to four words has one
    shingle, the whole sequence; a row without words has none.
    """
    data, offsets = column_bytes(column)
    for i, j in pieces(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        local = offsets[i : j + 1] - offsets[i]
        starts, ends = word_spans(part, local, NOT_SPACE)
        words = span_hashes(part, starts, ends)
        bounds = row_words(local, starts)
        shingles = sequence_hashes(words)
        for k in range(j - i):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= SHINGLE:
                yield i + k, np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                yield i + k, sequence_hashes(words[a:b], b - a)
            else:
                yield i + k, np.zeros(0, np.uint64)


def segments(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) in parts of about ``limit`` bytes. A longer
    row comes in several parts, cut where a word of ``kind`` ends, so that no word is cut."""
    for i, j in pieces(offsets, limit):
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > limit:
            cut, step = low + limit, limit
            while cut < high and kind[data[cut : cut + step]].all():
                cut += step
            cut = min(high, cut + int(np.argmin(kind[data[cut : cut + step]]))) if cut < high else high
            yield i, data[low:cut], np.array([0, cut - low])
            low = cut
        if high > low or j - i > 1:
            yield i, data[low:high], np.maximum(offsets[i : j + 1] - low, 0)
