"""Vectorised text kernels over Arrow string columns, and small Spark helpers.

A word is a run of bytes outside ``{space, \\t, \\n, \\v, \\f, \\r}``; those separators are ASCII, so cutting UTF-8 bytes gives
the words of the regular expression ``[^\\x20\\x09-\\x0D]+``. All kernels work on one slice of a batch at a time, so that their
temporary arrays follow the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from argil.sources.shared import cut as cut
from argil.sources.shared import shared_dir as shared_dir

SLICE_BYTES = 4 << 20
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BYTE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG_WORD = 256
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def slices(table: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes; a longer text is a run of its own."""
    batches = table.to_batches() if isinstance(table, pa.Table) else [table]
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, eight zero bytes appended, and the ``n + 1`` row offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    n = int(offsets[-1] - offsets[0])
    out = np.zeros(n + 8, dtype=np.uint8)
    if n:
        out[:n] = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (``n + 1`` of them)."""
    n = len(data) - 8
    inside = IS_WORD[data[:n]]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    lens = ends - starts
    h = mix64(lens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
    if not len(starts):
        return h
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at = np.flatnonzero(lens <= _LONG_WORD)
    k = 0
    while len(at := at[lens[at] > 8 * k]):
        lane = lanes[starts[at] + 8 * k] & _BYTE_MASK[np.minimum(lens[at] - 8 * k, 8)]
        h[at] = mix64(h[at] ^ lane)
        k += 1
    for i in np.flatnonzero(lens > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].data, seed)
    return h


_Q = {0: 0xD6E8FEB86659FD93, 1: 0xA0761D6478BD642F}


def hash_windows(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive items at each place; places run over row ends, see ``window_starts``."""
    n = len(h)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    q = _Q[seed]
    power, inverse = np.full(n, q, dtype=np.uint64), np.full(n - size + 1, pow(q, -1, 2**64), dtype=np.uint64)
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power, out=total[1:])
    return mix64((total[size:] - total[:-size]) * inverse)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that stay inside one row, and the row of each."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return ranges(first[:-1], n), row


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` items a window of ``size`` starting at one of ``at`` covers."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, np.minimum(at + size, n), 1)
    return np.cumsum(edge[:-1]) > 0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key(doc_id: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integer ids with 0 for null, and which are null."""
    if isinstance(doc_id, pa.ChunkedArray):
        doc_id = doc_id.combine_chunks()
    null = np.asarray(doc_id.is_null())
    return pc.fill_null(doc_id.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), null


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte span; spans of 32 bytes or more go through the library one by one."""
    lens = ends - starts
    h = np.uint64(seed) + _P5 + lens.astype(np.uint64)
    if not len(starts):
        return h
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    short = np.flatnonzero(lens < 32)
    for k in range(3):
        at = short[lens[short] >= 8 * (k + 1)]
        h[at] = _rotl(h[at] ^ (_rotl(lanes[starts[at] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
    place = starts + (lens & ~7)
    at = short[lens[short] & 4 != 0]
    h[at] = _rotl(h[at] ^ ((lanes[place[at]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    place += lens & 4
    for k in range(3):
        at = short[(lens[short] & 3) > k]
        h[at] = _rotl(h[at] ^ (data[place[at] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    view = memoryview(data)
    long = np.flatnonzero(lens >= 32)
    h[long] = np.fromiter((xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())), dtype=np.uint64, count=len(long))
    return h
