"""Vectorised text kernels over Arrow string columns.

All functions work on the UTF-8 bytes of many documents at once. A word's hash is a polynomial over its bytes
(difference of prefix sums modulo 2**64), finished by a 64-bit mixer, so a block of text needs a fixed number of
NumPy passes however many words it holds. Blocks are bounded in bytes; a longer document is a block by itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext, cloudpickle

BLOCK_BYTES = 512 << 10
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offset of each; null counts as empty."""
    pa.default_memory_pool().release_unused()  # what earlier batches held
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, index, data = column.buffers()
    offsets = np.frombuffer(index, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, most_bytes: int = BLOCK_BYTES, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` bytes and ``most_rows`` rows, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    start: np.ndarray  # byte offset in the block
    end: np.ndarray
    row: np.ndarray  # row in the block
    first: np.ndarray  # index of each row's first word, and the number of words at the end
    hash: np.ndarray  # uint64


def words(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Words of a block: maximal runs of bytes that ``member`` marks; no word crosses a row."""
    offsets = offsets - offsets[0]
    n = len(raw)
    low = LOWER[raw] if lower else raw
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    inside = member[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * up[:n], out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, first, value)


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """An order-sensitive hash of each k consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt + k, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray, first: np.ndarray, salt: int = 1) -> np.ndarray:
    """An order-sensitive hash of each row's words."""
    return range_hash(hashes, first[:-1], first[1:], salt)


def range_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 1) -> np.ndarray:
    """An order-sensitive hash of the words lo[i]..hi[i]-1 of each range."""
    n = len(hashes)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(salt)) * up[:n], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


#: 64-bit words of a Bloom filter: its size is the same whatever it holds; full, it passes more, never less.
BLOOM_WORDS = 1 << 17


def bloom_slots(values: np.ndarray, words: int = BLOOM_WORDS) -> tuple[np.ndarray, np.ndarray]:
    slot = mix(values.astype(np.int64).view(np.uint64)) % np.uint64(words * 64)
    return (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))


def bloom_has(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at, bit = bloom_slots(values, len(table))
    return (table[at] & bit) != 0


def bloom(column_of_longs, words: int = BLOOM_WORDS) -> np.ndarray:
    """The filter of a one-column DataFrame of longs; the driver gets at most ``words`` rows, whatever the DataFrame's size."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words, np.uint64)
        for batch in batches:
            at, bit = bloom_slots(batch.column(0).to_numpy(zero_copy_only=False), words)
            np.bitwise_or.at(table, at, bit)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["at", "bits"])

    got = column_of_longs.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(words, np.uint64)
    table[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return table


def share(sc: SparkContext, value: Any) -> Broadcast:
    """A broadcast of an object of a class of ours, with the class, so that executors need no copy of this package."""
    return sc.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)
