"""Vectorised word splitting and hashing over Arrow string columns.

Texts are taken as UTF-8 bytes. A word is a maximal run of bytes outside a
separator table; a word's hash is a keyed polynomial over its (mapped) bytes
with a 64-bit finaliser, and long words fall back to BLAKE2b. Work is done in
chunks of whole texts, so memory follows the chunk (or one text, if longer).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, after which a worker gives freed memory back, as it may wait long for its next task.

    Arrow takes memory from the C library, as its own pool keeps what is freed.
    """

    def lean(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


_LONG = 256
#: Space and \x09 to \x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
PUNCT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
SAME = bytes(range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


@dataclass(frozen=True)
class Splitter:
    """separators: by byte. mapping: bytes to bytes, as for str.translate. seed: of the hash."""

    separators: np.ndarray
    mapping: bytes = SAME
    seed: int = 1

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        by_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
        values = by_byte[np.frombuffer(self.mapping, np.uint8)]
        values[self.separators] = 0
        return values, _powers(int(rng.integers(1, 2**62)) * 4 + 3, _LONG)


@dataclass
class Words:
    """The words of some texts. word i has bytes data[starts[i]:ends[i]]; text j has words first[j]:first[j + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_large_binary(column.type) else "", column.type))
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, offsets: np.ndarray, how: Splitter, tables: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of the texts data[offsets[j]:offsets[j + 1]]; offsets start at 0."""
    values, powers = tables or how.tables()
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U64))
    token = ~how.separators[data]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(token[:-1], out=before[1:])
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(token[1:], out=after[:-1])
    ends_of_texts = offsets[1:] - 1
    after[ends_of_texts[ends_of_texts >= 0]] = True
    starts, ends = np.flatnonzero(token & before), np.flatnonzero(token & after) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, starts, ends, first, np.zeros(0, U64))
    at = int(starts[0])
    place = np.arange(at, n, dtype=np.int32 if n < 2**31 else np.int64)
    place -= np.repeat(starts.astype(place.dtype), np.diff(starts, append=n))
    np.minimum(place, _LONG - 1, out=place)
    weights = powers.take(place)
    weights *= values.take(data[at:])
    hashes = mix(np.add.reduceat(weights, starts - at))
    for i in np.flatnonzero(ends - starts >= _LONG):
        word = data[starts[i] : ends[i]].tobytes().translate(how.mapping)
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=how.seed.to_bytes(8, "little")).digest(), "little")
    return Words(data, starts, ends, first, hashes)


def windows(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``size`` words, by binary decomposition of the length."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    done, length, part, k = None, 0, hashes, 1
    while True:
        if size & k:
            if done is None:
                done, length = part, k
            else:
                m = len(hashes) - length - k + 1
                done = done[:m] * U64(pow(base, k, 1 << 64)) + part[length : length + m]
                length += k
        if length == size:
            return mix(done[:n])
        m = len(hashes) - 2 * k + 1
        part = part[:m] * U64(pow(base, k, 1 << 64)) + part[k : k + m]
        k *= 2


def doc_of_words(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` words lies in one text."""
    if not first[-1]:
        return np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(first[-1]) + size <= last)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
