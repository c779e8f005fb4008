"""A filter for documents, so that only those in question are read on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, as a power of two: 16 a row at least, and 32 MB at most, beyond which more rows pass that no row set.
LEAST_BITS, MOST_BITS = 16, 28


def bit_of(size: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << size))


def flags(found: DataFrame, *key: str, bit: Callable[[int], Column] | None = None, parts: int | None = None) -> tuple[np.ndarray, int]:
    """Packed bits that the rows of ``found`` (checkpointed) set, and their number as a power of two.

    ``bit`` gives a row's bit by that number, by default that of the key's hash.
    The words come in ``parts`` jobs, by default one a shuffle partition.

    At most 2**MOST_BITS / 64 words reach the driver, one at a time.
    """
    size = min(MOST_BITS, max(LEAST_BITS, (16 * found.count()).bit_length()))
    words = found.select((bit(size) if bit else bit_of(size, *key)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("set"))
    out = np.zeros(1 << size >> 6, np.int64)
    for r in (words.coalesce(parts) if parts else words).toLocalIterator():
        out[r["word"]] = r["set"]
    return out.view(np.uint8), size


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits are set; a few that no row set may be."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
