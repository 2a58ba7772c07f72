"""A bitmap of 64-bit hashes: of bounded size, so that it can go to every task.

Each hash sets two bits (a Bloom filter). It never misses a hash that was put in. With few
bits for each it lets more others pass, which costs time and no result as long as what
passes is judged exactly later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most there are: 32 MB, whatever the number of hashes.
BITS_EACH = 16
MOST_BITS = 1 << 28
#: From this bit of the hash on it names its second place.
SECOND = 32


def bitmap(hashes: DataFrame, name: str = "h") -> np.ndarray:
    """Words of 64 bits, a power of two of them, with two bits set per hash. `hashes` should be a written table."""
    size = min(MOST_BITS, max(1024, 1 << (BITS_EACH * hashes.count()).bit_length()))
    both = F.explode(F.array(F.col(name), F.shiftrightunsigned(name, SECOND)))
    place = hashes.select(both.alias("h")).select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = place.select(F.shiftright("place", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    held = words.toArrow()
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (unsigned) hash may have been put in."""
    out = _set(bits, hashes)
    # The second bit is looked at where the first is set only.
    out[out] = _set(bits, hashes[out] >> np.uint64(SECOND))
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
