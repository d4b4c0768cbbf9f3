"""A bitmap of hashed keys: bounded however many keys there are, never without a key that it was given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: at least 16 for each key, up to 2^26 (8 MB). Beyond 4 million keys more other keys pass.
LEAST, MOST = 16, 26


def bitmap(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """The bitmap of n bigint keys, as 64-bit words; the words are put together by the executors."""
    bits = min(MOST, max(LEAST, (16 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may have been given."""
    at = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
