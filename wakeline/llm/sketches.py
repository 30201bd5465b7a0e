"""Sketches of key sets: a bit for each of a fixed number of hash values.

A sketch has the same size whatever the table, so it may go to every task. Rows whose key isn't in
it surely have no partner and needn't be shuffled; an exact join follows for the others. A full
sketch lets everything through and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB


def sketch(keys: Column, rows: DataFrame) -> np.ndarray:
    """Which of BITS hash values the keys of rows (64-bit hashes) have, as 64-bit words; its size is fixed."""
    bit = F.pmod(keys, F.lit(BITS))
    words = rows.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def in_sketch(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.view(np.uint64) % np.uint64(BITS)
    return (words[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63))) & np.uint64(1) > 0
