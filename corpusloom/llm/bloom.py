"""Blocked Bloom filter as a Spark table: 256-bit blocks of four longs, built and probed with built-in functions only.

A key's 64-bit hash names one block and, mixed again, two bits in each of its four longs. The table has at most
``2 ** max_log2`` rows, so broadcasting it is bounded whatever the number of keys; a fuller filter only passes more
rows to the exact join that always follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, MAX_LOG2, WORDS = 16, 18, 4


def log2_blocks(n_keys: int, max_log2: int = MAX_LOG2) -> int:
    """Blocks, as a power of two, that give every key about BITS_PER_KEY bits."""
    return min(max_log2, max(4, (max(1, n_keys) * BITS_PER_KEY // 256).bit_length()))


def _block(key: Column, log2: int) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << log2) - 1)


def _mask(key: Column, word: int) -> Column:
    bits = F.xxhash64(F.xxhash64(key), F.lit(1))
    one = F.lit(1).cast("long")
    place = [F.shiftrightunsigned(bits, s).bitwiseAND(63).cast("int") for s in (12 * word, 12 * word + 6)]
    left = [F.call_function("shiftleft", one, p) for p in place]
    return left[0].bitwiseOR(left[1])


def build(keys: DataFrame, column: str, log2: int) -> DataFrame:
    """The filter's rows (block, w0..w3) over the non-null values of ``column``."""
    key = F.col(column)
    masks = keys.filter(key.isNotNull()).select(_block(key, log2).alias("__block"), *[_mask(key, i).alias(f"__w{i}") for i in range(WORDS)])
    return masks.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)])


def probe(df: DataFrame, column: str, blocks: DataFrame, log2: int, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false only for keys that surely are not listed (null keys included)."""
    key = F.col(column)
    joined = df.withColumn("__block", _block(key, log2)).join(F.broadcast(blocks), "__block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(_mask(key, i)) == _mask(key, i))
    return joined.withColumn(flag, F.coalesce(hit & key.isNotNull(), F.lit(False))).drop("__block", *[f"__w{i}" for i in range(WORDS)])


def split(df: DataFrame, column: str, listed: DataFrame, n_listed: int, max_log2: int = MAX_LOG2) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``column`` is in ``listed``, all other rows), exactly.

    ``listed`` holds distinct values in a column of the same name. Only rows that pass the filter are shuffled.
    """
    log2 = log2_blocks(n_listed, max_log2)
    probed = probe(df, column, build(listed, column, log2), log2, "__maybe")
    maybe, no = probed.filter("__maybe").drop("__maybe"), probed.filter(~F.col("__maybe")).drop("__maybe")
    return maybe.join(listed, column, "left_semi"), no.unionByName(maybe.join(listed, column, "left_anti"))


# ------------------------------------------------------- the same for keys that are hashes already, read inside Python

#: Bit fields of a hash that pick the two bits of each word; the low 20 bits name the block.
FIELDS = ((20, 26), (32, 38), (44, 50), (56, 58))
HASHED_MAX_LOG2 = 20


def collect_hashed(keys: DataFrame, column: str, n_keys: int) -> np.ndarray:
    """Blocks x 4 words of a filter over a column of 64-bit hashes: at most 32 MB whatever the number of keys."""
    log2, one, key = log2_blocks(n_keys, HASHED_MAX_LOG2), F.lit(1).cast("long"), F.col(column)
    bit = lambda s: F.call_function("shiftleft", one, F.shiftrightunsigned(key, s).bitwiseAND(63).cast("int"))
    masks = keys.select(key.bitwiseAND((1 << log2) - 1).alias("block"), *[bit(s).bitwiseOR(bit(t)).alias(f"w{i}") for i, (s, t) in enumerate(FIELDS)])
    rows = masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toArrow()
    out = np.zeros((1 << log2, WORDS), dtype=np.uint64)
    out[np.asarray(rows.column("block"))] = np.stack([np.asarray(rows.column(f"w{i}")).view(np.uint64) for i in range(WORDS)], axis=1) if rows.num_rows else out[:0]
    return out


def may_hold(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit hash: false only if it surely is not among the filter's keys."""
    block = (keys & np.uint64(len(blocks) - 1)).astype(np.int64)
    hit, one, low = np.ones(len(keys), dtype=bool), np.uint64(1), np.uint64(63)
    for i, (s, t) in enumerate(FIELDS):
        mask = one << (keys >> np.uint64(s) & low) | one << (keys >> np.uint64(t) & low)
        hit &= blocks[block, i] & mask == mask
    return hit
