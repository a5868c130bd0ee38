"""Blocked Bloom filter in DataFrame functions: a row per block, one bit in each of its words per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters up to this many bytes are broadcast; larger ones are joined by block number.
BROADCAST_BYTES = 32 << 20
#: Words of 64 bits in a block.
WORDS = 8
BITS_PER_KEY = 16


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) rows of a blocked Bloom filter over distinct keys, and its number of blocks."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[m.alias(f"w{j}") for j, m in enumerate(_masks(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)]), blocks


def probe(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """df with _maybe: false means that the key is surely not in the filter."""
    small = blocks * (WORDS + 2) * 8 <= BROADCAST_BYTES
    bloom = bloom.select(F.col("block").alias("_block"), *[f"w{j}" for j in range(WORDS)])
    got = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks))).join(F.broadcast(bloom) if small else bloom, F.col("_b") == F.col("_block"), "left")
    hit = F.lit(True)
    for j, m in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"w{j}").bitwiseAND(m) == m)
    return got.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_b", "_block", *[f"w{j}" for j in range(WORDS)])
