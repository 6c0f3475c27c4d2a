"""A blocked Bloom filter in DataFrame operations: one 64-bit block and four bits per key.

``hashed`` says that a key is a uniform 64-bit hash already; it is then used as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Blocks of a filter at most, 8 MB; with more keys it lets more through, and what follows it is exact.
MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys, a power of two."""
    return min(MAX_BLOCKS, 1 << max(0, n * BITS_PER_KEY // 64 - 1).bit_length())


def block_of(key: str, n_blocks: int, hashed: bool = False) -> str:
    return f"cast({key} & {n_blocks - 1}L as int)" if hashed else f"cast(pmod(xxhash64({key}), {n_blocks}) as int)"


def bits_of(key: str, hashed: bool = False) -> str:
    """Four bits of a block, from a second hash of the key, or from bits that a key that is a hash itself has above its block's."""
    h, first = (key, MAX_BLOCKS.bit_length() - 1) if hashed else (f"xxhash64({key}, 29)", 0)
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {first + 6 * i}) & 63 as int))" for i in range(4)) + ")"


def words_of(keys: DataFrame, key: str, n_blocks: int, hashed: bool = False) -> Column:
    """The filter of a column of keys, an array of n_blocks longs, as a scalar subquery."""
    spark = keys.sparkSession
    every = spark.range(n_blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("word"))
    return (
        keys.select(F.expr(block_of(key, n_blocks, hashed)).alias("block"), F.expr(bits_of(key, hashed)).alias("word")).unionByName(every)
        .groupBy("block").agg(F.bit_or("word").alias("word"))
        .agg(F.expr("transform(array_sort(collect_list(struct(block, word))), x -> x.word)").alias("words"))
        .scalar()
    )


def passes(key: str, words: str, n_blocks: int, hashed: bool = False) -> str:
    """Whether the filter in column ``words`` may hold the key."""
    return f"(element_at({words}, {block_of(key, n_blocks, hashed)} + 1) & {bits_of(key, hashed)}) = {bits_of(key, hashed)}"
