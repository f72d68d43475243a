"""A Bloom filter as a small table of bitmaps: rows that it rules out need no join, and so no shuffle.

A hash picks a block of 32,768 bits and three bits in it. Bits are gathered by ``bitmap_construct_agg``, which combines in
the tasks. The filter is broadcast, so its bytes have a bound; past it the share of false positives rises, and more rows go
on to the exact join, but no result changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh

BLOCK_BITS = 32_768
BITS_PER_KEY = 16
#: Bytes of the filter, at most.
FILTER_BYTES = 32 << 20


def _spots(hash_: str) -> list[str]:
    """The three bits of a hash in its block, as SQL."""
    return [f"(shiftright(xxhash64(`{hash_}`, 'bits'), {15 * k}) & {BLOCK_BITS - 1})" for k in range(3)]


def bloom(hashes: DataFrame, count: int, most: int = FILTER_BYTES) -> tuple[DataFrame, int]:
    """(block, bits) of the single long column of ``hashes``, with ``count`` rows or so; and the number of blocks."""
    blocks = max(1, min(most // (BLOCK_BITS // 8), -(-count * BITS_PER_KEY // BLOCK_BITS)))
    own = hashes.toDF("hash")
    spots = own.select(F.expr(f"pmod(hash, {blocks}L)").alias("block"), F.explode(F.expr(f"array({', '.join(_spots('hash'))})")).alias("spot"))
    return spots.groupBy("block").agg(F.bitmap_construct_agg("spot").alias("bits")), blocks


def tested(df: DataFrame, hash_: Column, filter_: tuple[DataFrame, int], name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false where ``hash_`` is certainly not in the filter. No row moves."""
    table, blocks = filter_
    block, bits, own = (fresh(df, n) for n in ("block", "bits", "hash"))
    table = F.broadcast(table.toDF(block, bits))
    keyed = df.withColumn(own, hash_).withColumn(block, F.expr(f"pmod(`{own}`, {blocks}L)")).join(table, block, "left")
    byte = "cast(conv(hex(substring(`{b}`, cast(shiftright({s}, 3) as int) + 1, 1)), 16, 10) as int)"
    tests = [f"({byte.format(b=bits, s=s)} & shiftleft(1, cast({s} & 7 as int))) <> 0" for s in _spots(own)]
    return keyed.withColumn(name, F.expr(f"`{bits}` is not null and {' and '.join(tests)}")).drop(block, bits, own)
