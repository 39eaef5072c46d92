"""A Bloom filter as a table: which ids may have been seen before.

A filter is a table of blocks of four 64-bit lanes. An id has one block and one
bit in each lane, all by hash. Building is one combining aggregate, testing one equi-join
on the block, so a filter is a normal table: Catalyst broadcasts a small one and
shuffles a large one. Filters of parts are united by the same aggregate. A test never
misses an id that was put in; it lets a few others through, the more the fuller the blocks are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = ("l0", "l1", "l2", "l3")
SCHEMA = "block long, l0 long, l1 long, l2 long, l3 long"
#: 256 bits each: 16 MB of bits, good for about ten million ids.
BLOCKS = 1 << 19


def marks(key: Column, blocks: int = BLOCKS) -> list[Column]:
    """The block of an id and its bits, one for each lane."""
    spread = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"),
                                    F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).alias("block"), *[bit(i).alias(x) for i, x in enumerate(LANES)]]


def united(rows: DataFrame) -> DataFrame:
    """One row per block from filters or marks."""
    return rows.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in LANES])


def filter_of(ids: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    return united(ids.where(F.col(key).isNotNull()).select(*marks(F.col(key), blocks)))


def with_seen(rows: DataFrame, key: str, known: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``seen``: false where the filter rules out that the id was put in."""
    columns = rows.columns
    wanted = rows.select("*", F.struct(*marks(F.col(key), blocks)).alias("_mark")).withColumn("block", F.col("_mark.block"))
    held = known.select("block", F.struct(*LANES).alias("_held"))
    full = F.lit(True)
    for lane in LANES:
        bit = F.col(f"_mark.{lane}")
        full = full & (F.col(f"_held.{lane}").bitwiseAND(bit) == bit)
    return wanted.join(held, "block", "left").select(*columns, F.coalesce(full, F.lit(False)).alias("seen"))
