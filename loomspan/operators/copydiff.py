"""Differences between two copies of one dataset, by content-defined chunks of key-sorted rows.

Each side is reduced to light rows (key, two 64-bit hashes of the row). Light rows are sorted by (hash of key, key)
inside ranges of that hash; a rolling hash over the last ``window`` keys ends a chunk wherever its low bits are zero, so
both copies cut at the same keys again right after a missing row. Chunk fingerprints that occur on both sides drop out;
only rows of the other chunks are read in full, reduced to the current version and compared field by field. A broadcast
bitmap of their keys' hashes keeps nearly all other rows from the shuffle of that second reading.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.session import scan_bytes, shuffle_partitions, stage

@dataclass(frozen=True)
class Copy:
    """One copy: rows with a text key, text fields, and the columns whose greatest values make a row the current one.

    Rows whose key is null are left out. Rows that tie in ``version`` are told apart by their hashes, so that any
    number of exact copies counts as one row.
    """

    df: DataFrame
    version: Sequence[str]


def _hashes(fields: Sequence[str]) -> list[Column]:
    """Two hashes of a row; which fields are null goes in beside the values, as hashes skip nulls."""
    nulls = F.concat(*(F.when(F.col(f).isNull(), "1").otherwise("0") for f in fields))
    full = [nulls, *(F.coalesce(F.col(f), F.lit("")) for f in fields)]
    return [F.xxhash64(*full).alias("_h1"), F.xxhash64(F.lit("second"), *full).alias("_h2")]


def _rotated(col: Column, bits: int) -> Column:
    return F.shiftleft(col, bits).bitwiseOR(F.shiftrightunsigned(col, 64 - bits))


def _chunks(copy: Copy, key: str, fields: Sequence[str], bits: int, mean_rows: int, window: int) -> DataFrame:
    version = F.struct(*copy.version, "_h1", "_h2")
    light = (
        copy.df.where(F.col(key).isNotNull())
        .select(key, *copy.version, *_hashes([key, *fields]))
        .groupBy(key)
        .agg(F.max_by(F.struct("_h1", "_h2"), version).alias("_h"))
        .select(key, F.xxhash64(key).alias("_k"), "_h.*")
        .withColumn("_range", F.shiftrightunsigned("_k", 64 - bits))
    )
    by_key = Window.partitionBy("_range").orderBy("_k", key)
    roll = F.col("_k")
    for back in range(1, window):
        roll = roll.bitwiseXOR(_rotated(F.coalesce(F.lag("_k", back).over(by_key), F.lit(0).cast("long")), 5 * back))
    ended = F.sum(F.when(F.col("_roll").bitwiseAND(F.lit(mean_rows - 1)) == 0, 1).otherwise(0))
    return (
        light.withColumn("_roll", roll)
        .withColumn("_chunk", F.coalesce(ended.over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("_range", "_chunk")
        .agg(F.bit_xor("_h1").alias("_f1"), F.bit_xor("_h2").alias("_f2"), F.count(F.lit(1)).alias("_n"), F.collect_list(key).alias("_keys"))
        .drop("_chunk")
    )


#: Slots of the bitmap per suspect, and the logarithm of the most slots: 2^20 words of 64, about 24 MB as a broadcast table.
SLOTS_PER_KEY, MOST_SLOT_BITS = 16, 26


def sieve(rows: DataFrame, key: str, suspects: DataFrame, n: int) -> DataFrame:
    """The rows whose key is one of ``n`` suspects, and a few others: one in SLOTS_PER_KEY, more once the bitmap is at its bound."""
    bits = min(MOST_SLOT_BITS, max(8, math.ceil(math.log2(SLOTS_PER_KEY * n + 1))))
    if n > 1 << bits - 1:
        return rows
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    words = suspects.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    kept = rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1)
    return kept.drop("_word", "_bits")


def _current(copy: Copy, key: str, fields: Sequence[str], suspects: DataFrame, n: int) -> DataFrame:
    version = F.struct(*copy.version, "_h1", "_h2")
    rows = sieve(copy.df, key, suspects, n).join(suspects, key, "left_semi").select(key, *copy.version, *fields, *_hashes([key, *fields]))
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("_row"))


def diff_copies(
    left: Copy,
    right: Copy,
    key: str,
    fields: Sequence[str],
    missing_left: str = "missing_in_left",
    missing_right: str = "missing_in_right",
    mean_rows: int = 4,
    window: int = 4,
) -> DataFrame:
    """Rows (key, difference): a key missing on one side, or the name of a field whose values differ.

    ``fields`` must be text in a form in which equal values are equal text; null equals only null. ``mean_rows`` is the
    mean chunk length, a power of two. Empty sides, and keys on one side only, give missing rows; extra columns of
    either side are never read. The suspects are written to the shared folder.
    """
    spark = left.df.sparkSession
    size = max(scan_bytes(left.df), scan_bytes(right.df))
    bits = min(24, max(math.ceil(math.log2(4 * shuffle_partitions(spark))), math.ceil(math.log2(1 + size / 2**26))))
    own, other = (_chunks(c, key, fields, bits, mean_rows, window).withColumn(f"_{s}", F.lit(1)) for s, c in (("l", left), ("r", right)))
    on = ["_range", "_f1", "_f2", "_n"]
    unmatched = own.withColumnRenamed("_keys", "_lkeys").join(other.withColumnRenamed("_keys", "_rkeys"), on, "full_outer").where("_l IS NULL OR _r IS NULL")
    suspects = stage(unmatched.select(F.explode(F.coalesce("_lkeys", "_rkeys")).alias(key)).distinct(), "suspects")
    n = suspects.count()
    a = _current(left, key, fields, suspects, n).withColumnRenamed("_row", "_a")
    b = _current(right, key, fields, suspects, n).withColumnRenamed("_row", "_b")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    found = F.when(F.col("_a").isNull(), F.array(F.lit(missing_left))).when(F.col("_b").isNull(), F.array(F.lit(missing_right))).otherwise(changed)
    return a.join(b, key, "full_outer").select(key, F.explode(found).alias("difference"))
