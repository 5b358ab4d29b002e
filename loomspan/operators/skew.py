"""Joins of a long side with a side that is unique by key, when a few keys may hold a large share of the long side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import shuffle_partitions

#: At most so many keys are ever treated as heavy, whatever the size of the data; broadcasts of heavy keys are bounded by it.
MAX_HEAVY = 1000
#: A key is heavy if it fills more than this part of an average shuffle partition.
PARTS_OF_PARTITION = 4


def heavy_keys(counts: DataFrame, key: str, n: str, max_heavy: int | None = None, min_rows: int = 2) -> list:
    """The keys whose rows exceed 1/``max_heavy`` of all rows (and ``min_rows``): at most ``max_heavy`` of them.

    By default those that fill more than a quarter of an average shuffle partition, and MAX_HEAVY at most. ``counts``
    has rows (key, n), several per key allowed. Null keys are never heavy.
    """
    max_heavy = max_heavy or min(MAX_HEAVY, PARTS_OF_PARTITION * shuffle_partitions(counts.sparkSession))
    per_key = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("_n"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    threshold = max(min_rows, total // max_heavy + 1)
    return [r[0] for r in per_key.where(F.col("_n") >= threshold).select(key).collect()]


def is_heavy(key: str, heavy: list) -> Column:
    return F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)


def join_unique(long: DataFrame, unique: DataFrame, key: str, heavy: list) -> DataFrame:
    """Left join of ``long`` with ``unique`` (one row per key): heavy keys by broadcast, all others by shuffle.

    Rows of ``long`` with a null key are kept, with nulls for the columns of ``unique``.
    """
    light = long.where(~is_heavy(key, heavy)).join(unique.where(~is_heavy(key, heavy)), key, "left")
    if not heavy:
        return light
    few = F.broadcast(unique.where(is_heavy(key, heavy)))
    return light.unionByName(long.where(is_heavy(key, heavy)).join(few, key, "left"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
