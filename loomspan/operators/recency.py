"""Orders of recency and the latest row of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_creation(created: str = "created_at", key: str = "id") -> list[Column]:
    """Newest first, then the greatest id."""
    return [F.col(created).desc_nulls_last(), F.col(key).desc()]


def by_iteration(iteration: str = "iteration", created: str = "created_at", key: str = "id") -> list[Column]:
    """Runs with an iteration first, the greatest first, then the newest."""
    return [F.col(iteration).desc_nulls_last(), *by_creation(created, key)]


def by_activity(key: str = "id") -> list[Column]:
    """The order of matching runs: ended, updated, created, started, id; a missing time is the oldest."""
    return [*(F.col(c).desc_nulls_last() for c in ("ended_at", "updated_at", "created_at", "started_at")), F.col(key).desc()]


def first_of_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; nulls of the group columns form groups of their own."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_by_struct(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As :func:`first_of_group` for ascending-greatest orders, with partial aggregation before the shuffle: for groups of any size."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*group, "_v.*")
