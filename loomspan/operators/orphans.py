"""References to records that do not exist, were purged, or arrived after the reference.

References are reduced to one row per (holder, target) and then to one row per (target, period). Targets whose
references fill more than a quarter of a shuffle partition are heavy: their status goes out by broadcast (at most 1000
rows) and their references are never shuffled by target. The other (target, period) rows meet the records in a shuffle
anti-join, which leaves those of which some reference is an orphan; only these get their status and are joined back to
their references. Both parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_keys, is_heavy, union_all
from loomspan.session import stage

POINTER = ["table_name", "ref_field", "holder_id", "target"]


def pointers(df: DataFrame, table: str, field: str, holder: Column, target: Column, kind: str, loaded_at: str = "loaded_at") -> DataFrame:
    """The references of one column. ``target`` is tagged with the kind of record, so that ids of different kinds differ."""
    return df.select(
        F.lit(table).alias("table_name"), F.lit(field).alias("ref_field"), holder.alias("holder_id"), F.concat(F.lit(f"{kind}:"), target).alias("target"), F.col(loaded_at).alias("at")
    ).where(F.col("target").isNotNull())


def records(df: DataFrame, key: Column, kind: str, loaded_at: str = "loaded_at") -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}:"), key).alias("target"), F.col(loaded_at).alias("at")).where(F.col("target").isNotNull())


def _status(rows: DataFrame, purges: DataFrame) -> DataFrame:
    """(target, first_at, last_at, n_rows, purged_at): one row for each id that has a row or a purge."""
    no_time = F.lit(None).cast("timestamp_ntz")
    seen = rows.select("target", "at", no_time.alias("purged"), F.lit(1).alias("row"))
    gone = purges.select("target", no_time.alias("at"), F.col("at").alias("purged"), F.lit(0).alias("row"))
    return seen.unionByName(gone).groupBy("target").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("row").alias("n_rows"), F.max("purged").alias("purged_at"))


def _deleted() -> Column:
    rows = F.coalesce("n_rows", F.lit(0))
    return F.col("purged_at").isNotNull() & ((rows == 0) | F.coalesce(F.col("purged_at") > F.col("last_at"), F.lit(False)))


def _kind(at: str) -> Column:
    """The case of a reference first held at ``at``; null if there is none."""
    return F.when(_deleted(), "deleted").when(F.coalesce("n_rows", F.lit(0)) == 0, "missing").when(F.col("first_at") > F.col(at), "late")


def _period(at: str) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def orphan_references(refs: DataFrame, rows: DataFrame, purges: DataFrame, min_heavy: int = 2) -> DataFrame:
    """Rows (table_name, ref_field, holder_id, target, kind, period), one per distinct reference with a case.

    ``refs`` comes from :func:`pointers`, ``rows`` and ``purges`` from :func:`records`. References without a target are
    no references. A null load time of a reference makes it never late and its period empty. A repeated row changes
    nothing. Empty inputs give no rows, or all references as missing.
    """
    held = stage(refs.groupBy(*POINTER).agg(F.min("at").alias("held_at")).withColumn("period", _period("held_at")), "references")
    keys = held.groupBy("target", "period").agg(F.count(F.lit(1)).alias("n"), F.min("held_at").alias("since"))
    heavy = heavy_keys(keys, "target", "n", min_rows=min_heavy)
    status = _status(rows, purges)
    parts = []
    there = status.where((F.col("n_rows") > 0) & ~_deleted()).select(F.col("target").alias("_target"), "first_at")
    in_time = (F.col("target") == F.col("_target")) & ~F.coalesce(F.col("first_at") > F.col("since"), F.lit(False))
    orphans = keys.where(~is_heavy("target", heavy)).join(there, in_time, "left_anti")
    light_keys = orphans.join(status, "target", "left").drop("n", "since")
    parts.append(held.where(~is_heavy("target", heavy)).join(light_keys, ["target", "period"]))
    if heavy:
        few = F.broadcast(status.where(is_heavy("target", heavy)))
        parts.append(held.where(is_heavy("target", heavy)).join(few, "target", "left"))
    return union_all(parts).withColumn("kind", _kind("held_at")).where("kind IS NOT NULL").select(*POINTER, "kind", "period")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, case and period, and how many targets they name."""
    return orphans.groupBy("table_name", "ref_field", "kind", "period").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target").alias("n_targets"))
