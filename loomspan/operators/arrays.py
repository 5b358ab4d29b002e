"""Metadata of array, matrix and spatial data across runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_lists(rows: DataFrame, by: Sequence[str], index: str, value: str, out: str) -> DataFrame:
    """(by, out): the values of each group as a list in the order of ``index``."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias(out))


def of_runs(rows: DataFrame, artifacts: DataFrame, runs: DataFrame, key: str | None = None, run_ids: Sequence[str] | None = None, year: int | None = None) -> DataFrame:
    """Metadata rows (artifact_id, ...) with the run, year and iteration they belong to."""
    a = artifacts if key is None else artifacts.where(F.col("key") == key)
    r = runs if run_ids is None else runs.where(F.col("id").isin(list(run_ids)))
    r = r if year is None else r.where(F.col("year") == year)
    known = a.select(F.col("id").alias("artifact_id"), F.col("key").alias("artifact_key"), "run_id").join(r.select(F.col("id").alias("run_id"), "year", "iteration"), "run_id")
    return rows.join(known, "artifact_id")


def variables(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Array variables (name, dims, shape, dtype, kind) with their number of cells."""
    out = rows if kind is None else rows.where(F.col("kind") == kind)
    return out.withColumn("n_cells", F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x))


def dimension_sizes(rows: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, dimension, size): the largest size of each dimension over all variables."""
    pairs = rows.select(*by, F.explode(F.arrays_zip("dims", "shape")).alias("p"))
    return pairs.groupBy(*by, F.col("p.dims").alias("dimension")).agg(F.max("p.shape").alias("size"))


def matrices(rows: DataFrame, min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    out = rows if min_rows is None else rows.where(F.col("n_rows") >= min_rows)
    return out if max_rows is None else out.where(F.col("n_rows") <= max_rows)


def zone_counts(rows: DataFrame) -> DataFrame:
    """(run_id, n_zones): the rows of the first matrix by name of each run."""
    return rows.groupBy("run_id").agg(F.min_by("n_rows", "matrix_name").alias("n_zones"))


def matrix_names(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    return (rows if run_id is None else rows.where(F.col("run_id") == run_id)).select("matrix_name").distinct()


def compare_matrices(rows: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """(matrix_name, a column per run): the shape of each matrix as rows x columns, N/A where a run lacks it."""
    shape = F.concat_ws("x", "n_rows", "n_cols")
    wide = rows.where(F.col("run_id").isin(list(run_ids))).groupBy("matrix_name").pivot("run_id", list(run_ids)).agg(F.min(shape))
    return wide.na.fill("N/A", list(run_ids))


def stacked(frames: dict[str, DataFrame]) -> DataFrame:
    """Long-form cells of the same array from several runs, with the run as a further dimension."""
    from loomspan.operators.skew import union_all

    return union_all([df.withColumn("run_id", F.lit(run)) for run, df in frames.items()])


def bounds(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, min_x, min_y, max_x, max_y, n_features) of point features; null coordinates count as features only."""
    return points.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), F.count(F.lit(1)).alias("n_features"))


def latest_spatial(rows: DataFrame) -> DataFrame:
    """One spatial metadata row per run: that of the artifact created last."""
    rest = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "artifact_id")).alias("s")).select("run_id", "s.*")
