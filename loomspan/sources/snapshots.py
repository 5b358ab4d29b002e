"""JSON snapshot files of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans.catalog import TABLES

_RUN = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in TABLES["run"].split(", ") if c.split()[0] != "meta")
_ARTIFACT = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in TABLES["artifact"].split(", ") if c.split()[0] != "meta")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(run, inputs, outputs) of every document; files that are no JSON give null members."""
    schema = f"run struct<{_RUN}>, inputs array<struct<{_ARTIFACT}>>, outputs array<struct<{_ARTIFACT}>>"
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
