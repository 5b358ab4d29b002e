"""Writes: ingest under a contract, files of ingested rows, and lineage events."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import files
from loomspan.operators.schemas import contract_issues
from loomspan.operators.views import SYSTEM, cast_to
from loomspan.plans.catalog import Catalog


class ContractError(ValueError):
    """Rows that a table's contract doesn't admit."""


def with_system(df: DataFrame, run_id: str, artifact_id: str, year: int | None = None, iteration: int | None = None) -> DataFrame:
    values = dict(zip(SYSTEM, (run_id, artifact_id, year, iteration)))
    return df.drop(*values).select("*", *(F.lit(v).cast(SYSTEM[c]).alias(c) for c, v in values.items()))


def ingest(catalog: Catalog, table: str, df: DataFrame, run_id: str, artifact_id: str, year: int | None = None, iteration: int | None = None, contract: T.StructType | None = None, additive: bool = False, content_hash: str | None = None) -> bool:
    """Append rows with their system columns, as a part of the table that is tagged with the run. Under a contract extra
    columns are an error unless additive, and types must fit; without one the table's schema grows and widens. Content
    that is there already is not ingested again (False)."""
    if contract is not None:
        issues = contract_issues(df, contract, additive)
        if issues:
            raise ContractError("; ".join(issues))
        known = {f.name: f for f in contract}
        df = cast_to(df, T.StructType([*contract, *(f for f in df.schema if f.name not in known)]))
    rows = with_system(df, run_id, artifact_id, year, iteration)
    if content_hash is not None:
        rows = rows.withColumn("prov_content_hash", F.lit(content_hash))
    if content_hash is not None and catalog.path(table):
        old = catalog.read(table)
        if "prov_content_hash" in old.columns and not old.where(F.col("prov_content_hash") == content_hash).limit(1).isEmpty():
            return False
    catalog.append(table, rows, {"run_id": run_id, "artifact_id": artifact_id})
    return True


def write_single(df: DataFrame, path: str, driver: str = "parquet", overwrite: bool = False) -> None:
    """One file of a small frame, or else (more than one partition) a folder; it appears whole or not at all."""
    spark, folder, name = df.sparkSession, *path.rstrip("/").rpartition("/")[::2]
    there = files.exists(spark, path)
    if there and not overwrite:
        raise FileExistsError(path)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if driver == "csv" else df.write
    getattr(writer, driver)(part)
    if there:
        files.remove(spark, path)
    written = [n for n in files.names(spark, part) if n.startswith("part-")]
    if len(written) == 1:
        files.move(spark, f"{part}/{written[0]}", path)
        files.remove(spark, part)
    else:
        files.move(spark, part, path)


def materialize(hot: DataFrame, artifact_id: str, path: str, driver: str = "parquet", overwrite: bool = False) -> None:
    """The file of an ingested artifact, from its rows, without system columns."""
    rows = hot.where(F.col("prov_artifact_id") == artifact_id)
    write_single(rows.drop(*(c for c in rows.columns if c.startswith("prov_"))), path, driver, overwrite)


def run_event(kind: str, run: dict[str, Any], inputs: list[dict] = (), outputs: list[dict] = (), error: str | None = None, namespace: str = "loomspan") -> dict:
    """A lineage event in the form of the OpenLineage run event."""
    data = lambda a: {"namespace": namespace, "name": a.get("key") or a["id"], "facets": {"dataSource": {"uri": a.get("container_uri")}}}
    facets = {"errorMessage": {"message": error}} if error else {}
    if run.get("parent_run_id"):
        facets["parent"] = {"run": {"runId": run["parent_run_id"]}, "job": {"namespace": namespace, "name": run["parent_run_id"]}}
    return {"eventType": kind, "eventTime": datetime.now(timezone.utc).isoformat(), "run": {"runId": run["id"], "facets": facets}, "job": {"namespace": namespace, "name": run.get("model_name") or run["id"]}, "inputs": [data(a) for a in inputs], "outputs": [data(a) for a in outputs]}


def append_event(path: str, event: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(event, ensure_ascii=False, default=str) + "\n")


def run_events(runs: DataFrame, links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, event): the completion events of many runs as JSON."""
    data = F.struct(F.lit("loomspan").alias("namespace"), F.coalesce("key", "artifact_id").alias("name"))
    used = links.join(artifacts.select(F.col("id").alias("artifact_id"), "key"), "artifact_id", "left").groupBy("run_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("direction") == d, data))).alias(f"{d}s") for d in ("input", "output")))
    joined = runs.withColumnRenamed("id", "run_id").join(used, "run_id", "left")
    kind = F.when(F.col("status") == "failed", "FAIL").when(F.col("status") == "completed", "COMPLETE").otherwise("START")
    event = F.struct(kind.alias("eventType"), F.coalesce("ended_at", "started_at").alias("eventTime"), F.struct(F.col("run_id").alias("runId")).alias("run"), F.struct(F.lit("loomspan").alias("namespace"), F.col("model_name").alias("name")).alias("job"), "inputs", "outputs")
    return joined.select("run_id", F.to_json(event).alias("event"))
