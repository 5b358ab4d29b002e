"""Care of a catalog: inspection, invariants, purge, export, merge and rebuilding from snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import files
from loomspan.operators import lineage
from loomspan.operators.schemas import can_merge
from loomspan.plans.catalog import KEYS, TABLES, Catalog
from loomspan.session import stage

# The catalog tables that hang on runs and on artifacts, and the column that tells whose row it is.
OF_RUN = {"run": "id", "run_artifact_link": "run_id", "run_config_kv": "run_id", "run_binding_invocation": "run_id"}
OF_ARTIFACT = {"artifact": "id", "artifact_kv": "artifact_id", "artifact_schema_observation": "artifact_id"}


def inspect(runs: DataFrame, artifacts: DataFrame, links: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """(metric, value): counts of runs by status, artifacts, links, artifacts without any link, runs that never ended, and
    whether the snapshots (id) hold the same runs as the catalog."""
    one = lambda df, name, value=F.count(F.lit(1)): df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")
    orphans = artifacts.join(links.select(F.col("artifact_id").alias("id")), "id", "left_anti")
    parts = [
        runs.groupBy("status").count().select(F.concat(F.lit("runs_"), F.coalesce("status", F.lit("unknown"))).alias("metric"), F.col("count").alias("value")),
        one(runs, "runs"),
        one(artifacts, "artifacts"),
        one(links, "links"),
        one(orphans, "orphaned_artifacts"),
        one(runs.where("status = 'running' AND ended_at IS NULL"), "zombie_runs"),
    ]
    if snapshots is not None:
        ids = snapshots.select("id").distinct()
        parts += [one(ids, "json_snapshots"), one(runs.join(ids, "id", "left_anti").unionByName(ids.join(runs, "id", "left_anti"), allowMissingColumns=True), "json_db_differences")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doctor(runs: DataFrame, artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """(issue, id): runs that never ended, completed runs without an end, parents that aren't there, artifacts whose producer isn't."""
    ids = runs.select("id")
    parents = runs.where("parent_run_id IS NOT NULL").join(ids.withColumnRenamed("id", "parent_run_id"), "parent_run_id", "left_anti")
    producers = artifacts.where("run_id IS NOT NULL").join(ids.withColumnRenamed("id", "run_id"), "run_id", "left_anti")
    issue = lambda df, name, c="id": df.select(F.lit(name).alias("issue"), F.col(c).alias("id"))
    return (
        issue(runs.where("status = 'running' AND ended_at IS NULL"), "zombie_run")
        .unionByName(issue(runs.where("status = 'completed' AND ended_at IS NULL"), "completed_without_end"))
        .unionByName(issue(parents, "dangling_parent"))
        .unionByName(issue(producers, "missing_producer"))
    )


def purge_orphans(links: DataFrame, selected: DataFrame) -> DataFrame:
    """(artifact_id): artifacts all of whose links belong to the selected runs (id)."""
    marked = links.join(selected.select(F.col("id").alias("run_id"), F.lit(True).alias("_in")).distinct(), "run_id", "left")
    return marked.groupBy("artifact_id").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all_in")).where("all_in").select("artifact_id")


def unreferenced_hashes(cache_links: DataFrame, selected: DataFrame, column: str = "content_hash") -> DataFrame:
    """Hashes that only the selected runs refer to."""
    gone = cache_links.join(selected.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(column).distinct()
    kept = cache_links.join(selected.select(F.col("id").alias("run_id")), "run_id", "left_anti").select(column)
    return gone.join(kept, column, "left_anti")


@dataclass
class PurgePlan:
    runs: DataFrame
    artifacts: DataFrame
    rows: dict[str, int] = field(default_factory=dict)


def table_mode(columns: Iterable[str]) -> str:
    """How the rows of a data table belong to runs: run_scoped by the system column, run_link by run_id, else unscoped_cache."""
    columns = set(columns)
    return "run_scoped" if "prov_run_id" in columns else "run_link" if "run_id" in columns else "unscoped_cache"


def of_runs(df: DataFrame, runs: DataFrame, how: str = "left_semi") -> DataFrame | None:
    """The rows of a data table that belong to the runs (id); None for a table without scope."""
    column = {"run_scoped": "prov_run_id", "run_link": "run_id"}.get(table_mode(df.columns))
    return df.join(runs.select(F.col("id").alias(column)), column, how).select(*df.columns) if column else None


def _data_tables(catalog: Catalog) -> list[str]:
    return [t for t in catalog.tables() if t not in TABLES]


def _selection(catalog: Catalog, run_ids: Iterable[str], children: bool) -> DataFrame:
    seeds = catalog.spark.createDataFrame([(r,) for r in run_ids], "id string").join(catalog.read("run"), "id", "left_semi")
    return lineage.descendant_runs(catalog.read("run"), seeds).select("id") if children else seeds


def plan_purge(catalog: Catalog, run_ids: Iterable[str], include_children: bool = True) -> PurgePlan:
    """What a purge of these runs would delete, counted per table, before anything is deleted."""
    runs = stage(_selection(catalog, run_ids, include_children), "purge")
    artifacts = stage(purge_orphans(catalog.read("run_artifact_link"), runs), "purge")
    plan = PurgePlan(runs, artifacts)
    for table, column in OF_RUN.items():
        plan.rows[table] = catalog.read(table).join(runs.select(F.col("id").alias(column)), column, "left_semi").count()
    for table, column in OF_ARTIFACT.items():
        plan.rows[table] = catalog.read(table).join(artifacts.select(F.col("artifact_id").alias(column)), column, "left_semi").count()
    for table in _data_tables(catalog):
        rows = of_runs(catalog.read(table), runs)
        if rows is not None:
            plan.rows[table] = rows.count()
    return plan


def purge(catalog: Catalog, run_ids: Iterable[str], include_children: bool = True, delete_data: bool = True, dry_run: bool = False) -> PurgePlan:
    """Delete runs, what hangs on them, artifacts that only they link, and their rows of data tables."""
    plan = plan_purge(catalog, run_ids, include_children)
    if dry_run:
        return plan
    runs, gone = plan.runs, plan.artifacts
    for table, column in OF_ARTIFACT.items():
        catalog.replace(table, catalog.read(table).join(gone.select(F.col("artifact_id").alias(column)), column, "left_anti").select(*catalog.read(table).columns))
    if delete_data:
        for table in _data_tables(catalog):
            rest = of_runs(catalog.read(table), runs, "left_anti")
            if rest is not None:
                catalog.replace(table, rest)
    for table, column in OF_RUN.items():
        catalog.replace(table, catalog.read(table).join(runs.select(F.col("id").alias(column)), column, "left_anti").select(*catalog.read(table).columns))
    return plan


def export(catalog: Catalog, run_ids: Iterable[str], out: str, include_children: bool = True, include_data: bool = True) -> Catalog:
    """A catalog of its own with these runs, their artifacts and all that hangs on both."""
    shard = Catalog(catalog.spark, out)
    runs = _selection(catalog, run_ids, include_children)
    for table, column in OF_RUN.items():
        shard.replace(table, catalog.read(table).join(runs.select(F.col("id").alias(column)), column, "left_semi").select(*catalog.read(table).columns))
    linked = shard.read("run_artifact_link").select(F.col("artifact_id").alias("id")).unionByName(catalog.read("artifact").join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").select("id")).distinct()
    for table, column in OF_ARTIFACT.items():
        shard.replace(table, catalog.read(table).join(linked.select(F.col("id").alias(column)), column, "left_semi").select(*catalog.read(table).columns))
    used = {
        "artifact_schema": (shard.read("artifact_schema_observation").select(F.col("schema_id").alias("id")), ["id"]),
        "artifact_schema_field": (shard.read("artifact_schema_observation").select("schema_id"), ["schema_id"]),
        "artifact_schema_relation": (shard.read("artifact_schema_observation").select("schema_id"), ["schema_id"]),
        "artifact_content": (shard.read("artifact").select("content_id"), ["content_id"]),
        "config_facet": (shard.read("run_config_kv").select("facet_id", "namespace"), ["facet_id", "namespace"]),
        "artifact_facet": (shard.read("artifact_kv").select("facet_id", "namespace"), ["facet_id", "namespace"]),
    }
    for table, (keys, on) in used.items():
        shard.replace(table, catalog.read(table).join(keys.distinct(), on, "left_semi").select(*catalog.read(table).columns))
    if include_data:
        for table in _data_tables(catalog):
            rows = of_runs(catalog.read(table), runs)
            if rows is not None:
                shard.replace(table, rows)
    return shard


def common_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """The columns of both, in the target's order."""
    return [c for c in target.columns if c in source.columns]


def insert_if_absent(target: DataFrame, shard: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the shard's rows whose key it lacks, reduced to the columns both have; others are null."""
    shared = common_columns(shard, target)
    new = shard.join(target.select(*keys), keys, "left_anti").select(*shared)
    return target.unionByName(new, allowMissingColumns=True)


def merge(catalog: Catalog, shard: Catalog, conflict: str = "error", dry_run: bool = False) -> dict[str, int]:
    """Insert what the catalog lacks. A run that is in both is a conflict: ``error`` raises, ``skip`` keeps the catalog's.

    Data tables need compatible types; tables without scope are never merged. Returns the rows inserted per table, and
    under ``conflicts_detected`` the runs in both.
    """
    if conflict not in ("error", "skip"):
        raise ValueError(f"unknown policy for conflicts: {conflict}")
    double = shard.read("run").join(catalog.read("run").select("id"), "id", "left_semi")
    n = double.count()
    if n and conflict == "error":
        raise ValueError(f"{n} runs are in both catalogs")
    done = {"conflicts_detected": n}
    fresh = stage(shard.read("run").join(catalog.read("run").select("id"), "id", "left_anti").select("id"), "merge")
    for table in _data_tables(shard):
        rows = of_runs(shard.read(table), fresh)
        if rows is None:
            continue
        if catalog.path(table):
            target = catalog.read(table)
            bad = [c for c in common_columns(rows, target) if not can_merge(rows.schema[c].dataType, target.schema[c].dataType)]
            if bad:
                raise ValueError(f"{table}: types of {', '.join(bad)} do not fit")
            rows = rows.select(*(F.col(c).cast(target.schema[c].dataType) for c in common_columns(rows, target)))
            done[table] = rows.count()
            if not dry_run:
                catalog.append(table, rows)
        else:
            done[table] = rows.count()
            if not dry_run:
                catalog.replace(table, rows)
    for table in TABLES:
        if shard.path(table):
            before, after = catalog.read(table), insert_if_absent(catalog.read(table), shard.read(table), KEYS[table])
            done[table] = after.count() - before.count()
            if not dry_run and done[table]:
                catalog.replace(table, after)
    return done


def fix_status(catalog: Catalog, run_id: str, status: str, reason: str | None = None, force: bool = False) -> None:
    """Set the status of one run; one that has ended is only changed by ``force``."""
    runs = catalog.read("run")
    row = runs.where(F.col("id") == run_id).select("status").head()
    if row is None:
        raise KeyError(run_id)
    if row.status in ("completed", "failed") and not force:
        raise ValueError(f"run {run_id} has ended as {row.status}")
    hit = F.col("id") == run_id
    meta = F.coalesce("meta", F.lit("{}"))
    noted = F.to_json(F.map_concat(F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("status_reason"), F.lit(reason or ""))))
    catalog.replace("run", runs.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "meta": F.when(hit & F.lit(reason is not None), noted).otherwise(F.col("meta"))}))


def rebuild_from_json(catalog: Catalog, folder: str, dry_run: bool = False, mode: str = "minimal") -> int:
    """Insert the runs of snapshot files (``{"run": {...}, "inputs": [...], "outputs": [...]}``) that the catalog lacks; ``full`` also their artifacts and links."""
    from loomspan.sources.snapshots import read_snapshots

    docs = read_snapshots(catalog.spark, folder)
    runs = docs.select("run.*").where("id IS NOT NULL").join(catalog.read("run").select("id"), "id", "left_anti")
    n = runs.count()
    if dry_run or not n:
        return n
    if mode == "full":
        parts = [docs.select(F.col("run.id").alias("_run"), F.explode_outer(side).alias("a"), F.lit(side[:-1]).alias("direction")).where("a.id IS NOT NULL") for side in ("inputs", "outputs")]
        both = parts[0].unionByName(parts[1])
        catalog.upsert("artifact", both.select("a.*").join(catalog.read("artifact").select("id"), "id", "left_anti"))
        catalog.upsert("run_artifact_link", both.select(F.col("_run").alias("run_id"), F.col("a.id").alias("artifact_id"), "direction", F.lit(False).alias("is_implicit")))
    catalog.append("run", runs)
    return n


def stage_phase_from_meta(runs: DataFrame) -> DataFrame:
    """Runs with stage and phase taken from meta where they are missing."""
    return runs.withColumns({c: F.coalesce(F.col(c), F.get_json_object("meta", f"$.{c}")) for c in ("stage", "phase")})


def write_json(catalog: Catalog, folder: str, run_id: str) -> str:
    """The snapshot file of one run, as :func:`rebuild_from_json` reads it."""
    run = catalog.read("run").where(F.col("id") == run_id).select(F.to_json(F.struct("*")).alias("j")).head()
    links = catalog.read("run_artifact_link").where(F.col("run_id") == run_id).select(F.col("artifact_id").alias("id"), "direction")
    rows = catalog.read("artifact").join(links, "id").select("direction", F.to_json(F.struct(*TABLES_ARTIFACT)).alias("j")).collect()
    doc = {"run": json.loads(run.j), **{f"{d}s": [json.loads(r.j) for r in rows if r.direction == d] for d in ("input", "output")}}
    to = f"{folder.rstrip('/')}/{run_id}.json"
    part = f"{folder.rstrip('/')}/.{run_id}.{uuid.uuid4().hex}"
    files.write_text(catalog.spark, part, json.dumps(doc, ensure_ascii=False))
    files.remove(catalog.spark, to)
    files.move(catalog.spark, part, to)
    return to


TABLES_ARTIFACT = [c.split()[0] for c in TABLES["artifact"].split(", ")]
