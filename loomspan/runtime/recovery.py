"""Bytes of artifacts: identity checks, recovery of missing files, staging and archives."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspan.functions import files
from loomspan.plans.catalog import Catalog
from loomspan.runtime.tracker import RunResult, file_hash
from loomspan.sources.sinks import materialize


@dataclass(frozen=True)
class Identity:
    """``status`` is verified, mismatched, unverified (no hash is known) or unreadable."""

    status: str
    expected: str | None = None
    found: str | None = None


def check_identity(artifact: Mapping, path: str, fast: bool = False, spark: SparkSession | None = None) -> Identity:
    """Whether the bytes at ``path`` are those of the artifact."""
    try:
        found = file_hash(path, fast, spark)
    except (OSError, AnalysisException):
        return Identity("unreadable", artifact.get("hash"))
    if not artifact.get("hash"):
        return Identity("unverified", None, found)
    return Identity("verified" if found == artifact["hash"] else "mismatched", artifact["hash"], found)


def copy_whole(spark: SparkSession, source: str, to: str) -> None:
    """Copy a file or folder, also between file systems, so that it appears at once."""
    folder, name = to.rstrip("/").rpartition("/")[::2]
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    files.make_folder(spark, folder)
    files.copy(spark, source, part)
    files.remove(spark, to)
    files.move(spark, part, to)


def base_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def outputs_of(catalog: Catalog, run_id: str) -> list[dict]:
    made = catalog.read("run_artifact_link").where((F.col("run_id") == run_id) & (F.col("direction") == "output")).select(F.col("artifact_id").alias("id"))
    return [r.asDict() for r in catalog.read("artifact").join(made, "id", "left_semi").orderBy("key", "id").collect()]


def hydrate(catalog: Catalog, run_id: str, target_root: str, keys: Iterable[str] | None = None, preserve: bool = True, archives: Iterable[str] = (), validate: bool = False) -> dict[str, str]:
    """Bring the outputs of a run under ``target_root``: from their place, else an archive, else their ingested rows.

    Returns for each key what was done: preserved, copied, archived, rebuilt, or missing. With ``validate`` a copy whose
    bytes aren't the artifact's counts as missing.
    """
    done = {}
    wanted = None if keys is None else set(keys)
    for a in outputs_of(catalog, run_id):
        if wanted is not None and a["key"] not in wanted:
            continue
        spark, name = catalog.spark, base_name(a["container_uri"])
        to = f"{target_root.rstrip('/')}/{name}"
        places = [(a["container_uri"], "copied"), *((f"{root.rstrip('/')}/{run_id}/{name}", "archived") for root in archives)]
        found = next(((p, how) for p, how in places if files.exists(spark, p) and (not validate or check_identity(a, p, spark=spark).status in ("verified", "unverified"))), None)
        if preserve and files.exists(spark, to):
            done[a["key"]] = "preserved"
        elif found:
            copy_whole(spark, found[0], to)
            done[a["key"]] = found[1]
        elif catalog.path(a["key"]) and not catalog.read(a["key"]).where(F.col("prov_artifact_id") == a["id"]).isEmpty():
            materialize(catalog.read(a["key"]), a["id"], to, a["driver"], overwrite=True)
            done[a["key"]] = "rebuilt"
        else:
            done[a["key"]] = "missing"
    return done


def restore(catalog: Catalog, artifact: Mapping, archives: Iterable[str] = ()) -> str:
    """Bring an artifact that is gone back to its own place, from an archive or its ingested rows; returns how."""
    spark, to = catalog.spark, artifact["container_uri"]
    for root in archives:
        source = f"{root.rstrip('/')}/{artifact.get('run_id')}/{base_name(to)}"
        if files.exists(spark, source):
            copy_whole(spark, source, to)
            return "archived"
    if catalog.path(artifact["key"]) and not (rows := catalog.read(artifact["key"]).where(F.col("prov_artifact_id") == artifact["id"])).isEmpty():
        materialize(rows, artifact["id"], to, artifact["driver"], overwrite=True)
        return "rebuilt"
    raise FileNotFoundError(to)


def archive(catalog: Catalog, run_id: str, root: str, keys: Iterable[str] | None = None, move: bool = False) -> dict[str, str]:
    """Copy or move the outputs of a run into an archive; the catalog notes the new place of what was moved."""
    wanted, places = None if keys is None else set(keys), {}
    for a in outputs_of(catalog, run_id):
        if (wanted is None or a["key"] in wanted) and files.exists(catalog.spark, a["container_uri"]):
            to = f"{root.rstrip('/')}/{run_id}/{base_name(a['container_uri'])}"
            copy_whole(catalog.spark, a["container_uri"], to)
            places[a["id"]] = to
            if move:
                files.remove(catalog.spark, a["container_uri"])
    if move and places:
        moved = catalog.spark.createDataFrame(list(places.items()), "id string, _to string")
        rows = catalog.read("artifact").join(F.broadcast(moved), "id", "left")
        catalog.replace("artifact", rows.withColumn("container_uri", F.coalesce("_to", "container_uri")).drop("_to"))
    return places


def stage_inputs(spark: SparkSession, paths: Mapping[str, str], folder: str) -> dict[str, str]:
    """Copies of input files under a run's folder, by key."""
    staged = {k: f"{folder.rstrip('/')}/{base_name(p)}" for k, p in paths.items()}
    for k, p in paths.items():
        copy_whole(spark, p, staged[k])
    return staged


class NoopTracker:
    """Stands in for a tracker: steps run on what they are given, nothing is recorded or cached."""

    def run(self, fn, name=None, *, config=None, inputs=None, **_):
        result = fn(config=dict(config or {}), **(inputs or {}))
        return RunResult("noop", False, {}, {"result": result})
