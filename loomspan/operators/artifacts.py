"""Search and deduplication of artifacts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.predicates import Predicate
from loomspan.operators.facets import having_all
from loomspan.operators.recency import by_creation, first_of_group


def linked(artifacts: DataFrame, links: DataFrame, *, creator: str | None = None, consumer: str | None = None, key: str | None = None, limit: int | None = None) -> DataFrame:
    """Artifacts made by one run and read by another, newest first; a condition of None is none."""
    out = artifacts if key is None else artifacts.where(F.col("key") == key)
    for run, direction in ((creator, "output"), (consumer, "input")):
        if run is not None:
            out = out.join(links.where((F.col("run_id") == run) & (F.col("direction") == direction)).select(F.col("artifact_id").alias("id")), "id", "left_semi")
    out = out.orderBy(*by_creation())
    return out if limit is None else out.limit(limit)


def by_facets(artifacts: DataFrame, kv: DataFrame, predicates: Iterable[Predicate | str], *, namespace: str | None = None, key_prefix: str | None = None, family_prefix: str | None = None, limit: int | None = 100) -> DataFrame:
    """Artifacts that meet all facet predicates and prefixes of key and family, newest first."""
    out = having_all(artifacts, "id", kv, "artifact_id", predicates, namespace=namespace)
    if key_prefix is not None:
        out = out.where(F.col("key").startswith(key_prefix))
    if family_prefix is not None:
        family = kv.where((F.col("key_path") == "artifact_family") & F.col("value_str").startswith(family_prefix))
        out = out.join(family.select(F.col("artifact_id").alias("id")), "id", "left_semi")
    out = out.orderBy(*by_creation())
    return out if limit is None else out.limit(limit)


def get_artifact(artifacts: DataFrame, key_or_id: str, run_id: str | None = None) -> DataFrame:
    """The artifact with this id, or the newest with this key."""
    out = artifacts if run_id is None else artifacts.where(F.col("run_id") == run_id)
    hit = out.where((F.col("id") == key_or_id) | (F.col("key") == key_or_id))
    return hit.orderBy((F.col("id") == key_or_id).desc(), *by_creation()).limit(1)


def latest_at(artifacts: DataFrame, lookups: DataFrame, on: Sequence[str] = ("container_uri",), produced_only: bool = True) -> DataFrame:
    """For each distinct lookup the newest artifact with equal (null-safe) columns ``on``; made by a run unless told otherwise."""
    pool = artifacts.where("run_id IS NOT NULL") if produced_only else artifacts
    wanted = lookups.select(*(F.col(c).alias(f"_w_{c}") for c in on)).distinct()
    condition = [pool[c].eqNullSafe(wanted[f"_w_{c}"]) for c in on]
    return first_of_group(pool.join(wanted, condition, "left_semi"), on, by_creation())


def latest_by_hash(artifacts: DataFrame, content_hash: str, driver: str | None = None, produced_only: bool = True) -> DataFrame:
    out = artifacts.where(F.col("hash") == content_hash)
    if driver is not None:
        out = out.where(F.col("driver") == driver)
    if produced_only:
        out = out.where("run_id IS NOT NULL")
    return out.orderBy(*by_creation()).limit(1)


def children(artifacts: DataFrame, parent: str) -> DataFrame:
    return artifacts.where(F.col("parent_artifact_id") == parent).orderBy("key", "id")


def contents(artifacts: DataFrame) -> DataFrame:
    """(content_hash, driver, content_id, n_artifacts, first_id): the distinct contents; artifacts without hash have none.

    The id is derived from hash and driver, so that it is the same in every catalog.
    """
    known = artifacts.where("hash IS NOT NULL")
    grouped = known.groupBy(F.col("hash").alias("content_hash"), "driver").agg(F.count(F.lit(1)).alias("n_artifacts"), F.min("id").alias("first_id"))
    return grouped.withColumn("content_id", F.sha2(F.concat_ws("|", "content_hash", F.coalesce("driver", F.lit(""))), 256))


def same_content(artifacts: DataFrame, artifact_id: str) -> DataFrame:
    """The other artifacts with the hash and driver of this one."""
    one = artifacts.where(F.col("id") == artifact_id).select(F.col("hash").alias("_h"), F.col("driver").alias("_d"))
    return artifacts.where(F.col("id") != artifact_id).join(F.broadcast(one.limit(1)), (F.col("hash") == F.col("_h")) & F.col("driver").eqNullSafe(F.col("_d")), "left_semi")


def fill_content_ids(artifacts: DataFrame) -> DataFrame:
    """Artifacts with the content id of their hash and driver where it is missing."""
    derived = F.sha2(F.concat_ws("|", "hash", F.coalesce("driver", F.lit(""))), 256)
    return artifacts.withColumn("content_id", F.coalesce("content_id", F.when(F.col("hash").isNotNull(), derived)))


def newest_per_hash(artifacts: DataFrame, driver: str | None = None) -> DataFrame:
    """The newest artifact of each content hash, on wish of one driver."""
    known = artifacts.where(F.col("hash").isNotNull()) if driver is None else artifacts.where(F.col("hash").isNotNull() & (F.col("driver") == driver))
    return first_of_group(known, ["hash"], by_creation())


def missing_files(artifacts: DataFrame, listing: DataFrame) -> DataFrame:
    """The artifacts whose file or folder is not in ``listing`` (path), a listing of the places they lie in; ingested ones count as there.

    The listing is joined, so no file is asked for one by one.
    """
    from loomspan.functions.files import FILE_SCHEME

    plain = lambda c: F.regexp_replace(F.regexp_replace(c, FILE_SCHEME, "/"), "/+$", "")
    found = listing.select(plain(F.col("path")).alias("_path"))
    folders = found.select(F.regexp_replace("_path", "/[^/]*$", "").alias("_path"))
    there = found.unionByName(folders).distinct()
    ingested = F.coalesce(F.get_json_object("meta", "$.is_ingested") == "true", F.lit(False))
    return artifacts.where(~ingested).withColumn("_path", plain(F.col("container_uri"))).join(there, "_path", "left_anti").drop("_path")
