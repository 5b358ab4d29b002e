"""The catalog: tables of runs, artifacts, links, facets and schemas, kept as versioned Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import files
from loomspan.operators.views import union_by_name
from loomspan.session import stage

_KV = "facet_id string, namespace string, {key} string, value_type string, value_str string, value_num double, value_bool boolean, value_json string, created_at timestamp_ntz"
# The tables of a catalog and their columns.
TABLES = {
    "run": "id string, parent_run_id string, status string, model_name string, description string, year int, iteration int, stage string, phase string, tags array<string>, config_hash string, git_hash string, input_hash string, signature string, meta string, started_at timestamp_ntz, ended_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "artifact": "id string, key string, container_uri string, table_path string, array_path string, driver string, hash string, content_id string, parent_artifact_id string, run_id string, meta string, created_at timestamp_ntz",
    "artifact_content": "content_id string, content_hash string, driver string, meta string, created_at timestamp_ntz",
    "run_artifact_link": "run_id string, artifact_id string, direction string, is_implicit boolean, created_at timestamp_ntz",
    "run_binding_invocation": "id string, run_id string, binding_hash string, evidence string, created_at timestamp_ntz",
    "config_facet": "facet_id string, namespace string, schema_name string, schema_version string, facet string, created_at timestamp_ntz",
    "artifact_facet": "facet_id string, namespace string, schema_name string, schema_version string, facet string, created_at timestamp_ntz",
    "run_config_kv": "run_id string, " + _KV.format(key="key"),
    "artifact_kv": "artifact_id string, " + _KV.format(key="key_path"),
    "artifact_schema": "id string, profile string, n_fields int, created_at timestamp_ntz",
    "artifact_schema_field": "schema_id string, ordinal_position int, name string, logical_type string, nullable boolean, stats_json string, is_enum boolean, enum_values_json string",
    "artifact_schema_observation": "id string, artifact_id string, schema_id string, run_id string, source string, sample_rows int, observed_at timestamp_ntz",
    "artifact_schema_relation": "schema_id string, field_name string, target_table string, target_field string",
}
KEYS = {
    "run": ["id"], "artifact": ["id"], "artifact_content": ["content_hash", "driver"], "run_artifact_link": ["run_id", "artifact_id", "direction"], "run_binding_invocation": ["id"], "config_facet": ["facet_id", "namespace"], "artifact_facet": ["facet_id", "namespace"],
    "run_config_kv": ["run_id", "facet_id", "namespace", "key"], "artifact_kv": ["artifact_id", "facet_id", "namespace", "key_path"], "artifact_schema": ["id"], "artifact_schema_field": ["schema_id", "name"], "artifact_schema_observation": ["id"], "artifact_schema_relation": ["schema_id", "field_name"],
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


class WriteConflict(RuntimeError):
    """Another writer made the next version of a table first."""


class Catalog:
    """Tables under one folder of any file system that Spark can write.

    A table is a list of parts, each a folder of Parquet files that is written once; a version file names the parts and
    their schemas. A write adds parts and then the next version file, which no one may overwrite: of two writers one
    gets a WriteConflict, and an append tries again. Parts of earlier versions stay until :meth:`vacuum`, so readers of
    an older version keep reading it. Parts of differing schemas are united on reading, with widened types, so a new
    column rewrites nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        files.make_folder(spark, self.root)

    def _versions(self, table: str) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/{table}/_versions") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _parts(self, table: str) -> tuple[int, list[dict]]:
        """The number and the parts of the current version; 0 and none for a table that isn't there. A version that is still being written doesn't count."""
        for name in reversed(self._versions(table)):
            try:
                return int(name[: -len(".json")]), json.loads(files.read_text(self.spark, f"{self.root}/{table}/_versions/{name}") or "")["parts"]
            except json.JSONDecodeError:
                continue
        return 0, []

    def _commit(self, table: str, after: int, parts: list[dict]) -> None:
        at = f"{self.root}/{table}/_versions/{after + 1:012d}.json"
        if not files.write_text(self.spark, at, json.dumps({"parts": parts})):
            raise WriteConflict(f"{table}: version {after + 1} is there already")

    def _write(self, table: str, df: DataFrame, tags: dict[str, str] | None = None) -> dict:
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.root}/{table}/{name}")
        return {"part": name, "schema": df.schema.json(), **({"tags": tags} if tags else {})}

    def path(self, table: str) -> str | None:
        """The folder of a table, None if it isn't there."""
        return f"{self.root}/{table}" if self._versions(table) else None

    def tables(self) -> list[str]:
        return [n for n in files.names(self.spark, self.root) if self._versions(n)]

    def _read(self, table: str, parts: list[dict]) -> DataFrame:
        groups: dict[str, list[str]] = {}
        for p in parts:
            groups.setdefault(p["schema"], []).append(f"{self.root}/{table}/{p['part']}")
        scans = [self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths) for schema, paths in groups.items()]
        return scans[0] if len(scans) == 1 else union_by_name(scans)

    def read(self, table: str) -> DataFrame:
        """The current version; a catalog table that was never written is empty."""
        _, parts = self._parts(table)
        if not parts:
            return self.spark.createDataFrame([], schema_of(table))
        return self._fitted(table, self._read(table, parts)) if table in TABLES else self._read(table, parts)

    def replace(self, table: str, df: DataFrame) -> None:
        """A new version that holds only ``df``."""
        after, _ = self._parts(table)
        self._commit(table, after, [self._write(table, df)])

    def drop(self, table: str) -> None:
        files.remove(self.spark, f"{self.root}/{table}")

    def _fitted(self, table: str, rows: DataFrame | Iterable[dict]) -> DataFrame:
        schema = schema_of(table)
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([[r.get(f.name) for f in schema] for r in rows], schema)
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def append(self, table: str, rows: DataFrame | Iterable[dict], tags: dict[str, str] | None = None, tries: int = 20) -> None:
        """Add rows as a further part, without rewriting any; ``tags`` are noted with the part."""
        part = self._write(table, self._fitted(table, rows) if table in TABLES else rows, tags)
        for left in reversed(range(tries)):
            after, parts = self._parts(table)
            try:
                return self._commit(table, after, [*parts, part])
            except WriteConflict:
                if not left:
                    raise

    def upsert(self, table: str, rows: DataFrame | Iterable[dict]) -> None:
        """Replace the rows of equal key by the new ones; of several new ones the last by its columns' order is kept.

        Only parts that hold one of the keys are rewritten.
        """
        keys = KEYS[table]
        new = self._fitted(table, rows)
        rest = [c for c in new.columns if c not in keys]
        one = stage(new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("v")).select(*keys, "v.*").select(*new.columns), "upsert")
        wanted = one.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        after, parts = self._parts(table)
        hit: set[str] = set()
        if parts:
            at = F.element_at(F.split("_metadata.file_path", "/"), -2)
            held = self.spark.read.schema(schema_of(table)).parquet(*(f"{self.root}/{table}/{p['part']}" for p in parts))
            hit = {r[0] for r in held.select(*keys, at.alias("_part")).join(wanted, same, "left_semi").select("_part").distinct().collect()}
        old = [p for p in parts if p["part"] in hit]
        if old:
            one = self._fitted(table, self._read(table, old)).join(wanted, same, "left_anti").unionByName(one)
        self._commit(table, after, [*(p for p in parts if p["part"] not in hit), self._write(table, one)])

    def drop_parts(self, table: str, tag: str, values: Iterable[str]) -> int:
        """Leave out the parts that carry one of the values of a tag; returns how many."""
        after, parts = self._parts(table)
        gone = set(values)
        kept = [p for p in parts if p.get("tags", {}).get(tag) not in gone]
        if len(kept) < len(parts):
            if not kept:
                kept = [self._write(table, self._read(table, parts).limit(0))]
            self._commit(table, after, kept)
        return len(parts) - len(kept)

    def snapshot(self, to: str, metadata: dict | None = None) -> None:
        """A copy of all current versions, with a note beside it; the copy appears at once or not at all."""
        work = f"{to.rstrip('/')}.{uuid.uuid4().hex}"
        copied = Catalog(self.spark, work)
        for table in self.tables():
            _, parts = self._parts(table)
            for p in parts:
                files.copy(self.spark, f"{self.root}/{table}/{p['part']}", f"{work}/{table}/{p['part']}")
            copied._commit(table, 0, parts)
        files.write_text(self.spark, f"{work}/snapshot.json", json.dumps(metadata or {}, default=str))
        files.remove(self.spark, to)
        files.move(self.spark, work, to)

    def compact(self, table: str, target_bytes: int = 128 * 2**20) -> None:
        """Rewrite a table as one part of files of about ``target_bytes``."""
        _, parts = self._parts(table)
        if parts:
            size = sum(files.size(self.spark, f"{self.root}/{table}/{p['part']}") for p in parts)
            self.replace(table, self.read(table).repartition(max(1, size // target_bytes)))

    def vacuum(self, table: str, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the parts that only they name; their readers must have ended. Returns the parts deleted."""
        versions = self._versions(table)
        folder = f"{self.root}/{table}"
        kept = {p["part"] for v in versions[-keep:] for p in json.loads(files.read_text(self.spark, f"{folder}/_versions/{v}"))["parts"]}
        for v in versions[:-keep]:
            files.remove(self.spark, f"{folder}/_versions/{v}")
        gone = [n for n in files.names(self.spark, folder) if n != "_versions" and n not in kept]
        for n in gone:
            files.remove(self.spark, f"{folder}/{n}")
        return len(gone)
