"""Hybrid and grouped views planned from a catalog: which files and ingested rows belong to a view, and with which facets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.predicates import Predicate
from loomspan.functions.types import named_type
from loomspan.operators import views
from loomspan.operators.facets import having_all, newest_values, typed_text
from loomspan.operators.schemas import compatible, parse_type
from loomspan.operators.views import TABULAR, Source
from loomspan.plans.catalog import Catalog


def ingested(meta: str = "meta") -> Column:
    return F.coalesce(F.get_json_object(meta, "$.is_ingested") == "true", F.lit(False))


def mark_ingested(catalog: Catalog, artifact_id: str, table: str) -> None:
    """Note in an artifact's meta that its rows lie in a data table."""
    a = catalog.read("artifact")
    hit = F.col("id") == artifact_id
    old = F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~k.isin("is_ingested", "table_name")), F.create_map(F.lit("is_ingested"), F.lit("true"), F.lit("table_name"), F.lit(table))))
    catalog.replace("artifact", a.withColumn("meta", F.when(hit, new).otherwise(F.col("meta"))))


def of_view(catalog: Catalog, drivers: Sequence[str] = TABULAR, **run_fields: Any) -> DataFrame:
    """Artifacts of the given drivers with their run; ``run_fields`` (run_id, parent_run_id, model, status, year, iteration) filter the runs."""
    run = catalog.read("run").select(F.col("id").alias("run_id"), "parent_run_id", F.col("model_name").alias("model"), "status", "year", "iteration")
    for name, value in run_fields.items():
        if value is not None:
            run = run.where(F.col(name) == value)
    a = catalog.read("artifact").where(F.col("driver").isin(list(drivers)))
    return a.join(run, "run_id").withColumns({"is_ingested": ingested(), "table_name": F.coalesce(F.get_json_object("meta", "$.table_name"), "key")})


def select_artifacts(catalog: Catalog, schema_ids: Sequence[str], *, schema_compatible: bool = False, predicates: Iterable[str | Predicate] = (), namespace: str | None = None, drivers: Sequence[str] = TABULAR, limit: int | None = None, **run_fields: Any) -> DataFrame:
    """The artifacts of a grouped view: observed under one of the schemas (or a compatible one) and meeting all facet predicates, oldest first."""
    wanted = list(schema_ids)
    if schema_compatible:
        fields = catalog.read("artifact_schema_field")
        wanted = sorted({r.schema_id for s in schema_ids for r in compatible(fields, s).select("schema_id").collect()} | set(schema_ids))
    seen = catalog.read("artifact_schema_observation").where(F.col("schema_id").isin(wanted)).select(F.col("artifact_id").alias("id"))
    chosen = of_view(catalog, drivers, **run_fields).join(seen, "id", "left_semi")
    chosen = having_all(chosen, "id", catalog.read("artifact_kv"), "artifact_id", predicates, namespace=namespace).orderBy("created_at", "id")
    return chosen if limit is None else chosen.limit(limit)


def facet_values(catalog: Catalog, chosen: DataFrame, facets: Sequence[str], namespace: str | None = None, run_namespace: str | None = None) -> DataFrame:
    """(artifact_id, facet, kind, value): the value of each facet of each artifact, its own before its run's.

    An artifact's null also stands before the run's value. Run facets are only used in ``run_namespace``, or, without
    it, if the selected runs have one namespace for these keys.
    """
    own = catalog.read("artifact_kv").where(F.col("key_path").isin(list(facets)))
    own = own if namespace is None else own.where(F.col("namespace") == namespace)
    own = newest_values(own.join(chosen.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi"), "artifact_id")
    own = own.select("artifact_id", F.col("key_path").alias("facet"), named_short("value_type").alias("kind"), typed_text().alias("value"), F.lit(0).alias("_rank"))
    kv = catalog.read("run_config_kv").where(F.col("key").isin(list(facets))).join(chosen.select("run_id").distinct(), "run_id", "left_semi")
    if run_namespace is None:
        spaces = [r[0] for r in kv.select("namespace").distinct().limit(2).collect()]
        run_namespace = spaces[0] if len(spaces) == 1 else None
    if run_namespace is None:
        return own.drop("_rank")
    of_run = newest_values(kv.where(F.col("namespace") == run_namespace), "run_id", "key").join(chosen.select(F.col("id").alias("artifact_id"), "run_id"), "run_id")
    both = own.unionByName(of_run.select("artifact_id", F.col("key").alias("facet"), named_short("value_type").alias("kind"), typed_text().alias("value"), F.lit(1).alias("_rank")))
    return both.groupBy("artifact_id", "facet").agg(F.min_by(F.struct("kind", "value"), "_rank").alias("v")).select("artifact_id", "facet", "v.*")


def named_short(col: str) -> Column:
    """The short label of a value type: bool, int, float, str, json or null."""
    full = named_type(col)
    short = {"boolean": "bool", "integer": "int", "string": "str"}
    return F.coalesce(*(F.when(full == k, F.lit(v)) for k, v in short.items()), full)


def _sources(rows: list, facets: Mapping[str, Mapping[str, Any]], root: str | None) -> list[Source]:
    place = lambda uri: uri if root is None or "://" in uri or uri.startswith("/") else f"{root.rstrip('/')}/{uri}"
    return [Source(place(r.container_uri), r.driver, r.run_id, r.id, r.year, r.iteration, r.parent_run_id, facets.get(r.id, {})) for r in rows]


def _read(kind: str, value: str | None) -> Any:
    if value is None:
        return None
    return {"bool": lambda v: v == "true", "int": lambda v: int(float(v)), "float": float}.get(kind, str)(value)


def hybrid_view(catalog: Catalog, key: str, name: str | None = None, *, drivers: Sequence[str] = TABULAR, missing: str = "warn", columns: Mapping[str, str] | None = None, root: str | None = None, if_exists: str = "replace") -> DataFrame:
    """All rows of one artifact key: those ingested into the table of that name, and those of its files that aren't ingested."""
    cold = of_view(catalog, drivers).where((F.col("key") == key) & ~F.col("is_ingested")).orderBy("created_at", "id")
    hot = views.hot_rows(catalog.read(key), None, catalog.read("run")) if catalog.path(key) else None
    out = views.hybrid(catalog.spark, hot, _sources(cold.collect(), {}, root), missing=missing, columns=columns)
    return views.register(out, name or f"v_{key}", if_exists)


def grouped_view(
    catalog: Catalog,
    schema_ids: Sequence[str],
    name: str,
    *,
    attach_facets: Sequence[str] = (),
    namespace: str | None = None,
    run_namespace: str | None = None,
    mode: str = "hybrid",
    missing: str = "warn",
    system: bool = True,
    if_exists: str = "replace",
    root: str | None = None,
    **selection: Any,
) -> DataFrame:
    """One view over all artifacts of a schema, across keys, with facets as typed columns.

    Two phases: the selection is read from the catalog first (one row per artifact), then the plan over exactly these
    files and ingested rows is built. Without any artifact the view is empty and typed by the schema's fields.
    """
    chosen = select_artifacts(catalog, schema_ids, namespace=namespace, **selection)
    rows = chosen.collect()
    values = facet_values(catalog, chosen, attach_facets, namespace, run_namespace).collect() if attach_facets and rows else []
    kinds = {f: {v.kind for v in values if v.facet == f and v.kind != "null"} for f in attach_facets}
    by_artifact: dict[str, dict[str, Any]] = {}
    for v in values:
        by_artifact.setdefault(v.artifact_id, {})[v.facet] = _read(v.kind, v.value) if views.facet_type(kinds[v.facet]) != "string" else v.value
    fields = catalog.read("artifact_schema_field").where(F.col("schema_id").isin(list(schema_ids))).orderBy("ordinal_position", "name").collect()
    columns = {f.name: parse_type(f.logical_type or "string").simpleString() for f in fields}
    parts = []
    for table in sorted({r.table_name for r in rows if r.is_ingested and catalog.path(r.table_name)}):
        own = [r for r in rows if r.is_ingested and r.table_name == table]
        ddl = "artifact_id string, run_id string, year int, iteration int, scenario_id string" + "".join(f", `{f}` {views.facet_type(kinds[f])}" for f in attach_facets)
        members = catalog.spark.createDataFrame([[r.id, r.run_id, r.year, r.iteration, r.parent_run_id, *(by_artifact.get(r.id, {}).get(f) for f in attach_facets)] for r in own], ddl)
        parts.append(views.hot_rows(catalog.read(table), members, facets=list(attach_facets)))
    hot = views.union_by_name(parts) if parts else None
    sources = _sources([r for r in rows if not r.is_ingested], by_artifact, root)
    out = views.hybrid(catalog.spark, hot, sources, mode=mode, missing=missing, facets=kinds, columns=columns, system=system)
    return views.register(out, name, if_exists)


class ViewRegistry:
    """Views by attribute name: each access plans the view anew, so that new files are seen."""

    def __init__(self, catalog: Catalog):
        self._catalog, self._keys = catalog, {}

    def register(self, name: str, key: str | None = None, columns: Mapping[str, str] | None = None) -> None:
        self._keys[name] = (key or name.lower(), columns)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._keys:
            raise AttributeError(name)
        key, columns = self._keys[name]
        return hybrid_view(self._catalog, key, columns=columns)
