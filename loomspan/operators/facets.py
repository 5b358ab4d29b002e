"""Facets: nested settings flattened to typed rows, searched by predicates, and pivoted to wide tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.predicates import Predicate, kv_condition, parse

ROW = "key_path string, value_type string, value_str string, value_num double, value_bool boolean, value_json string"
NAMES = ["key_path", "value_type", "value_str", "value_num", "value_bool", "value_json"]


def flatten(facet: Mapping[str, Any], json_leaves: bool = True) -> list[tuple]:
    """Typed rows (see NAMES) of a nested mapping. Key parts are joined by dots, dots inside a part escaped as ``\\.``.

    Lists are leaves of type json, or left out without ``json_leaves``; a blank path is left out.
    """
    rows: list[tuple] = []
    stack: list[tuple[str, Any]] = [("", facet)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, Mapping):
            inner = [(f"{path}.{part}" if path else part, x) for k, x in v.items() for part in (str(k).replace(".", "\\."),)]
            stack += reversed(inner)
        elif not path:
            continue
        elif v is None:
            rows.append((path, "null", None, None, None, None))
        elif isinstance(v, bool):
            rows.append((path, "bool", None, None, v, None))
        elif isinstance(v, (int, float)):
            rows.append((path, "float" if isinstance(v, float) else "int", None, float(v), None, None))
        elif isinstance(v, str):
            rows.append((path, "str", v, None, None, None))
        elif json_leaves:
            rows.append((path, "json", None, None, None, json.dumps(v)))
    return rows


def flatten_column(df: DataFrame, key: str, facet: str, json_leaves: bool = True) -> DataFrame:
    """(key, typed row) of every leaf of the JSON objects in ``facet``; null or unreadable texts and other JSON give none."""
    fields = pa.schema([("key", pa.string()), ("key_path", pa.string()), ("value_type", pa.string()), ("value_str", pa.string()), ("value_num", pa.float64()), ("value_bool", pa.bool_()), ("value_json", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                if isinstance(value, dict):
                    out += [(k, *r) for r in flatten(value, json_leaves)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    kept = df.select(F.col(key).cast("string").alias("key"), F.col(facet).alias("facet"))
    return kept.mapInArrow(rows, f"key string, {ROW}").withColumnRenamed("key", key).withColumn(key, F.col(key).cast(df.schema[key].dataType))


def facet_rows(spark: SparkSession, facets: Mapping[str, Mapping], json_leaves: bool = True) -> DataFrame:
    """Typed rows of facets given on the driver, by the key of each."""
    return spark.createDataFrame([(k, *r) for k, f in facets.items() for r in flatten(f, json_leaves)], f"id string, {ROW}")


def typed_text(kind: str = "value_type") -> Column:
    """The value of a typed row as text."""
    t = F.col(kind)
    number = F.when((t == "int") & (F.abs("value_num") < 2**53), F.col("value_num").cast("bigint").cast("string")).otherwise(F.col("value_num").cast("string"))
    return F.when(t == "bool", F.col("value_bool").cast("string")).when(t.isin("int", "float", "num"), number).when(t == "json", F.col("value_json")).otherwise(F.col("value_str"))


def newest_values(kv: DataFrame, entity: str, key: str = "key_path") -> DataFrame:
    """One row per entity and key: of several, the one created last, then the greatest facet id."""
    others = [c for c in kv.columns if c not in (entity, key)]
    return kv.groupBy(entity, key).agg(F.max_by(F.struct(*others), F.struct("created_at", "facet_id")).alias("v")).select(entity, key, "v.*")


def having_all(entities: DataFrame, on: str, kv: DataFrame, entity: str, predicates: Iterable[Predicate | str], key: str = "key_path", namespace: str | None = None) -> DataFrame:
    """The rows of ``entities`` whose typed values meet every predicate.

    One conditional aggregate over the value rows of any of the predicates, then one semi join; no join per predicate
    and no fan-out. Without predicates all rows are kept.
    """
    read = [parse(p) if isinstance(p, str) else p for p in predicates]
    if not read:
        return entities
    conditions = [F.coalesce(kv_condition(p, key, namespace), F.lit(False)) for p in read]
    some = kv.where(F.col(key).isin(sorted({p.key for p in read})))
    met = some.groupBy(F.col(entity).alias(on)).agg(*(F.bool_or(c).alias(f"_p{i}") for i, c in enumerate(conditions)))
    return entities.join(met.where(" AND ".join(f"_p{i}" for i in range(len(read)))).select(on), on, "left_semi")


def pivot_facets(
    kv: DataFrame,
    keys: Iterable[str],
    entity: str = "run_id",
    key: str = "key",
    namespace: str | None = None,
    value_column: str = "value_num",
    value_columns: Mapping[str, str] | None = None,
    prefix: str = "",
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per entity and one column per key, from the given value column of each key; of several values the greatest.

    An entity without any of the keys has no row. A key that occurs twice in ``keys`` or gives a repeated label is an error.
    """
    keys = list(keys)
    names = [(labels or {}).get(k, f"{prefix}{k}") for k in keys]
    if not keys or len({*names, entity}) <= len(names):
        raise ValueError("keys must be given, and their labels must differ from each other and from the entity")
    rows = kv if namespace is None else kv.where(F.col("namespace") == namespace)
    columns = [F.max(F.when(F.col(key) == k, F.col((value_columns or {}).get(k, value_column)))).alias(n) for k, n in zip(keys, names)]
    return rows.where(F.col(key).isin(keys)).groupBy(entity).agg(*columns)


def facet_type(kinds: Iterable[str]) -> str:
    """The Spark type of a facet column from the labels seen: booleans, whole numbers, numbers, else text."""
    seen = set(kinds)
    if seen == {"bool"}:
        return "boolean"
    if seen == {"int"}:
        return "bigint"
    return "double" if seen and seen <= {"int", "float"} else "string"


def values_of(kv: DataFrame, entities: DataFrame | None = None, *, entity: str = "run_id", key: str = "key", namespace: str | None = None, prefix: str | None = None, keys: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """Key-value rows of some entities (a column of their ids; None: of all), by namespace, key prefix or list of keys, in key order."""
    out = kv if entities is None else kv.join(entities.select(entity).distinct(), entity, "left_semi")
    out = out if namespace is None else out.where(F.col("namespace") == namespace)
    out = out if prefix is None else out.where(F.col(key).startswith(prefix))
    out = out if keys is None else out.where(F.col(key).isin(list(keys)))
    out = out.orderBy(entity, key, "namespace")
    return out if limit is None else out.limit(limit)


def value_per_run(kv: DataFrame, key: str, namespace: str | None = None) -> DataFrame:
    """(run_id, value): one facet of each run as text, its newest value."""
    rows = kv.where(F.col("key") == key) if namespace is None else kv.where((F.col("key") == key) & (F.col("namespace") == namespace))
    return rows.groupBy("run_id").agg(F.max_by(typed_text(), F.struct("created_at", "facet_id")).alias("value"))


def runs_with_value(runs: DataFrame, kv: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    """Completed runs with a key-value row that meets ``condition``, newest first."""
    from loomspan.operators.recency import by_creation

    out = runs.where("status = 'completed'").join(kv.where(condition).select(F.col("run_id").alias("id")).distinct(), "id", "left_semi").orderBy(*by_creation())
    return out if limit is None else out.limit(limit)


def config_facets(facets: DataFrame, *, facet_id: str | None = None, namespace: str | None = None, schema_name: str | None = None, limit: int | None = 100) -> DataFrame:
    """Stored facet documents by id, namespace and schema, the newest first."""
    for column, value in (("facet_id", facet_id), ("namespace", namespace), ("schema_name", schema_name)):
        if value is not None:
            facets = facets.where(F.col(column) == value)
    out = facets.orderBy(F.col("created_at").desc_nulls_last(), F.col("facet_id"))
    return out if limit is None else out.limit(limit)
