"""Schema profiles: read from data, hashed, compared, chosen among observations, and written as code."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.hashing import canonical_json, sha256
from loomspan.operators.recency import first_of_group

# The sources of schema observations, the most trusted first.
PRIORITY = ["user_provided", "file", "duckdb"]

# Spark types by the names of other engines and libraries.
TYPE_NAMES = {
    "tinyint": "tinyint", "int8": "tinyint", "smallint": "smallint", "int16": "smallint", "utinyint": "smallint", "uint8": "smallint", "integer": "int", "int": "int", "int32": "int", "usmallint": "int", "uint16": "int",
    "bigint": "bigint", "int64": "bigint", "long": "bigint", "uinteger": "bigint", "uint32": "bigint", "ubigint": "decimal(20,0)", "uint64": "decimal(20,0)", "hugeint": "decimal(38,0)",
    "real": "float", "float4": "float", "float32": "float", "float": "float", "double": "double", "float8": "double", "float64": "double", "boolean": "boolean", "bool": "boolean",
    "varchar": "string", "text": "string", "string": "string", "char": "string", "object": "string", "category": "string", "str": "string", "uuid": "string", "json": "string",
    "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz", "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "blob": "binary", "bytea": "binary", "decimal": "decimal(18,2)", "numeric": "decimal(18,2)",
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a type name; an unknown one is a string."""
    text = name.strip().lower()
    m = re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
    if m:
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if text.endswith("[]"):
        return T.ArrayType(parse_type(text[:-2]))
    return T.StructType.fromDDL(f"c {TYPE_NAMES.get(text, 'string')}")[0].dataType


def profile(df: DataFrame) -> tuple[str, list[dict]]:
    """The id and the fields (ordinal_position, name, logical_type, nullable) of a frame."""
    fields = [{"ordinal_position": i, "name": f.name, "logical_type": f.dataType.simpleString(), "nullable": f.nullable} for i, f in enumerate(df.schema, 1)]
    return sha256(canonical_json({"fields": fields})), fields


def profile_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    schema_id, fields = profile(df)
    rows = [(schema_id, f["ordinal_position"], f["name"], f["logical_type"], f["nullable"]) for f in fields]
    return spark.createDataFrame(rows, "schema_id string, ordinal_position int, name string, logical_type string, nullable boolean")


def field_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(name, n, n_null, approx_unique, min, max): statistics of columns from one scan."""
    columns = list(columns)
    aggs = [a for c in columns for a in (F.count(c).alias(f"{c}__n"), F.approx_count_distinct(c).alias(f"{c}__u"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi"))]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col("n"), (F.col("n") - F.col(f"{c}__n")).alias("n_null"), F.col(f"{c}__u").alias("approx_unique"), F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max")) for c in columns))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def compatible(fields: DataFrame, schema_id: str, name: str = "name") -> DataFrame:
    """(schema_id, relation) of the schemas whose field names hold or are held by those of ``schema_id``: equal, subset or superset."""
    sets = fields.groupBy("schema_id").agg(F.collect_set(name).alias("names"))
    one = sets.where(F.col("schema_id") == schema_id).select(F.col("names").alias("own")).limit(1)
    pairs = sets.join(F.broadcast(one), F.lit(True))
    more, less = F.size(F.array_except("names", "own")) == 0, F.size(F.array_except("own", "names")) == 0
    return pairs.select("schema_id", F.when(more & less, "equal").when(more, "subset").when(less, "superset").alias("relation")).where("relation IS NOT NULL")


def source_rank(preferred: str | None = None, column: str = "source") -> Column:
    order = list(dict.fromkeys([PRIORITY[0], *([preferred] if preferred else []), *PRIORITY[1:]]))
    rank = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == s, i).otherwise(rank)
    return rank


def chosen_observations(observations: DataFrame, preferred: str | None = None, strict: bool = False) -> DataFrame:
    """The observation that tells each artifact's schema: by source, then the latest; ``strict`` takes the preferred source only."""
    pool = observations.where(F.col("source") == preferred) if strict else observations
    return first_of_group(pool, ["artifact_id"], [source_rank(preferred).asc(), F.col("observed_at").desc_nulls_last(), F.col("id").desc()])


def fill_ordinals(fields: DataFrame) -> DataFrame:
    """Fields whose schema has no ordinals get them by name."""
    from pyspark.sql.window import Window

    by_name = F.row_number().over(Window.partitionBy("schema_id").orderBy("name"))
    whole = F.count("ordinal_position").over(Window.partitionBy("schema_id"))
    return fields.withColumn("ordinal_position", F.when(whole == 0, by_name).otherwise(F.col("ordinal_position")))


def can_merge(source: T.DataType, target: T.DataType) -> bool:
    """Whether values of ``source`` fit ``target`` without loss."""
    from loomspan.operators.views import wider

    return wider(source, target) == target


def contract_issues(df: DataFrame, contract: T.StructType, additive: bool = False) -> list[str]:
    """What keeps rows of ``df`` out of a table under ``contract``: extra columns unless additive, types that don't fit."""
    own = {f.name: f.dataType for f in contract}
    extra = [f.name for f in df.schema if f.name not in own]
    issues = [] if additive or not extra else [f"columns outside the contract: {', '.join(extra)}"]
    return issues + [f"column {f.name}: {f.dataType.simpleString()} does not fit {own[f.name].simpleString()}" for f in df.schema if f.name in own and not can_merge(f.dataType, own[f.name])]


def identifier(name: str) -> str:
    """A Python identifier for a column name."""
    out = re.sub(r"\W", "_", name.strip()) or "field"
    out = f"_{out}" if out[0].isdigit() else out
    return f"{out}_" if keyword.iskeyword(out) else out


def render_class(name: str, schema: T.StructType, comments: dict[str, str] | None = None) -> str:
    """Python source of a typed record of a schema; columns whose names are no identifiers keep them as comments."""
    known = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "date": "datetime.date", "timestamp": "datetime.datetime", "timestamp_ntz": "datetime.datetime", "binary": "bytes"}
    lines = ["import datetime", "from dataclasses import dataclass", "from typing import Any", "", "", "@dataclass", f"class {identifier(name)}:"]
    for f in schema:
        kind = "decimal.Decimal" if isinstance(f.dataType, T.DecimalType) else known.get(f.dataType.simpleString(), "Any")
        note = "; ".join(x for x in (f"column {f.name!r}" if identifier(f.name) != f.name else "", (comments or {}).get(f.name, "")) if x)
        lines.append(f"    {identifier(f.name)}: {kind}{' | None = None' if f.nullable else ''}" + (f"  # {note}" if note else ""))
    if not len(schema):
        lines.append("    pass")
    if any("decimal." in x for x in lines):
        lines.insert(1, "import decimal")
    return "\n".join(lines) + "\n"


def schema_links(relations: DataFrame, schemas: DataFrame) -> DataFrame:
    """(schema_id, from_table, from_field, to_table, to_field): the foreign keys of stored schemas under the name of their table."""
    named = schemas.select(F.col("id").alias("schema_id"), F.get_json_object("profile", "$.table_name").alias("from_table"))
    return relations.join(named, "schema_id").select("schema_id", "from_table", F.col("field_name").alias("from_field"), F.col("target_table").alias("to_table"), F.col("target_field").alias("to_field"))


def observations_by(observations: DataFrame, artifacts: DataFrame, column: str, preferred: str | None = None) -> DataFrame:
    """The observation that tells the schema of each content: of all artifacts with one ``column`` (hash or content_id), chosen by source and time."""
    known = observations.join(artifacts.where(F.col(column).isNotNull()).select(F.col("id").alias("artifact_id"), F.col(column).alias("_content")), "artifact_id")
    one = chosen_observations(known.withColumn("_artifact", F.col("artifact_id")).withColumn("artifact_id", F.col("_content")), preferred)
    return one.withColumn(column, F.col("artifact_id")).withColumn("artifact_id", F.col("_artifact")).drop("_content", "_artifact")


def schemas_like(fields: DataFrame, names: Iterable[str], compatible: bool = True, name: str = "name") -> DataFrame:
    """(schema_id): the stored schemas whose field names are those of a model, or with ``compatible`` hold or are held by them."""
    own = F.array(*(F.lit(n) for n in sorted(set(names))))
    sets = fields.groupBy("schema_id").agg(F.collect_set(name).alias("names"))
    more, less = F.size(F.array_except("names", own)) == 0, F.size(F.array_except(own, "names")) == 0
    return sets.where((more | less) if compatible else (more & less)).select("schema_id")


def declared_profile(table: str, fields: Iterable[dict], relations: Iterable[dict] = ()) -> tuple[str, dict[str, list[dict]]]:
    """The id and the catalog rows of a schema that a user declares: its fields and their foreign keys (field_name, target_table, target_field)."""
    listed = [{"ordinal_position": i, "nullable": True, **f} for i, f in enumerate(fields, 1)]
    schema_id = sha256(canonical_json({"table_name": table, "fields": listed}))
    return schema_id, {
        "artifact_schema": [{"id": schema_id, "profile": canonical_json({"table_name": table}), "n_fields": len(listed)}],
        "artifact_schema_field": [{"schema_id": schema_id, **f} for f in listed],
        "artifact_schema_relation": [{"schema_id": schema_id, **r} for r in relations],
    }


def observe(catalog, artifact, df: DataFrame | None = None, source: str = "file", reuse: bool = True) -> str:
    """Store the schema profile of an artifact and the observation; the id. A file whose content was observed before takes that schema unread."""
    import uuid
    from datetime import datetime, timezone

    at = datetime.now(timezone.utc).replace(tzinfo=None)
    seen = {"id": str(uuid.uuid4()), "artifact_id": artifact["id"], "run_id": artifact.get("run_id"), "source": source, "observed_at": at}
    if reuse and artifact.get("hash"):
        known = observations_by(catalog.read("artifact_schema_observation"), catalog.read("artifact").where(F.col("hash") == artifact["hash"]), "hash", source).head()
        if known:
            catalog.append("artifact_schema_observation", [seen | {"schema_id": known.schema_id}])
            return known.schema_id
    if df is None:
        from loomspan.sources.drivers import load

        df = load(catalog.spark, artifact["container_uri"], artifact["driver"])
    schema_id, fields = profile(df)
    if catalog.read("artifact_schema").where(F.col("id") == schema_id).isEmpty():
        catalog.append("artifact_schema", [{"id": schema_id, "profile": canonical_json({"table_name": artifact["key"]}), "n_fields": len(fields), "created_at": at}])
        catalog.append("artifact_schema_field", [{"schema_id": schema_id, **f} for f in fields])
    catalog.append("artifact_schema_observation", [seen | {"schema_id": schema_id}])
    return schema_id
