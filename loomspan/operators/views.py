"""Hybrid and grouped views: ingested rows and raw files of many runs united by column name, under one widened schema."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.files import FILE_SCHEME, exists, is_folder, names, plain_path
from loomspan.operators.facets import facet_type
from loomspan.operators.skew import union_all

log = logging.getLogger(__name__)

# The columns that tell where a row came from, and their types.
SYSTEM = {"prov_run_id": "string", "prov_artifact_id": "string", "prov_year": "int", "prov_iteration": "int", "prov_scenario_id": "string"}
TABULAR = ("parquet", "csv")
#: Up to so many files a view is a union of single scans with literals, so that a filter on the run prunes files;
#: beyond it, one scan per schema joined with the files' metadata. The rows are the same.
MAX_LITERAL_FILES = 32

_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both: null < boolean < whole numbers < decimal < float; date < timestamp; else string.

    Structs widen field by field, arrays by element, maps by key and value.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs = {f.name: f.dataType for f in b}
        own = [T.StructField(f.name, wider(f.dataType, theirs.get(f.name, T.NullType()))) for f in a]
        return T.StructType(own + [f for f in b if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider(a.keyType, b.keyType), wider(a.valueType, b.valueType))
    a, b = (T.IntegerType() if isinstance(x, T.BooleanType) else x for x in (a, b))
    ints = [_NUMBERS.index(type(x)) if type(x) in _NUMBERS else None for x in (a, b)]
    if None not in ints:
        return _NUMBERS[max(ints)]()
    if all(isinstance(x, T.NumericType) for x in (a, b)):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        return T.DoubleType()
    times = [isinstance(x, (T.DateType, T.TimestampNTZType, T.TimestampType)) for x in (a, b)]
    if all(times):
        return T.TimestampType() if any(isinstance(x, T.TimestampType) for x in (a, b)) else T.TimestampNTZType()
    return T.StringType()


def as_type(value: Column, was: T.DataType, to: T.DataType) -> Column:
    if was == to:
        return value
    if isinstance(was, T.BooleanType) and isinstance(to, T.NumericType):
        return value.cast("int").cast(to)
    if isinstance(to, T.StringType) and isinstance(was, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(was, T.StructType) and isinstance(to, T.StructType):
        parts = [(as_type(value[f.name], was[f.name].dataType, f.dataType) if f.name in was.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value.cast(to)


def widened_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """One field per name over all schemas, in order of appearance, in the widest of its types."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            kinds[f.name] = wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return T.StructType([T.StructField(n, T.StringType() if isinstance(k, T.NullType) else k) for n, k in kinds.items()])


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null."""
    own = {f.name: f.dataType for f in df.schema}
    return df.select(*((as_type(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name, missing ones null, types widened before the union."""
    schema = widened_schema(f.schema for f in frames)
    return union_all([cast_to(f, schema) for f in frames])


def typed_empty(spark: SparkSession, columns: Mapping[str, str] | None = None, facets: Mapping[str, Iterable[str]] | None = None, system: bool = True) -> DataFrame:
    """A view without rows: the known columns, facet columns in their types, system columns."""
    ddl = dict(columns or {}) | {f: facet_type(k) for f, k in (facets or {}).items()} | (SYSTEM if system else {})
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in ddl.items()) if ddl else "dummy string")


@dataclass(frozen=True)
class Source:
    """A raw file of a view with its run; facets are columns of constant value."""

    path: str
    driver: str
    run_id: str | None = None
    artifact_id: str | None = None
    year: int | None = None
    iteration: int | None = None
    scenario_id: str | None = None
    facets: Mapping[str, Any] = field(default_factory=dict)

    def system(self) -> dict[str, Any]:
        return dict(zip(SYSTEM, (self.run_id, self.artifact_id, self.year, self.iteration, self.scenario_id)))


def present(spark: SparkSession, sources: Sequence[Source], missing: str = "warn") -> list[Source]:
    """The tabular sources whose files are there; ``missing`` is warn, error or skip_silent."""
    if missing not in ("warn", "error", "skip_silent"):
        raise ValueError(f"unknown policy for missing files: {missing}")
    out, listed = [], {}

    def there(path: str) -> bool:
        """Whether a file is there; each folder is listed once, however many files of a view it holds."""
        folder, name = path.rstrip("/").rpartition("/")[::2]
        if folder not in listed:
            listed[folder] = set(names(spark, folder)) if folder else None
        return name in listed[folder] if listed[folder] is not None else exists(spark, path)

    for s in sources:
        if s.driver not in TABULAR:
            continue
        if there(s.path):
            out.append(s)
        elif missing == "error":
            raise FileNotFoundError(s.path)
        elif missing == "warn":
            log.warning("file of a view is missing: %s", s.path)
    return out


def normalized_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with every other sign as an underscore; clashes get a number."""
    taken: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = "".join(x if x.isalnum() and x.isascii() else "_" for x in c.strip().lower()) or "column"
        n = f"_{n}" if n[0].isdigit() else n
        taken[n] = taken.get(n, 0) + 1
        names.append(n if taken[n] == 1 else f"{n}_{taken[n] - 1}")
    return df.toDF(*names)


def read_source(spark: SparkSession, s: Source, schema: T.StructType | None = None) -> DataFrame:
    if s.driver == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(s.path)
    return normalized_names(spark.read.csv(s.path, header=True, inferSchema=True))


def footer_schemas(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The schema text in the footer of each Parquet file, read in parallel by the executors."""
    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs
        import pyarrow.parquet

        for batch in batches:
            texts = []
            for p in batch["path"]:
                fs, at = (pyarrow.fs.FileSystem.from_uri(p) if ":" in p else (pyarrow.fs.LocalFileSystem(), p))
                texts.append(pyarrow.parquet.read_schema(at, filesystem=fs).remove_metadata().to_string(show_field_metadata=False))
            yield pd.DataFrame({"path": batch["path"], "schema": texts})

    known = spark.createDataFrame([(plain_path(p),) for p in paths], "path string").repartition(max(1, min(len(paths) // 16, 1000)))
    return {r.path: r.schema for r in known.mapInPandas(read, "path string, schema string").collect()}


def _one_scan(spark: SparkSession, group: Sequence[Source], extra: Mapping[str, str], values: Callable[[Source], dict]) -> DataFrame:
    """One scan of files of one schema, whose rows meet a table of their metadata by file path."""
    ddl = ", ".join(["_path string", *(f"`{c}` {t}" for c, t in extra.items())])
    known = spark.createDataFrame([[plain_path(s.path), *(values(s).get(c) for c in extra)] for s in group], ddl)
    scan = spark.read.parquet(*(s.path for s in group))
    found = scan.drop(*extra).withColumn("_path", F.regexp_replace(scan["_metadata.file_path"], FILE_SCHEME, "/"))
    return found.join(F.broadcast(known), "_path").drop("_path")


def cold_rows(spark: SparkSession, sources: Sequence[Source], facets: Mapping[str, Iterable[str]] | None = None, system: bool = True) -> DataFrame | None:
    """The rows of raw files with system and facet columns; None without sources.

    Few files become one scan each, with literals. Many single Parquet files become one scan for all files of one schema.
    Either way all parts are united by name, with widened types.
    """
    kinds = {f: facet_type(k) for f, k in (facets or {}).items()}
    extra = (SYSTEM if system else {}) | kinds
    values = lambda s: (s.system() if system else {}) | {f: s.facets.get(f) for f in kinds}
    parts, single = [], list(sources)
    if len(sources) > MAX_LITERAL_FILES:
        files = [s for s in sources if s.driver == "parquet" and not is_folder(spark, s.path)]
        schemas = footer_schemas(spark, [s.path for s in files]) if files else {}
        groups: dict[str, list[Source]] = {}
        for s in files:
            groups.setdefault(schemas[plain_path(s.path)], []).append(s)
        parts += [_one_scan(spark, group, extra, values) for group in groups.values()]
        single = [s for s in sources if s not in files]
    for s in single:
        df = read_source(spark, s)
        parts.append(df.drop(*extra).select("*", *(F.lit(v).cast(extra[c]).alias(c) for c, v in values(s).items())))
    return union_by_name(parts) if parts else None


def hot_rows(table: DataFrame, members: DataFrame | None, runs: DataFrame | None = None, facets: Sequence[str] = ()) -> DataFrame:
    """The rows of an ingested table. With ``members`` (artifact_id, run_id, year, iteration, scenario_id, facets) only rows
    of these artifacts are kept, and empty system columns are taken from there; else the scenario comes from ``runs``."""
    if members is None:
        parents = runs.select(F.col("id").alias("_run"), F.col("parent_run_id").alias("prov_scenario_id"))
        return table.drop("prov_scenario_id").join(parents, F.col("prov_run_id") == F.col("_run"), "left").drop("_run")
    few = members.select(F.col("artifact_id").alias("_a"), *(F.col(c).alias(f"_m_{c}") for c in ("run_id", "year", "iteration", "scenario_id")), *facets)
    joined = table.drop("prov_scenario_id", *facets).join(few, F.col("prov_artifact_id") == F.col("_a"))
    filled = {f"prov_{c}": F.coalesce(f"prov_{c}", f"_m_{c}") for c in ("run_id", "year", "iteration")}
    return joined.withColumns(filled | {"prov_scenario_id": F.col("_m_scenario_id")}).drop("_a", *(f"_m_{c}" for c in ("run_id", "year", "iteration", "scenario_id")))


def hybrid(spark: SparkSession, hot: DataFrame | None, sources: Sequence[Source], *, mode: str = "hybrid", missing: str = "warn", facets: Mapping[str, Iterable[str]] | None = None, columns: Mapping[str, str] | None = None, system: bool = True) -> DataFrame:
    """Ingested rows and raw files united by name; ``mode`` is hybrid, hot_only or cold_only. Without any rows a typed empty view.

    The caller leaves ingested artifacts out of ``sources``, so nothing is counted twice.
    """
    if mode not in ("hybrid", "hot_only", "cold_only"):
        raise ValueError(f"unknown mode: {mode}")
    cold = cold_rows(spark, present(spark, sources, missing), facets, system) if mode != "hot_only" else None
    parts = [p for p in (hot if mode != "cold_only" else None, cold) if p is not None]
    if not parts:
        return typed_empty(spark, columns, facets, system)
    out = union_by_name(parts)
    return out if system else out.drop(*SYSTEM)


def register(df: DataFrame, name: str, if_exists: str = "replace") -> DataFrame:
    """Make ``df`` a temporary view; ``if_exists`` is replace or error."""
    if if_exists not in ("replace", "error"):
        raise ValueError(f"unknown policy for existing views: {if_exists}")
    if if_exists == "error" and df.sparkSession.catalog.tableExists(name):
        raise ValueError(f"view exists: {name}")
    df.createOrReplaceTempView(name)
    return df
