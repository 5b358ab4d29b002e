"""What is inside container files: variables of array stores, matrices, spatial layers, and the tables of HDF5 files.

Files are opened by the executors, one file per row of a table of paths; only metadata rows come out, never cells. The
functions that read an open store work on whatever its library gives, so that they are tested without it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = "path string, variable_name string, variable_type string, dims array<string>, shape array<bigint>, dtype string, attributes string"
MATRICES = "path string, matrix_name string, matrix_path string, shape array<bigint>, dtype string, n_rows bigint, n_cols bigint, attributes string"
LAYERS = "path string, bounds array<double>, crs string, feature_count bigint, geometry_types array<string>, geometry_column string, column_names array<string>"
H5_TABLES = "path string, table_path string, shape array<bigint>, dtype string, table_hash string"


def _attributes(attrs: Any) -> str:
    return json.dumps(dict(attrs), default=str, sort_keys=True) if attrs else "{}"


def variable_rows(store: Any) -> Iterator[dict]:
    """A row per data variable and coordinate of an array store (``data_vars`` and ``coords``)."""
    for kind, members in (("data", store.data_vars), ("coordinate", store.coords)):
        for name, a in members.items():
            yield {"variable_name": str(name), "variable_type": kind, "dims": [str(d) for d in a.dims], "shape": [int(n) for n in a.shape], "dtype": str(a.dtype), "attributes": _attributes(a.attrs)}


def matrix_rows(group: Any, prefix: str = "") -> Iterator[dict]:
    """A row per matrix below a group, at any depth; what has items is a group."""
    for name, item in group.items():
        at = f"{prefix}/{name}"
        if hasattr(item, "items"):
            yield from matrix_rows(item, at)
        else:
            shape = [int(n) for n in item.shape]
            yield {"matrix_name": name, "matrix_path": at, "shape": shape, "dtype": str(item.dtype), "n_rows": shape[0] if shape else None, "n_cols": shape[1] if len(shape) > 1 else None, "attributes": _attributes(item.attrs)}


def layer_row(frame: Any) -> dict:
    """The row of a spatial layer given as a geo data frame."""
    kinds = [str(k) for k in frame.geometry.geom_type.dropna().unique()]
    return {"bounds": [float(b) for b in frame.total_bounds], "crs": None if frame.crs is None else str(frame.crs), "feature_count": len(frame), "geometry_types": kinds, "geometry_column": frame.geometry.name, "column_names": [str(c) for c in frame.columns]}


def dataset_hash(dataset: Any, chunk_rows: int | None = None) -> str:
    """Hash of the type, shape and cells of a dataset, read ``chunk_rows`` rows at a time; the chunks play no part in it."""
    digest = hashlib.sha256(f"{dataset.dtype}|{tuple(int(n) for n in dataset.shape)}|".encode())
    if not len(dataset.shape):
        digest.update(bytes(memoryview(dataset[()]).cast("B")) if hasattr(dataset[()], "__array__") else repr(dataset[()]).encode())
        return digest.hexdigest()
    step = chunk_rows or max(1, int(dataset.shape[0]))
    for at in range(0, int(dataset.shape[0]), step):
        digest.update(dataset[at : at + step].tobytes())
    return digest.hexdigest()


def h5_tables(group: Any, keep: Callable[[str], bool] | None = None, hash_tables: bool = True, chunk_rows: int | None = None, prefix: str = "") -> Iterator[dict]:
    """A row per dataset below a group that ``keep`` chooses by its path."""
    for name, item in group.items():
        at = f"{prefix}/{name}" if prefix else name
        if hasattr(item, "items"):
            yield from h5_tables(item, keep, hash_tables, chunk_rows, at)
        elif keep is None or keep(at):
            yield {"table_path": at, "shape": [int(n) for n in item.shape], "dtype": str(item.dtype), "table_hash": dataset_hash(item, chunk_rows) if hash_tables else None}


def _open_matrix(path: str) -> Iterator[dict]:
    import h5py

    with h5py.File(path) as f:
        yield from matrix_rows(f)


def _open_array(path: str, zarr: bool) -> Iterator[dict]:
    import xarray

    with xarray.open_zarr(path, consolidated=False) if zarr else xarray.open_dataset(path) as store:
        yield from variable_rows(store)


def _open_layer(path: str, driver: str) -> Iterator[dict]:
    import geopandas

    yield layer_row(geopandas.read_parquet(path) if driver == "geoparquet" else geopandas.read_file(path))


READERS: dict[str, tuple[str, Callable[[str], Iterator[dict]]]] = {
    "zarr": (VARIABLES, lambda p: _open_array(p, True)),
    "netcdf": (VARIABLES, lambda p: _open_array(p, False)),
    "openmatrix": (MATRICES, _open_matrix),
    "geoparquet": (LAYERS, lambda p: _open_layer(p, "geoparquet")),
    "shapefile": (LAYERS, lambda p: _open_layer(p, "shapefile")),
    "geopackage": (LAYERS, lambda p: _open_layer(p, "geopackage")),
}


def rows_of_files(paths: DataFrame, read: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that ``read`` gives for each of ``paths`` (path), read by the executors; a file that can't be read is an error that names it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                try:
                    rows = [{"path": path, **r} for r in read(path)]
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                yield pd.DataFrame(rows, columns=names)

    return paths.select("path").mapInPandas(each, schema)


def metadata_rows(spark: SparkSession, paths: Iterable[str], driver: str) -> DataFrame:
    """Metadata of array, matrix or spatial files by driver; GeoJSON needs no library."""
    paths = list(paths)
    if driver == "geojson":
        return geojson_layers(spark, paths)
    schema, read = READERS[driver]
    return rows_of_files(spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000))), read, schema)


def geojson_layers(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The layer rows of GeoJSON files: bounds over all positions, named reference system (longitude and latitude if none), features and geometry types."""
    schema = "features array<struct<geometry struct<type string, coordinates string, geometries string>, properties map<string,string>>>, crs struct<properties struct<name string>>"
    docs = spark.read.schema(schema).json(list(paths), multiLine=True).select(F.col("_metadata.file_path").alias("path"), "*")
    feature = docs.select("path", F.coalesce("crs.properties.name", F.lit("OGC:CRS84")).alias("crs"), F.explode_outer("features").alias("f"))
    text = F.concat_ws(" ", "f.geometry.coordinates", "f.geometry.geometries")
    number = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    x, y = (F.transform(F.regexp_extract_all(text, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(i)), lambda v: v.cast("double")) for i in (1, 2))
    read = feature.select("path", "crs", F.col("f").isNotNull().cast("int").alias("n"), "f.geometry.type", F.map_keys("f.properties").alias("names"), F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    bounds = F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bounds")
    names = F.array_sort(F.array_union(F.array_distinct(F.flatten(F.collect_set("names"))), F.array(F.lit("geometry"))))
    return read.groupBy("path").agg(bounds, F.first("crs").alias("crs"), F.sum("n").alias("feature_count"), F.array_sort(F.collect_set("type")).alias("geometry_types"), F.lit("geometry").alias("geometry_column"), names.alias("column_names"))


@dataclass(frozen=True)
class Child:
    """What is known beforehand of a table in a container."""

    key: str | None = None
    description: str | None = None
    meta: Mapping[str, Any] = field(default_factory=dict)


def child_artifacts(container: Mapping[str, Any], tables: Iterable[Mapping[str, Any]], children: Mapping[str, Child] | None = None) -> list[dict]:
    """The artifact rows of the tables of a container: they inherit its run, point to it, and have keys made of its key and their path."""
    out = []
    for t in tables:
        known = (children or {}).get(t["table_path"], Child())
        meta = {"parent_id": container["id"], "shape": t["shape"], "dtype": t["dtype"], **({"description": known.description} if known.description else {}), **known.meta}
        if t.get("table_hash"):
            meta |= {"table_hash": t["table_hash"], "table_hash_algo": "sha256"}
        key = known.key or f"{container['key']}_{t['table_path'].replace('/', '_')}"
        out.append({"id": str(uuid.uuid4()), "key": key, "container_uri": container["container_uri"], "table_path": t["table_path"], "driver": "h5_table", "hash": t.get("table_hash"), "parent_artifact_id": container["id"], "run_id": container.get("run_id"), "meta": json.dumps(meta, default=str), "created_at": container.get("created_at")})
    return out


def scan_h5(spark: SparkSession, paths: Iterable[str], keep: Callable[[str], bool] | None = None, hash_tables: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """(path, table_path, shape, dtype, table_hash): the tables of HDF5 files, read by the executors."""

    def read(path: str) -> Iterator[dict]:
        import h5py

        with h5py.File(path) as f:
            yield from h5_tables(f, keep, hash_tables, chunk_rows)

    paths = list(paths)
    return rows_of_files(spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000))), read, H5_TABLES)
