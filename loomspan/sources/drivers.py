"""Readers of artifact files by driver name; drivers of array and HDF5 files need their libraries."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import files
from loomspan.operators.gtfs import typed_member


class Driver(Protocol):
    def __call__(self, spark: SparkSession, path: str, **options: Any) -> DataFrame: ...


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df if nrows is None else df.limit(nrows)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str = ",", header: bool = True, nrows: int | None = None, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", delimiter)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.select(*columns) if columns else df
    return df if nrows is None else df.limit(nrows)


def read_json(spark: SparkSession, path: str, lines: bool = False, orient: str | None = None, schema: str | None = None, nrows: int | None = None) -> DataFrame:
    """JSON lines, or whole documents; orients other than records and lines are read on the driver."""
    if orient in (None, "records"):
        reader = spark.read.option("multiLine", not lines)
        df = (reader.schema(schema) if schema else reader).json(path)
    else:
        import pandas as pd

        df = spark.createDataFrame(pd.read_json(path, orient=orient))
    return df if nrows is None else df.limit(nrows)


JUNK = ("readme", "license", "._")


def _zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(name, head): the files in a zip and their first lines, read by one executor."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [i.filename for i in z.infolist() if not i.is_dir()]
                    yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "head": pa.array([z.open(n).readline(1 << 16).decode("utf-8", "replace") for n in names], pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "name string, head string")


def _folder_members(spark: SparkSession, path: str) -> DataFrame:
    """(name, head): the files of a folder and their first lines."""
    root = files.plain_path(path).rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.regexp_replace("path", files.FILE_SCHEME, "/")
    return found.select(F.substring(at, len(root) + 1, 1 << 20).alias("name"), F.substring_index(F.decode(F.substring("content", 1, 1 << 16), "utf-8"), "\n", 1).alias("head"))


def feed_members(spark: SparkSession, path: str) -> list[str]:
    """The members of a transit feed (folder or zip, on any file system) that are tables: .txt or .csv with a header of several columns."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    if not files.is_folder(spark, path) and not path.lower().endswith(".zip"):
        raise ValueError(f"neither a folder nor a zip file: {path}")
    listed = _folder_members(spark, path) if files.is_folder(spark, path) else _zip_members(spark, path)
    name, base = F.lower("name"), F.substring_index(F.lower("name"), "/", -1)
    junk = F.col("name").contains("__MACOSX") | F.col("name").rlike(r"(^|/)\.") | base.rlike("^(?:" + "|".join(JUNK) + ")")
    table = (name.endswith(".txt") | name.endswith(".csv")) & ~junk & F.col("head").rlike("[,\t]")
    return [r.name for r in listed.where(table).orderBy("name").collect()]


def read_feed_member(spark: SparkSession, path: str, member: str, columns: list[str] | None = None) -> DataFrame:
    """One table of a feed, typed by its columns; empty texts are null. A member of a zip file is unpacked into the shared folder."""
    if files.is_folder(spark, path):
        source = f"{path.rstrip('/')}/{member}"
    else:
        from loomspan.session import shared_dir

        source = f"{shared_dir(spark)}/feeds/{uuid.uuid4().hex}"

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                        while part := f.readlines(1 << 22):
                            yield pa.RecordBatch.from_pydict({"value": pa.array([line.decode("utf-8", "replace").rstrip("\r\n") for line in part], pa.string())})

        spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string").write.text(source)
    df = spark.read.csv(source, header=True, inferSchema=False, enforceSchema=False)
    df = typed_member(df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns)), member.rpartition("/")[2].rpartition(".")[0].lower())
    lost = [c for c in columns or [] if c not in df.columns]
    if lost:
        raise KeyError(f"columns not in {member}: {', '.join(sorted(lost))}")
    return df.select(*columns) if columns else df


#: About so many cells of an array are read by one task at a time.
SLAB_CELLS = 2_000_000


def slabs(spark: SparkSession, parts: list[tuple[str, int, int]], read: Callable[[str, int, int], Any], schema: str) -> DataFrame:
    """The rows that ``read(name, start, stop)`` gives, as pandas frames, for each of ``parts``; every part is a task of its own."""

    def each(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            for name, start, stop in zip(batch["name"], batch["start"], batch["stop"]):
                yield read(name, int(start), int(stop))

    table = spark.createDataFrame(parts, "name string, start long, stop long")
    return table.repartition(max(1, min(len(parts), 10_000)), "name", "start").mapInPandas(each, schema)


def ranges(name: str, rows: int, cells_a_row: int) -> list[tuple[str, int, int]]:
    """Ranges of rows of about SLAB_CELLS cells."""
    step = max(1, SLAB_CELLS // max(1, cells_a_row))
    return [(name, at, min(rows, at + step)) for at in range(0, rows, step)]


def matrix_cells(name: str, slab: Any, start: int):
    """Cells of some rows of a matrix in long form: matrix, row, col, value."""
    import numpy as np
    import pandas as pd

    values = np.asarray(slab, dtype=float).reshape(len(slab), -1)
    i, j = np.indices(values.shape)
    return pd.DataFrame({"matrix": name, "row": (i + start).ravel(), "col": j.ravel(), "value": values.ravel()})


def read_hdf5(spark: SparkSession, path: str, table_path: str, columns: list[str] | None = None, where: str | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows of one HDF5 table, read by the executors in ranges; the driver reads one row for the schema."""
    import pandas as pd

    with pd.HDFStore(path, "r") as store:
        rows = int(store.get_storer(table_path).nrows or len(store[table_path]))
    rows = rows if stop is None else min(rows, stop)
    head = spark.createDataFrame(pd.read_hdf(path, table_path, start=start, stop=min(rows, start + 1), columns=columns))
    parts = [(n, a + start, b + start) for n, a, b in ranges(table_path, max(0, rows - start), len(head.columns))]
    df = slabs(spark, parts, lambda n, a, b: pd.read_hdf(path, n, start=a, stop=b, columns=columns).reset_index(drop=True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema)) if parts else head.limit(0)
    return df.where(where) if where else df


def read_array(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """Cells of a zarr or netCDF store in long form: variable, one column per dimension, value. Slabs of the first dimension are read by the executors."""
    import xarray

    from loomspan.operators.views import union_by_name

    open_store = lambda: xarray.open_zarr(path) if path.rstrip("/").endswith(".zarr") else xarray.open_dataset(path)

    def cells(name: str, start: int, stop: int):
        with open_store() as store:
            a = store[name]
            return (a.isel({a.dims[0]: slice(start, stop)}) if a.dims else a).to_dataframe(name="value").reset_index().assign(variable=name)

    parts = []
    with open_store() as store:
        shapes = {str(n): tuple(map(int, store[n].shape)) for n in variables or list(store.data_vars)}
    for name, shape in shapes.items():
        first = spark.createDataFrame(cells(name, 0, 1).head(1))
        rows, rest = (shape[0], 1) if shape else (1, 1)
        for n in shape[1:]:
            rest *= n
        parts.append(slabs(spark, ranges(name, rows, rest), cells, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema)))
    return union_by_name(parts)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an OpenMatrix file: matrix, row, col, value. Ranges of rows are read by the executors."""
    from loomspan.sources.containers import metadata_rows

    def cells(at: str, start: int, stop: int):
        import h5py

        with h5py.File(path) as f:
            return matrix_cells(at.rpartition("/")[2], f[at][start:stop], start)

    found = [r for r in metadata_rows(spark, [path], "openmatrix").collect() if r.matrix_path.startswith("/data/") and r.n_cols]
    parts = [p for r in found for p in ranges(r.matrix_path, r.n_rows, r.n_cols)]
    return slabs(spark, parts, cells, "matrix string, row long, col long, value double")


DRIVERS: dict[str, Callable] = {"parquet": read_parquet, "csv": read_csv, "json": read_json, "gtfs": read_feed_member, "h5": read_hdf5, "h5_table": read_hdf5, "zarr": read_array, "netcdf": read_array, "openmatrix": read_matrix}
EXTENSIONS: dict[str, str] = {".parquet": "parquet", ".csv": "csv", ".csv.gz": "csv", ".json": "json", ".jsonl": "json", ".h5": "h5", ".hdf5": "h5", ".zarr": "zarr", ".nc": "netcdf", ".omx": "openmatrix", ".zip": "gtfs"}
#: Other names of options.
ALIASES = {"csv": {"sep": "delimiter"}, "parquet": {}, "json": {}}


def register(name: str, driver: Driver, extensions: tuple[str, ...] = ()) -> None:
    DRIVERS[name] = driver
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def driver_for(path: str) -> str:
    """The driver of a path by its last two extensions, or else its last one."""
    suffixes = [s.lower() for s in PurePosixPath(path.rstrip("/")).suffixes]
    for ext in ("".join(suffixes[-2:]), "".join(suffixes[-1:])):
        if ext in EXTENSIONS:
            return EXTENSIONS[ext]
    raise ValueError(f"no driver for {path}")


def load(spark: SparkSession, path: str, driver: str | None = None, **options: Any) -> DataFrame:
    """Read a file by its driver; an option it doesn't know is an error."""
    import inspect

    name = driver or driver_for(path)
    if name not in DRIVERS:
        raise ValueError(f"unknown driver: {name}")
    read = DRIVERS[name]
    options = {ALIASES.get(name, {}).get(k, k): v for k, v in options.items()}
    known = list(inspect.signature(read).parameters)[2:]
    wrong = [k for k in options if k not in known]
    if wrong:
        raise TypeError(f"driver {name} has no option {', '.join(sorted(wrong))}; it has {', '.join(known)}")
    return read(spark, path, **options)


def load_artifact(spark: SparkSession, path: str, driver: str, hot: DataFrame | None = None, artifact_id: str | None = None, fallback: str = "always", **options: Any) -> DataFrame:
    """The file if it is there; else the artifact's ingested rows, if the policy (always, never) lets them stand in."""
    from loomspan.operators.views import exists

    if fallback not in ("always", "never"):
        raise ValueError(f"unknown fallback: {fallback}")
    if exists(spark, path):
        return load(spark, path, driver, **options)
    if hot is not None and fallback == "always":
        return hot.where(F.col("prov_artifact_id") == artifact_id)
    raise FileNotFoundError(path)


def load_pandas(spark: SparkSession, path: str, driver: str | None = None, limit: int | None = None, **options: Any):
    """A file as a pandas frame on the driver; ``limit`` bounds its rows."""
    df = load(spark, path, driver, **options)
    return (df if limit is None else df.limit(limit)).toPandas()


def preview(spark: SparkSession, path: str, driver: str | None = None, limit: int = 5) -> DataFrame:
    """The first rows of a file."""
    return load(spark, path, driver).limit(limit)


def file_batches(spark: SparkSession, path: str, driver: str | None = None, rows: int = 50_000, max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A file in batches of at most ``rows`` rows, one partition at a time on the driver; ``max_rows`` ends it."""
    df = load(spark, path, driver)
    df = df if max_rows is None else df.limit(max_rows)
    schema, batch = pa.schema([]), []
    for r in df.toLocalIterator(prefetchPartitions=True):
        batch.append(r.asDict(recursive=True))
        if len(batch) == rows:
            table = pa.Table.from_pylist(batch)
            schema, batch = table.schema, []
            yield from table.combine_chunks().to_batches()
    if batch:
        yield from pa.Table.from_pylist(batch, schema=schema if len(schema) else None).combine_chunks().to_batches()
