"""Schemas that drift between the files of one dataset: changes from file to file, and one unified table.

Header schemas are read in parallel as one row per schema. Files are put in order within their dataset by even ranges,
so that a dataset with a large share of all files is not held by one task. Each pair of neighbouring schemas is compared
once, with array functions. A field that was renamed, once or often, stays one column, under its last name. The fold of
all schemas of a dataset through the type lattice gives its union schema, to which the records of all files are cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.ids import strip
from loomspan.functions.types import SPARK_TYPES, named_type, promoted
from loomspan.operators.hierarchy import ancestor_paths
from loomspan.session import shuffle_partitions, stage

CHANGES = "array<struct<change string, field_name string, old_name string>>"


def header_schemas(fields: DataFrame) -> DataFrame:
    """(schema_id, fields): the fields of each schema as an array of (name, kind, ordinal) sorted by name.

    Names are trimmed and in lower case; of several fields of one name the least ordinal counts, then the least type.
    """
    named = fields.select("schema_id", F.lower(strip("name")).alias("name"), named_type("logical_type").alias("kind"), F.col("ordinal_position").alias("ordinal")).where("schema_id IS NOT NULL AND name IS NOT NULL")
    one = named.groupBy("schema_id", "name").agg(F.min(F.struct(F.col("ordinal").isNull(), "ordinal", "kind")).alias("f"))
    return one.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("f.kind").alias("kind"), F.col("f.ordinal").alias("ordinal")))).alias("fields"))


def before_in_order(files: DataFrame, dataset: str, at: str, tie: str, value: str) -> DataFrame:
    """``files`` with ``previous``: ``value`` of the file before, in the order of (at, tie) within the dataset; null for the first.

    Files are split into even ranges of (dataset, at, tie), so that a dataset with many files, even of one time, fills
    many tasks. The window runs within (dataset, range); the first file of a range takes the last file of the dataset's
    range before, from a table with one row per dataset and range. The ranges are written, as they come from a sample.
    """
    parts = shuffle_partitions(files.sparkSession)
    ranged = stage(files.repartitionByRange(parts, dataset, at, tie).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(dataset, "_range").orderBy(at, tie)
    ends = ranged.groupBy(dataset, "_range").agg(F.max_by(value, F.struct(at, tie)).alias("_last"))
    carried = ends.select(dataset, "_range", F.lag("_last").over(Window.partitionBy(dataset).orderBy("_range")).alias("_carried"))
    own = ranged.withColumn("_own", F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    joined = own.join(carried, [dataset, "_range"], "left")
    return joined.withColumn("previous", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own"))).drop("_range", "_own", "_first", "_carried")


def _names(fields: Column) -> Column:
    return F.transform(fields, lambda f: f["name"])


def _alike(fields: Column, f: Column) -> Column:
    return F.filter(fields, lambda g: g["ordinal"].isNotNull() & (g["ordinal"] == f["ordinal"]) & (g["kind"] == f["kind"]))


def _rank(fields: Column, f: Column) -> Column:
    return F.size(F.filter(_alike(fields, f), lambda g: g["name"] < f["name"]))


def schema_changes(old: Column, new: Column) -> Column:
    """The changes from one array of fields to the next, as an array of (change, field_name, old_name).

    A gone and a new field of one type and position are a renaming; of several such, the n-th by name go together.
    """
    gone = F.filter(old, lambda f: ~F.array_contains(_names(new), f["name"]))
    fresh = F.filter(new, lambda f: ~F.array_contains(_names(old), f["name"]))
    row = lambda change, name, was: F.struct(F.lit(change).alias("change"), name.alias("field_name"), was.alias("old_name"))
    none = F.lit("")

    def appeared(f: Column) -> Column:
        source = F.try_element_at(_alike(gone, f), _rank(fresh, f) + 1)
        return F.when(source.isNotNull(), row("renamed", f["name"], source["name"])).otherwise(row("added", f["name"], none))

    removed = F.filter(gone, lambda g: _rank(gone, g) >= F.size(_alike(fresh, g)))
    retyped = F.filter(new, lambda f: F.exists(old, lambda g: (g["name"] == f["name"]) & (g["kind"] != f["kind"])))
    return F.concat(F.transform(fresh, appeared), F.transform(removed, lambda g: row("removed", g["name"], none)), F.transform(retyped, lambda f: row("retyped", f["name"], none)))


def drift_log(files: DataFrame, schemas: DataFrame, dataset: str, file: str, at: str) -> DataFrame:
    """(dataset, file, change, field_name, old_name) for ``files`` (dataset, file, at, schema_id) and :func:`header_schemas`.

    Files without a dataset are left out; a schema without fields is empty. The first file of a dataset has no changes.
    """
    ordered = before_in_order(files.where(F.col(dataset).isNotNull()).select(dataset, file, at, "schema_id"), dataset, at, file, "schema_id").where("previous IS NOT NULL AND previous <> schema_id")
    empty = F.array().cast("array<struct<name string, kind string, ordinal int>>")
    new = schemas.select("schema_id", F.col("fields").alias("_new"))
    old = schemas.select(F.col("schema_id").alias("previous"), F.col("fields").alias("_old"))
    both = ordered.join(new, "schema_id", "left").join(old, "previous", "left").select(dataset, file, F.coalesce("_old", empty).alias("_old"), F.coalesce("_new", empty).alias("_new"))
    return both.select(dataset, file, F.explode(schema_changes(F.col("_old"), F.col("_new"))).alias("_c")).select(dataset, file, "_c.*")


def column_names(files: DataFrame, schemas: DataFrame, log: DataFrame, dataset: str, file: str, at: str) -> DataFrame:
    """(dataset, file, field_name, column): the fields of a file that go into a column of another name, as they are renamed later.

    A field lives from the file that brings it (first, added or renamed) to the one that drops it. Each life that began by
    a renaming points to the life of the old name at that time; the chains of these links, solved as a forest, are the
    columns. A column has the name of its last life, with ``#n`` for the n-th if the same name was the last of several
    that overlap in time.
    """
    placed = files.where(F.col(dataset).isNotNull()).select(dataset, file, F.struct(F.col(at).alias("at"), F.col(file).alias("file")).alias("ord"), "schema_id")
    renamed = log.where("change = 'renamed'").select(dataset, file, F.col("field_name").alias("name"), "old_name")
    touched = renamed.select(dataset, "name").unionByName(renamed.select(dataset, F.col("old_name").alias("name"))).distinct()
    # Only the names that take part in a renaming have to be followed.
    first = placed.groupBy(dataset).agg(F.min_by("schema_id", "ord").alias("schema_id"), F.min("ord").alias("ord"))
    there = first.join(schemas, "schema_id").select(dataset, F.explode("fields").alias("f"), "ord").select(dataset, F.col("f.name").alias("name"), "ord", F.lit(None).cast("string").alias("old_name"))
    begun = log.where("change IN ('added', 'renamed')").join(placed.select(dataset, file, "ord"), [dataset, file]).select(dataset, F.col("field_name").alias("name"), "ord", F.when(F.col("change") == "renamed", F.col("old_name")).alias("old_name"))
    life = F.to_json(F.struct(dataset, "name", "ord"))
    lives = stage(there.unionByName(begun).join(touched, [dataset, "name"], "left_semi").withColumn("life", life), "lives")
    asked = lives.where("old_name IS NOT NULL").select(dataset, F.col("old_name").alias("name"), "ord", F.lit(0).alias("turn"), F.col("life").alias("child"), F.lit(None).cast("string").alias("life"))
    known = lives.select(dataset, "name", "ord", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("child"), "life")
    before = Window.partitionBy(dataset, "name").orderBy("ord", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parents = asked.unionByName(known).withColumn("parent", F.last("life", ignorenulls=True).over(before)).where("turn = 0").select(F.col("child").alias("life"), "parent")
    edges = lives.join(parents, "life", "left").select(F.col("life").alias("node"), "parent")
    roots = ancestor_paths(edges).select(F.col("node").alias("life"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("node")).alias("root"))
    chained = lives.join(roots, "life")
    spans = chained.groupBy(dataset, "root").agg(F.max_by("name", "ord").alias("last"), F.min("ord").alias("since"), F.max("ord").alias("until"))
    alike = Window.partitionBy(dataset, "last").orderBy("since", "root")
    nth, reach = F.row_number().over(alike), F.max("until").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    named = spans.withColumns({"_n": nth, "_reach": reach}).select(dataset, "root", F.when(F.col("since") < F.col("_reach"), F.concat("last", F.lit("#"), "_n")).otherwise(F.col("last")).alias("column"))
    of_life = chained.join(named, [dataset, "root"]).select(dataset, "name", "ord", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("file"), "column")
    held = placed.join(schemas, "schema_id").select(dataset, F.col(file).alias("file"), "ord", F.explode("fields").alias("f")).select(dataset, F.col("f.name").alias("name"), "ord", F.lit(1).alias("turn"), "file", F.lit(None).cast("string").alias("column"))
    held = held.join(touched, [dataset, "name"], "left_semi")
    at_file = of_life.unionByName(held).withColumn("column", F.last("column", ignorenulls=True).over(before)).where("turn = 1 AND column <> name")
    return at_file.select(dataset, F.col("file").alias(file), F.col("name").alias("field_name"), "column")


def union_schemas(files: DataFrame, schemas: DataFrame, dataset: str, columns: DataFrame | None = None, file: str | None = None) -> DataFrame:
    """(dataset, field_name, kind, n_schemas): the union schema of each dataset, each field in its promoted type.

    With :func:`column_names` the fields are the columns that these give.
    """
    used = files.where(F.col(dataset).isNotNull())
    if columns is None:
        fields = used.select(dataset, "schema_id").distinct().join(schemas, "schema_id").select(dataset, "schema_id", F.explode("fields").alias("_f")).select(dataset, "schema_id", F.col("_f.name").alias("name"), F.col("_f.kind").alias("kind"))
    else:
        each = used.join(_column_maps(columns, dataset, file), [dataset, file], "left").select(dataset, "schema_id", "_columns").withColumn("_key", F.to_json("_columns"))
        kinds = each.groupBy(dataset, "schema_id", "_key").agg(F.first("_columns").alias("_columns")).join(schemas, "schema_id")
        fields = kinds.select(dataset, "schema_id", "_columns", F.explode("fields").alias("_f")).select(dataset, "schema_id", F.coalesce(F.try_element_at("_columns", "_f.name"), F.col("_f.name")).alias("name"), F.col("_f.kind").alias("kind")).distinct()
    return fields.groupBy(dataset, F.col("name").alias("field_name")).agg(promoted(F.collect_set("kind")).alias("kind"), F.countDistinct("schema_id").alias("n_schemas"))


def _column_maps(columns: DataFrame, dataset: str, file: str) -> DataFrame:
    """(dataset, file, _columns): the renamed fields of each file as a map from field to column."""
    return columns.groupBy(dataset, file).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "column")))).alias("_columns"))


def renamed_members(records: DataFrame, columns: DataFrame, dataset: str, file: str) -> DataFrame:
    """``records`` whose members have the names of their columns."""
    joined = records.join(_column_maps(columns, dataset, file), [dataset, file], "left")
    members = F.map_from_entries(F.transform(F.map_entries(_members("record")), lambda e: F.struct(F.coalesce(F.try_element_at("_columns", e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    return joined.withColumn("record", F.to_json(members, {"ignoreNullFields": "false"})).drop("_columns")


def _members(record: str) -> Column:
    """The members of a JSON object under trimmed lower-case names."""
    return F.map_from_entries(F.transform(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: F.struct(F.lower(strip(e["key"])).alias("key"), e["value"].alias("value"))))


def unified_table(records: DataFrame, union: DataFrame, dataset: str, name: str, file: str) -> DataFrame:
    """The table of one dataset: (file, row_no) and a column ``f_<field>`` per field of its union schema, in its promoted type.

    The union schema of the one dataset is read first; it has as many rows as the table gets columns. Otherwise as
    :func:`unified_values`.
    """
    fields = union.where(F.col(dataset) == name).orderBy("field_name").collect()
    once = records.where(F.col(dataset) == name).select(file, "row_no", "record").distinct().select(file, "row_no", _members("record").alias("_m"))
    columns = [F.try_element_at("_m", F.lit(f.field_name)).try_cast(SPARK_TYPES.get(f.kind, "string")).alias(f"f_{f.field_name}") for f in fields]
    return once.select(file, "row_no", *columns)


def unified_values(records: DataFrame, union: DataFrame, dataset: str, file: str) -> DataFrame:
    """(dataset, file, row_no, field_name, kind, value): every record of every file under the union schema, as text in its promoted type.

    ``records`` has (dataset, file, row_no, record); exact copies of a record count once. Fields missing in a record
    are null; a record that is no JSON object has all its fields null. A value its promoted type can't hold is null.
    """
    once = records.select(dataset, file, "row_no", "record").distinct()
    schema = union.groupBy(dataset).agg(F.array_sort(F.collect_list(F.struct("field_name", "kind"))).alias("_fields"))
    rows = once.select(dataset, file, "row_no", _members("record").alias("_m")).join(schema, dataset).select(dataset, file, "row_no", "_m", F.explode("_fields").alias("_f"))
    rows = rows.select(dataset, file, "row_no", "_f.*", F.try_element_at("_m", "_f.field_name").alias("raw"))
    value = F.col("raw")
    for kind, ddl in (("integer", "bigint"), ("float", "double"), ("boolean", "boolean"), ("date", "date"), ("timestamp", "timestamp_ntz")):
        value = F.when(F.col("kind") == kind, F.col("raw").try_cast(ddl).cast("string")).otherwise(value)
    return rows.select(dataset, file, "row_no", "field_name", "kind", value.alias("value"))
