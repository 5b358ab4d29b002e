"""Coefficient and probability sheets of models: long form, and groups of runs that share values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as true in the column that constrains a coefficient.
TRUE = ["T", "TRUE", "1", "Y", "YES"]
META = ["coefficient_name", "value", "description", "constrain", "coefficient", "expression", "label", "target", "comment"]


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def _kept(col: Column) -> Column:
    return F.coalesce((F.trim(col) != "") & ~F.trim(col).startswith("#"), F.lit(False))


def coefficient_rows(sheet: DataFrame) -> DataFrame:
    """(source_type, coefficient_name, segment, dims_json, value, constrained) of an all-text sheet.

    A sheet with ``coefficient`` is dimensional (its other columns are the dimensions), one with ``value`` direct, any
    other a template with a segment per column. Rows with a blank or commented name or value are left out.
    """
    text = sheet.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in sheet.columns))
    constrained = F.coalesce(F.upper(F.trim("constrain")).isin(TRUE), F.lit(False)) if "constrain" in sheet.columns else F.lit(False)
    text = text.withColumn("constrained", constrained)
    none = F.lit(None).cast("string")
    if "coefficient" in sheet.columns:
        dims = [c for c in sheet.columns if c not in META]
        name = F.col("coefficient_name") if "coefficient_name" in sheet.columns else F.to_json(F.struct(*dims))
        rows = text.select(F.lit("dimensional").alias("source_type"), name.alias("coefficient_name"), none.alias("segment"), F.to_json(F.struct(*dims)).alias("dims_json"), F.col("coefficient").alias("value"), "constrained")
    elif "value" in sheet.columns:
        rows = text.select(F.lit("direct").alias("source_type"), "coefficient_name", none.alias("segment"), none.alias("dims_json"), "value", "constrained")
    else:
        segments = [c for c in sheet.columns if c not in META]
        rows = unpivot(text, ["coefficient_name", "constrained"], segments, "segment", "value").select(F.lit("template").alias("source_type"), "coefficient_name", "segment", none.alias("dims_json"), "value", "constrained")
    kept = rows.where(_kept(F.col("coefficient_name")) & _kept(F.col("value")))
    return kept.withColumn("value_num", F.trim("value").try_cast("double"))


def probability_rows(sheet: DataFrame, index: str = "row_index") -> DataFrame:
    """(row_index, dims, probs): the numeric cells of each row are probabilities, the others dimensions.

    ``index`` is the row's place in the file, which the reader must give.
    """
    columns = [c for c in sheet.columns if c != index]
    cells = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("text")) for c in columns))
    number = lambda e: e["text"].try_cast("double").isNotNull()
    probs = F.map_from_entries(F.transform(F.filter(cells, number), lambda e: F.struct(e["key"], e["text"].cast("double"))))
    dims = F.map_from_entries(F.transform(F.filter(cells, lambda e: ~number(e) & e["text"].isNotNull()), lambda e: F.struct(e["key"], e["text"])))
    return sheet.select(index, dims.alias("dims"), probs.alias("probs"))


def probability_entries(sheet: DataFrame, index: str = "row_index") -> DataFrame:
    """(row_index, key, value): one row per probability."""
    return probability_rows(sheet, index).select(index, F.explode("probs").alias("key", "value"))


def collapsed(values: DataFrame, by: Sequence[str], value: str, order: str, how: str = "first") -> DataFrame:
    """One value per group: the first or last by ``order``, the list of them, or an error if there are several."""
    if how == "list":
        return values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(value))
    if how == "error":
        n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if n:
            raise ValueError(f"several values for {tuple(n[0])[:-1]}")
    pick = F.max_by if how == "last" else F.min_by
    return values.groupBy(*by).agg(pick(value, order).alias(value))


def combinations(values: DataFrame, run: str, name: str, value: str, names: Sequence[str], require_all: bool = True, missing: str | None = None) -> DataFrame:
    """(one column per name, runs, n_runs): the combinations of values that occur and the runs of each, sorted."""
    wide = values.where(F.col(name).isin(list(names))).groupBy(run).pivot(name, list(names)).agg(F.first(value))
    if require_all:
        wide = wide.na.drop(subset=list(names))
    elif missing is not None:
        wide = wide.na.fill(missing, list(names))
    return wide.groupBy(*names).agg(F.sort_array(F.collect_list(run)).alias("runs"), F.count(F.lit(1)).alias("n_runs"))


def query_by_config(cache: DataFrame, links: DataFrame, on: Sequence[str] = ("content_hash",), table_name: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a content-addressed table with the runs that use each content."""
    used = links if table_name is None else links.where(F.col("table_name") == table_name)
    joined = cache.join(used.select("run_id", *on).distinct(), list(on))
    return joined.select("run_id", *columns) if columns else joined
