"""Data quality profile of loads against declared fields and against earlier loads.

The declared checks of all columns compile into one aggregate over one scan. Its result is a table of mergeable states
(counts, sums, extremes, distinct-count sketches): states of several files or days merge by adding. They are kept in a
store, one row per load and input file, so a later call only scans the files that are new. Findings, changes between
loads and control limits are computed from the merged states alone; only exact duplicates are sought in the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.files import FILE_SCHEME, exists, plain_path


@dataclass(frozen=True)
class Check:
    """The declared profile of one column."""

    name: str
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    unique: bool = False
    enum: tuple[str, ...] = field(default=())

    @property
    def ranged(self) -> bool:
        return self.low is not None and self.high is not None


def declared(rows: Iterable) -> list[Check]:
    """Checks of the rows of a field profile table, in their order."""
    out = []
    for r in sorted(rows, key=lambda r: (r["ordinal_position"] is None, r["ordinal_position"])):
        stats = json.loads(r["stats"]) if r["stats"] else {}
        enum = tuple(r["enum_values"] or ()) if r["is_enum"] else ()
        out.append(Check(r["name"], r["nullable"] is not False, stats.get("min"), stats.get("max"), stats.get("pattern"), bool(stats.get("unique")), enum))
    return out


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def profile_states(df: DataFrame, by: list[str], checks: list[Check]) -> DataFrame:
    """One row of states per load: ``n`` and, per column c, ``c__nulls``, ``c__low_high``, ``c__inside``, ``c__sum``,
    ``c__enum`` (values outside), ``c__e<i>`` (count of the i-th enum value), ``c__pattern``, ``c__min``, ``c__max`` and
    ``c__sketch``. NaN counts as null, '' doesn't. Rows count as they lie, copies included."""
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in checks:
        v = F.nanvl(F.col(c.name), F.lit(None)) if kinds[c.name] in ("double", "float") else F.col(c.name)
        bounds = [v < c.low] * (c.low is not None) + [v > c.high] * (c.high is not None)
        aggs += [_count(v.isNull()).alias(f"{c.name}__nulls"), F.min(v).alias(f"{c.name}__min"), F.max(v).alias(f"{c.name}__max"), F.hll_sketch_agg(v.cast("string")).alias(f"{c.name}__sketch")]
        if bounds:
            aggs.append(_count(reduce(Column.__or__, bounds)).alias(f"{c.name}__low_high"))
        if c.ranged:
            inside = v.between(c.low, c.high)
            aggs += [_count(inside).alias(f"{c.name}__inside"), F.sum(F.when(inside, v.cast("double"))).alias(f"{c.name}__sum")]
        if c.enum:
            aggs += [_count(~v.isin(*c.enum)).alias(f"{c.name}__enum"), *(_count(v == e).alias(f"{c.name}__e{i}") for i, e in enumerate(c.enum))]
        if c.pattern is not None:
            aggs.append(_count(~v.rlike(rf"\A(?:{c.pattern})\z")).alias(f"{c.name}__pattern"))
    return df.groupBy(*by).agg(*aggs)


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """States of the union of the rows that several states (of partitions, of days) were made from."""
    how = {"min": F.min, "max": F.max, "sketch": F.hll_union_agg}
    return states.groupBy(*by).agg(*(how.get(c.rpartition("__")[2], F.sum)(c).alias(c) for c in states.columns if c not in by))


class StateStore:
    """States by load and input file, as Parquet files in the folder ``path``."""

    def __init__(self, path: str, by: list[str], checks: list[Check]):
        self.path, self.by, self.checks = path, by, checks

    def update(self, df: DataFrame) -> list[str]:
        """Profile the files of ``df`` (a table in Parquet files) that have no states yet, in one scan; returns their paths.

        The list of a table's files is on the driver anyway; a file is taken as never changed.
        """
        spark = df.sparkSession
        known = {r[0] for r in spark.read.parquet(self.path).select("_file").distinct().collect()} if exists(spark, self.path) else set()
        new = sorted(f for f in df.inputFiles() if plain_path(f) not in known)
        if new or not known:
            rows = spark.read.schema(df.schema).parquet(*new) if new else df
            rows = rows.select("*", F.col("_metadata.file_path").alias("_file")) if new else rows.withColumn("_file", F.lit(""))
            states = profile_states(rows, [*self.by, "_file"], self.checks).withColumn("_file", F.regexp_replace("_file", FILE_SCHEME, "/"))
            states.write.mode("append").option("compression", "zstd").parquet(self.path)
        return new

    def read(self, spark) -> DataFrame:
        """One row of states per load."""
        return merge_states(spark.read.parquet(self.path).drop("_file"), self.by)


def duplicate_loads(df: DataFrame, by: list[str], checks: list[Check]) -> DataFrame | None:
    """(by, column_name): loads in which a value of a unique column occurs twice. Grouped by value, so no load is held by one task."""
    parts = [df.where(F.col(c.name).isNotNull()).groupBy(*by, F.col(c.name).alias("_v")).count().where("count > 1").select(*by, F.lit(c.name).alias("column_name")).distinct() for c in checks if c.unique]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _moved(now: Column, before: Column, n: Column, n0: Column, tenths: int) -> Column:
    """|now/n - before/n0| > tenths/10, in whole numbers."""
    big = lambda x: x.cast("decimal(18,0)")
    return F.abs(big(now) * big(n0) - big(before) * big(n)) * 10 > big(n) * big(n0) * tenths


def findings(states: DataFrame, scenario: str, at: str, checks: list[Check], null_tenths: int = 1, enum_tenths: int = 2, mean_shift: float = 0.25) -> DataFrame:
    """(scenario, at, column_name, finding) of each load: null, range, enum, pattern, and shift against the load before."""
    w = Window.partitionBy(scenario).orderBy(at)
    before = lambda c: F.lag(c).over(w)
    used = [c for c in states.columns if c.endswith(("__nulls", "__inside", "__sum")) or c.rpartition("__")[2][:1] == "e" and c.rpartition("__")[2][1:].isdigit()]
    paired = states.select("*", before("n").alias("_n0"), *(before(c).alias(f"_b_{c}") for c in used))
    n, n0 = F.col("n"), F.col("_n0")
    tells = []
    for c in checks:
        col = lambda s, c=c: F.col(f"{c.name}__{s}")
        old = lambda s, c=c: F.col(f"_b_{c.name}__{s}")
        shift = [_moved(col("nulls"), old("nulls"), n, n0, null_tenths)]
        shift += [_moved(col(f"e{i}"), old(f"e{i}"), n, n0, enum_tenths) for i in range(len(c.enum))]
        if c.ranged:
            mean, mean0 = F.try_divide(col("sum"), col("inside")), F.try_divide(old("sum"), old("inside"))
            shift.append(F.abs(mean - mean0) > mean_shift * F.abs(mean0))
        cases = {"shift": reduce(Column.__or__, [F.coalesce(s, F.lit(False)) for s in shift])}
        if not c.nullable:
            cases["null"] = col("nulls") > 0
        if c.low is not None or c.high is not None:
            cases["range"] = col("low_high") > 0
        if c.enum:
            cases["enum"] = col("enum") > 0
        if c.pattern is not None:
            cases["pattern"] = col("pattern") > 0
        tells += [F.when(when, F.struct(F.lit(c.name).alias("column_name"), F.lit(what).alias("finding"))) for what, when in cases.items()]
    return paired.select(scenario, at, F.explode(F.array_compact(F.array(*tells).cast("array<struct<column_name string, finding string>>"))).alias("_t")).select(scenario, at, "_t.*")


def metrics(states: DataFrame, by: list[str], checks: list[Check]) -> DataFrame:
    """(by, column_name, metric, value): share of nulls, estimated distinct values, and the mean within the declared range."""
    out = []
    for c in checks:
        out += [(c.name, "null_share", F.col(f"{c.name}__nulls") / F.col("n")), (c.name, "distinct", F.hll_sketch_estimate(f"{c.name}__sketch").cast("double"))]
        if c.ranged:
            out.append((c.name, "mean", F.try_divide(F.col(f"{c.name}__sum"), F.col(f"{c.name}__inside"))))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), F.lit(m).alias("metric"), v.alias("value")) for n, m, v in out))
    return states.select(*by, F.explode(rows.cast("array<struct<column_name string, metric string, value double>>")).alias("_m")).select(*by, "_m.*")


def control_limits(metric_rows: DataFrame, scenario: str, at: str, sigmas: float = 3.0, least: int = 3) -> DataFrame:
    """Metrics outside mean +- ``sigmas`` deviations of all earlier loads of the scenario, where there are ``least`` of them.

    A difference in the ninth decimal is rounding and never outside.
    """
    w = Window.partitionBy(scenario, "column_name", "metric").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    known = metric_rows.select("*", F.avg("value").over(w).alias("center"), F.stddev_samp("value").over(w).alias("deviation"), F.count("value").over(w).alias("loads"))
    limit = F.greatest(sigmas * F.col("deviation"), 1e-9 * F.greatest(F.lit(1.0), F.abs("center")))
    return known.where((F.col("loads") >= least) & (F.abs(F.col("value") - F.col("center")) > limit))
