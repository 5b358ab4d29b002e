"""Sets of runs: split, filter, latest of each group, one-to-one alignment and configuration differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.facets import typed_text
from loomspan.operators.recency import by_creation, first_of_group


def sort_rank(value: Column, kind: str) -> Column:
    """Rank of a value among mixed types: null, boolean, number, time, text, other."""
    order = {"boolean": 1, "tinyint": 2, "smallint": 2, "int": 2, "bigint": 2, "float": 2, "double": 2, "date": 3, "timestamp": 3, "timestamp_ntz": 3, "string": 4}
    return F.when(value.isNull(), 0).otherwise(order.get(kind, 2 if kind.startswith("decimal") else 6))


@dataclass(frozen=True)
class RunSet:
    """Runs (id, model_name, created_at, ...) and, for fields that are facets, their key-value rows."""

    runs: DataFrame
    kv: DataFrame | None = None
    label: str | None = None

    def with_fields(self, fields: Sequence[str]) -> DataFrame:
        """The runs with a column per field: a column of the runs, or else the facet of that key, the one in the run's own
        model namespace first. A field that is neither is null."""
        facets = [f for f in fields if f not in self.runs.columns]
        if not facets or self.kv is None:
            return self.runs.withColumns({f: F.lit(None).cast("string") for f in facets})
        rows = self.kv.where(F.col("key").isin(facets)).join(self.runs.select(F.col("id").alias("run_id"), "model_name"), "run_id")
        own = F.coalesce(F.col("namespace") == F.col("model_name"), F.lit(False))
        order = [own.desc(), F.col("created_at").desc_nulls_last(), F.col("facet_id").desc()]
        one = first_of_group(rows.withColumn("_own", own).withColumn("_text", typed_text()), ["run_id", "key"], order)
        wide = one.groupBy("run_id").pivot("key", facets).agg(F.first("_text"))
        return self.runs.join(wide.withColumnRenamed("run_id", "id"), "id", "left")

    def filter(self, **values) -> RunSet:
        """Runs equal in all fields; None matches null."""
        out = self.with_fields(list(values))
        for f, v in values.items():
            out = out.where(F.col(f).isNull() if v is None else F.col(f) == F.lit(v))
        return RunSet(out.select(*self.runs.columns), self.kv, self.label)

    def split_by(self, field: str) -> dict:
        """A set per value of the field, in ascending order with null first. The values are few: one query lists them."""
        known = self.with_fields([field])
        values = [r[0] for r in known.select(field).distinct().orderBy(F.col(field).asc_nulls_first()).collect()]
        return {v: RunSet(known.where(F.col(field).eqNullSafe(F.lit(v))).select(*self.runs.columns), self.kv, str(v)) for v in values}

    def counts(self, field: str) -> DataFrame:
        return self.with_fields([field]).groupBy(field).agg(F.count(F.lit(1)).alias("n"))

    def latest(self, group_by: Sequence[str] = ()) -> RunSet:
        """The newest run of each group, by creation and id; without groups the newest of all."""
        known = self.with_fields(list(group_by))
        out = first_of_group(known, group_by, by_creation()) if group_by else known.orderBy(*by_creation()).limit(1)
        return RunSet(out.select(*self.runs.columns), self.kv, self.label)

    def keyed(self, on: Sequence[str]) -> DataFrame:
        """(on, id, ...) with one run per key; several runs of one key raise an error."""
        known = self.with_fields(list(on))
        double = known.groupBy(*on).count().where("count > 1").limit(1).collect()
        if double:
            raise ValueError(f"several runs have the key {tuple(double[0])[:-1]} in {self.label or 'the set'}")
        return known

    def align(self, other: RunSet, on: Sequence[str]) -> AlignedPair:
        """Pairs of runs with equal keys, one to one; nulls equal each other; keys of one side only drop out."""
        left, right = (s.keyed(on).select(*(F.col(c).alias(f"{p}_{c}") for c in on), F.col("id").alias(f"{p}_id")) for p, s in (("l", self), ("r", other)))
        pairs = left.join(right, [left[f"l_{c}"].eqNullSafe(right[f"r_{c}"]) for c in on])
        return AlignedPair(pairs.select(*(F.col(f"l_{c}").alias(c) for c in on), F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")), list(on), self, other)

    def __getitem__(self, at: int):
        """The run at a place in the order of creation, the newest first."""
        if at < 0:
            raise IndexError("places count from 0")
        found = self.runs.orderBy(*by_creation()).offset(at).limit(1).collect()
        if not found:
            raise IndexError(at)
        return found[0]

    def to_frame(self, facets: Sequence[str] = ()) -> DataFrame:
        return self.with_fields(list(facets))


def diff_values(left: DataFrame, right: DataFrame, on: Sequence[str], include_equal: bool = True) -> DataFrame:
    """(on, left_value, right_value, status) of two tables (on, value): removed, added, changed or same.

    A key whose value is null on one side is there; null equals null.
    """
    a = left.select(*on, F.col("value").alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*on, F.col("value").alias("right_value"), F.lit(True).alias("_r"))
    status = F.when(F.col("_r").isNull(), "removed").when(F.col("_l").isNull(), "added").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    out = a.join(b, list(on), "full_outer").withColumn("status", status).drop("_l", "_r")
    return out if include_equal else out.where("status <> 'same'")


def compare_metrics(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "value", decimals: int | None = None) -> DataFrame:
    """(on, left, right, delta, ratio): a metric of two sides where both have it."""
    a, b = left.select(*on, F.col(value).alias("left")), right.select(*on, F.col(value).alias("right"))
    delta, ratio = F.col("right") - F.col("left"), F.try_divide(F.col("right"), F.col("left"))
    shown = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    return a.join(b, list(on)).select(*on, "left", "right", shown(delta).alias("delta"), shown(ratio).alias("ratio"))


@dataclass(frozen=True)
class AlignedPair:
    """Pairs (on, left_id, right_id) of two sets of runs."""

    pairs: DataFrame
    on: list[str]
    left: RunSet
    right: RunSet

    def config_diffs(self, namespace: str | None = None, prefix: str | None = None, include_equal: bool = True) -> DataFrame:
        """(on, key, left_value, right_value, status) of each pair. Without ``namespace`` each side reads that of its own model."""
        sides = []
        for side, s in (("left", self.left), ("right", self.right)):
            runs = s.runs.select(F.col("id").alias("run_id"), F.col("model_name").alias("_model"))
            rows = s.kv.join(runs, "run_id").where(F.col("namespace") == (F.lit(namespace) if namespace else F.col("_model")))
            if prefix is not None:
                rows = rows.where(F.col("key").startswith(prefix))
            newest = rows.groupBy("run_id", "key").agg(F.max_by(typed_text(), F.struct("created_at", "facet_id")).alias("value"))
            sides.append(self.pairs.join(newest.withColumnRenamed("run_id", f"{side}_id"), f"{side}_id").select(*self.on, "left_id", "right_id", "key", "value"))
        return diff_values(*sides, [*self.on, "left_id", "right_id", "key"], include_equal)

    def apply(self, left: DataFrame, right: DataFrame, run_column: str, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """``fn`` on the rows of the two runs of each pair; its rows get the column ``align_key``. A pair's rows must fit one task."""
        key = F.to_json(F.struct(*self.on), {"ignoreNullFields": "false"})
        right = right.select(*(F.col(f"`{c}`").alias(c) for c in right.columns))  # may be the same table as left
        tagged = [df.join(self.pairs.select(F.col(f"{side}_id").alias(run_column), key.alias("align_key")), run_column) for side, df in (("left", left), ("right", right))]

        def both(group: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return fn(a.drop(columns="align_key"), b.drop(columns="align_key")).assign(align_key=group[0])

        return tagged[0].groupBy("align_key").cogroup(tagged[1].groupBy("align_key")).applyInPandas(both, f"{schema}, align_key string")

    def __iter__(self) -> Iterator:
        return self.pairs.orderBy(*(F.col(c).asc_nulls_first() for c in self.on)).toLocalIterator()
