"""Search, matching and cache lookup of runs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.predicates import Predicate, loose_match, scope_condition
from loomspan.operators.facets import having_all
from loomspan.operators.recency import by_activity, by_creation, by_iteration
from loomspan.session import stage

# The components of a run's cache identity.
COMPONENTS = ["config_hash", "input_hash", "git_hash"]


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return "int" if isinstance(value, int) else "float" if isinstance(value, float) else "str"


def facet_condition(key: str, value: Any, namespace: str | None) -> Column:
    """Type-strict equality: a whole number doesn't match a float of the same value."""
    hit = (F.col("key") == key) & (F.col("value_type") == _kind(value))
    if namespace is not None:
        hit &= F.col("namespace") == namespace
    column = {"bool": "value_bool", "int": "value_num", "float": "value_num", "str": "value_str"}.get(_kind(value))
    return hit & (F.col(column) == F.lit(value)) if column else hit


def find_runs(
    runs: DataFrame,
    *,
    kv: DataFrame | None = None,
    tags: Iterable[str] = (),
    facet: Mapping[str, Any] | None = None,
    metadata: Mapping[str, Any] | None = None,
    run_scope: str | None = None,
    limit: int | None = 100,
    namespace: str | None = None,
    **equal: Any,
) -> DataFrame:
    """Runs that meet all conditions, newest first: equality on any column, all ``tags``, facets, members of meta, scope.

    The metadata condition is applied after the limit. Facets match by type and value; without ``namespace`` in any.
    A condition of None is no condition.
    """
    out = runs
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    out = out.where(scope_condition(run_scope, "id", "description"))
    if facet:
        if kv is None:
            raise ValueError("a facet condition needs the key-value rows")
        met = kv.where(F.col("key").isin(list(facet))).groupBy(F.col("run_id").alias("id")).agg(*(F.bool_or(F.coalesce(facet_condition(k, v, namespace), F.lit(False))).alias(f"_f{i}") for i, (k, v) in enumerate(facet.items())))
        out = out.join(met.where(" AND ".join(f"_f{i}" for i in range(len(facet)))).select("id"), "id", "left_semi")
    out = out.orderBy(*by_creation())
    if limit is not None:
        out = out.limit(limit)
    for key, value in (metadata or {}).items():
        out = out.where(F.get_json_object("meta", f"$.{key}") == (str(value).lower() if isinstance(value, bool) else str(value)))
    return out


def find_run(runs: DataFrame, **conditions: Any) -> DataFrame:
    """The one run that meets the conditions of :func:`find_runs`; none or several raise an error."""
    found = find_runs(runs, **{**conditions, "limit": 2})
    n = found.count()
    if n != 1:
        raise ValueError("no run matches" if n == 0 else "more than one run matches")
    return found


def find_latest_run(runs: DataFrame, **conditions: Any) -> DataFrame:
    """The matching run of the greatest iteration, then the newest."""
    return find_runs(runs, **{**conditions, "limit": None}).orderBy(*by_iteration()).limit(1)


def matching_runs(runs: DataFrame, *, cache_epoch: Any = None, allow_missing_epoch: bool = False, run_scope: str | None = None, limit: int | None = 100, **target: Any) -> DataFrame:
    """Runs that match loosely (numbers as numbers, text without case), a missing field taken from meta, most recent first.

    ``target``: model, status, year, iteration, stage, phase.
    """
    meta = lambda name: F.get_json_object("meta", f"$.{name}")
    fields = {
        "model": F.coalesce("model_name", meta("model"), meta("model_name")),
        "stage": F.coalesce("stage", meta("stage"), meta("stage_name")),
        **{c: F.coalesce(F.col(c).cast("string"), meta(c)) for c in ("status", "year", "iteration", "phase")},
    }
    hit = scope_condition(run_scope, "id", "description")
    for name, value in target.items():
        hit &= loose_match(fields[name], value)
    if cache_epoch is not None:
        epoch = meta("cache_epoch")
        hit &= F.when(epoch.isNull(), F.lit(allow_missing_epoch)).otherwise(loose_match(epoch, cache_epoch))
    out = runs.where(hit).orderBy(*by_activity())
    return out if limit is None else out.limit(limit)


def search(runs: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Runs whose id, model, parent or one of whose tags contains ``text``, newest first."""
    hit = F.exists("tags", lambda t: t.contains(text))
    for c in ("id", "model_name", "parent_run_id"):
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.col(c).contains(text), F.lit(False))
    return runs.where(hit).orderBy(*by_creation()).limit(limit)


def cache_matches(runs: DataFrame, config_hash: str, input_hash: str, git_hash: str) -> DataFrame:
    """Completed runs of exactly this identity, newest first."""
    same = (F.col("config_hash") == config_hash) & (F.col("input_hash") == input_hash) & (F.col("git_hash") == git_hash)
    return runs.where((F.col("status") == "completed") & same).orderBy(*by_creation())


def recent_completed(runs: DataFrame, model: str, limit: int = 20) -> DataFrame:
    return runs.where((F.col("model_name") == model) & (F.col("status") == "completed")).orderBy(*by_creation()).limit(limit)


def history(runs: DataFrame, limit: int = 10, tags: Iterable[str] = ()) -> DataFrame:
    """The newest runs with their duration in seconds; tags are tested after the limit."""
    out = runs.orderBy(*by_creation()).limit(limit)
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return out.withColumn("duration_seconds", seconds)


def miss_reason(config_same: Column, input_same: Column, git_same: Column) -> Column:
    """Why a run was no cache hit, from the components that agree with the closest earlier run."""
    differs = F.concat_ws("+", F.when(~config_same, "config"), F.when(~input_same, "inputs"), F.when(~git_same, "code"))
    # The reasons by what differs.
    reasons = {
        "": "exact_match_lookup_inconclusive",
        "config": "config_changed",
        "inputs": "inputs_changed",
        "code": "code_changed",
        "config+inputs": "config_and_inputs_changed",
        "config+code": "config_and_code_changed",
        "inputs+code": "inputs_and_code_changed",
        "config+inputs+code": "all_components_changed",
    }
    return F.element_at(F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair)), differs)


#: The candidates of so many models at most are broadcast (21 rows each); those of more are shuffled.
BROADCAST_MODELS = 10_000


def explain_misses(runs: DataFrame, history_of: DataFrame, recent: int = 20) -> DataFrame:
    """(id, candidate_run_id, matched, reason, confidence) for each of ``runs``: the closest of the ``recent`` newest
    completed runs of its model in ``history_of`` (other than itself), by number of equal components, then recency.

    The candidates of a model are one row with an array, scored with array functions: no run is fanned out.
    """
    from pyspark.sql.window import Window

    newest = Window.partitionBy("model_name").orderBy(*by_creation())
    known = history_of.where("status = 'completed' AND model_name IS NOT NULL").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= recent + 1)
    each = F.struct("_n", F.col("id").alias("c_id"), F.col("created_at").alias("c_at"), *COMPONENTS)
    models = stage(known.groupBy("model_name").agg(F.array_sort(F.collect_list(each)).alias("_c")), "candidates")
    models = F.broadcast(models) if models.count() <= BROADCAST_MODELS else models

    def scored(c: Column) -> Column:
        same = [F.col(x).eqNullSafe(c[x]) for x in COMPONENTS]
        return F.struct(sum(s.cast("int") for s in same).alias("matched"), c["c_at"].alias("c_at"), c["c_id"].alias("c_id"), *(s.alias(f"s{i}") for i, s in enumerate(same)))

    others = F.slice(F.filter("_c", lambda c: c["c_id"] != F.col("id")), 1, recent)
    joined = runs.select("id", "model_name", *COMPONENTS).join(models, "model_name", "left").select("id", F.array_max(F.transform(others, scored)).alias("b")).select("id", "b.*")
    reason = F.when(F.col("c_id").isNull(), "no_similar_prior_run").otherwise(miss_reason(F.col("s0"), F.col("s1"), F.col("s2")))
    confidence = F.when(F.col("c_id").isNull() | (F.col("matched").isin(0, 3)), "low").when(F.col("matched") >= 2, "high").otherwise("medium")
    return joined.select("id", F.col("c_id").alias("candidate_run_id"), "matched", reason.alias("reason"), confidence.alias("confidence"))


def facet_filtered(runs: DataFrame, kv: DataFrame, predicates: Iterable[Predicate | str]) -> DataFrame:
    return having_all(runs, "id", kv, "run_id", predicates, key="key")


def indexed(runs: DataFrame, field: str | None = None, facet: str | None = None, kv: DataFrame | None = None) -> dict:
    """Runs of a bounded result (see the limit of :func:`find_runs`) by a field, or by the newest value of a facet; a value that occurs twice is an error."""
    from loomspan.operators.facets import value_per_run

    if (field is None) == (facet is None):
        raise ValueError("runs are indexed by a field or by a facet")
    named = runs.withColumn("_index", F.col(field)) if field else runs.join(value_per_run(kv, facet).select(F.col("run_id").alias("id"), F.col("value").alias("_index")), "id", "left")
    out: dict = {}
    for r in named.collect():
        if r["_index"] in out:
            raise ValueError(f"several runs have {field or facet} {r['_index']}")
        out[r["_index"]] = r
    return out
