"""Configuration of a model through an adapter: discovered, brought to a canonical form as a plan, checked, and applied to a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from loomspan.functions.hashing import canonical_json, clean, sha256


@dataclass(frozen=True)
class CanonicalConfig:
    """What an adapter found: the folders in order, the files, the primary one, and a hash of their contents."""

    roots: tuple[str, ...]
    files: tuple[str, ...]
    primary: str | None = None
    content_hash: str | None = None


@dataclass(frozen=True)
class ArtifactSpec:
    path: str
    key: str
    direction: str = "input"
    meta: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class IngestSpec:
    """Rows for a data table: given, or made by a function of the run id; they are made when the plan is applied."""

    table: str
    rows: Iterable[Mapping[str, Any]] | Callable[[str], Iterable[Mapping[str, Any]]]
    schema: str
    source: str | None = None

    def materialize_rows(self, run_id: str) -> list[dict]:
        made = self.rows(run_id) if callable(self.rows) else self.rows
        return [{"run_id": run_id, **r} for r in made]

    def to_df(self, spark: SparkSession, run_id: str) -> DataFrame:
        names = ["run_id", *(f.split()[0] for f in self.schema.split(", "))]
        return spark.createDataFrame([[r.get(n) for n in names] for r in self.materialize_rows(run_id)], f"run_id string, {self.schema}")


@dataclass(frozen=True)
class Canonicalized:
    """An adapter's result: artifacts, rows to ingest, and the identity that a run's configuration hash is made of."""

    artifacts: Sequence[ArtifactSpec] = ()
    ingestables: Sequence[IngestSpec] = ()
    identity: Mapping[str, Any] = field(default_factory=dict)


class ConfigAdapter(Protocol):
    """A model's own knowledge of its configuration. ``build_facet`` is optional."""

    model_name: str

    def discover(self, roots: Sequence[str], *, strict: bool = False) -> CanonicalConfig: ...

    def canonicalize(self, config: CanonicalConfig, *, strict: bool = False) -> Canonicalized: ...


@dataclass(frozen=True)
class ConfigPlan:
    adapter: str
    config: CanonicalConfig
    result: Canonicalized
    version: str | None = None
    facet: Mapping[str, Any] | None = None
    facet_schema: tuple[str | None, str | None] = (None, None)
    problems: tuple[str, ...] = ()

    @property
    def identity_hash(self) -> str:
        return sha256(canonical_json(self.result.identity))

    @property
    def signature(self) -> str:
        """Identity of adapter and configuration, whatever folders it lies in."""
        return sha256(canonical_json({"adapter": self.adapter, "version": self.version, "identity": self.result.identity}))

    @property
    def ok(self) -> bool:
        return not self.problems


def validate(plan: ConfigPlan) -> ConfigPlan:
    """The plan with its problems: keys that occur twice, artifacts without a path, tables without columns, an empty identity."""
    keys = [a.key for a in plan.result.artifacts]
    found = [f"artifact key {k} occurs {keys.count(k)} times" for k in sorted(set(keys)) if keys.count(k) > 1]
    found += [f"artifact {a.key} has no path" for a in plan.result.artifacts if not a.path]
    found += [f"direction of {a.key} is {a.direction}" for a in plan.result.artifacts if a.direction not in ("input", "output")]
    found += [f"table {i.table or '?'} has no {what}" for i in plan.result.ingestables for what, there in (("name", i.table), ("columns", i.schema)) if not there]
    if not plan.result.identity:
        found.append("the identity is empty")
    return replace(plan, problems=tuple(found))


def prepare(adapter: ConfigAdapter, roots: Iterable[str], *, strict: bool = False, facet_spec: Mapping[str, Any] | None = None, facet_schema: tuple[str | None, str | None] = (None, None), check: bool = True) -> ConfigPlan:
    """A plan from an adapter; nothing is logged or written until it is applied."""
    config = adapter.discover([str(r) for r in roots], strict=strict)
    facet = None
    if facet_spec is not None:
        if not hasattr(adapter, "build_facet"):
            raise ValueError(f"adapter {adapter.model_name} builds no facets")
        facet = clean(adapter.build_facet(config, facet_spec=facet_spec))
    plan = ConfigPlan(adapter.model_name, config, adapter.canonicalize(config, strict=strict), getattr(adapter, "adapter_version", None), facet, facet_schema)
    return validate(plan) if check else plan


def run_config(plan: ConfigPlan, config: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The configuration of a run under a plan: its own and the plan's identity, so that both make the run's hash."""
    return {**(config or {}), "__config_plan__": {"adapter": plan.adapter, "identity_hash": plan.identity_hash}}


def apply(tracker: Any, plan: ConfigPlan, run_id: str) -> dict[str, str]:
    """Log the plan's artifacts under a run, ingest its rows and index its facet; returns the artifact ids by key."""
    from loomspan.sources.sinks import ingest

    if plan.problems:
        raise ValueError("; ".join(plan.problems))
    made = {a.key: tracker.log_artifact(a.path, a.key, run_id=run_id, direction=a.direction, meta=dict(a.meta))["id"] for a in plan.result.artifacts}
    for i in plan.result.ingestables:
        df = i.to_df(tracker.spark, run_id).drop("run_id")
        ingest(tracker.catalog, i.table, df, run_id, made.get(i.source, ""))
    if plan.facet:
        tracker.log_facet(run_id, plan.adapter, plan.facet, *plan.facet_schema)
    return made
