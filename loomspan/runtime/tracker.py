"""Tracked runs: a step's identity decides whether it runs or its earlier outputs are taken."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import logging
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import files
from loomspan.functions.hashing import canonical_json, facet_id, run_config_hash, sha256
from loomspan.operators import runs as run_queries
from loomspan.operators.facets import NAMES, flatten
from loomspan.operators.recency import by_creation
from loomspan.plans.catalog import Catalog
from loomspan.plans.views import ingested
from loomspan.runtime.identity import check_depth, code_version
from loomspan.sources.drivers import driver_for, load

log = logging.getLogger(__name__)
MODES = ("reuse", "overwrite", "readonly")
HYDRATION = ("metadata", "inputs-missing", "outputs-requested", "outputs-all")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class RunResult:
    run_id: str
    cache_hit: bool
    outputs: dict[str, str]
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass
class Step:
    """What a decorated function declares of itself."""

    name: str | None = None
    outputs: Sequence[str] = ()
    tags: Sequence[str] = ()
    cache_version: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def step(**declared: Any) -> Callable:
    """Attach the defaults of a step (name, outputs, tags, cache_version) to a function."""
    known = {k: declared.pop(k) for k in ("name", "outputs", "tags", "cache_version") if k in declared}

    def mark(fn: Callable) -> Callable:
        fn.step = Step(**known, extra=declared)
        return fn

    return mark


def imported(name: str | Callable) -> Callable:
    """A function, or the one that ``module:name`` names."""
    if callable(name):
        return name
    module, _, member = name.partition(":")
    if not member:
        raise ValueError(f"a function is named module:function, not {name}")
    return getattr(importlib.import_module(module), member)


def code_hash(fn: Callable, extra: Iterable[str] = ()) -> str:
    """Identity of a function: its source, and the contents of further files; a file that isn't there counts as MISSING."""
    try:
        parts = [sha256(inspect.getsource(fn))]
    except (OSError, TypeError):
        parts = [f"{fn.__module__}.{fn.__qualname__}"]
    parts += [f"{p}:{sha256(Path(p).read_text()) if Path(p).exists() else 'MISSING'}" for p in extra]
    return sha256("|".join(sorted(parts)))


def file_hash(path: str, fast: bool = False, spark: SparkSession | None = None, keep: Callable[[str], bool] | None = None, hidden: bool = False) -> str:
    """Identity of a file or folder: its contents, or only names, sizes and times.

    With ``spark`` the files are listed and read by the executors, from any file system; without, they are local. Of a
    folder, names that begin with a dot or underscore are left out unless ``hidden``, and ``keep`` chooses by relative path.
    """
    if spark is not None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        at = F.regexp_replace("path", files.FILE_SCHEME, "/")
        rel = F.when(at.startswith(files.plain_path(path).rstrip("/") + "/"), F.substring(at, len(files.plain_path(path).rstrip("/")) + 2, 1 << 20)).otherwise("")
        digest = F.unix_millis("modificationTime").cast("string") if fast else F.sha2("content", 256)
        listed = sorted(tuple(r) for r in rows.select(rel, F.col("length").cast("string"), digest).collect())
    else:
        root = Path(path)
        found = [p for p in root.rglob("*") if p.is_file()] if root.is_dir() else [root]
        name = lambda p: p.relative_to(root).as_posix() if root.is_dir() else ""
        listed = sorted((name(p), str(p.stat().st_size), str(p.stat().st_mtime_ns // 1_000_000) if fast else _content_hash(p)) for p in found)
    chosen = [r for r in listed if (hidden or not any(x.startswith((".", "_")) for x in r[0].split("/"))) and (keep is None or keep(r[0]))]
    return sha256("\n".join(":".join(r) for r in chosen))


def _content_hash(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Tracker:
    """Runs steps and records them in a catalog under ``root``. One process writes to a catalog."""

    def __init__(self, spark: SparkSession, root: str, fast_hash: bool = False):
        self.spark, self.root, self.fast_hash = spark, str(root).rstrip("/"), fast_hash
        self.catalog = Catalog(spark, f"{self.root}/catalog")
        self.hooks: dict[str, list[Callable]] = {"start": [], "complete": [], "failed": []}
        self.parsers: dict[str, Callable[[str], Mapping[str, Any] | None]] = {}
        self.active: list[Trace] = []
        self.lock = Lock()

    def on(self, event: str, hook: Callable) -> None:
        """Call ``hook(run)`` when a run starts, completes or fails."""
        self.hooks[event].append(hook)

    def _emit(self, event: str, run: dict) -> None:
        for hook in self.hooks[event]:
            try:
                hook(run)
            except Exception:
                log.exception("a hook for %s failed", event)

    def artifact(self, ref: str) -> dict | None:
        """The artifact of an id, or the newest of a key."""
        rows = self.catalog.read("artifact").where((F.col("id") == ref) | (F.col("key") == ref)).orderBy((F.col("id") == ref).desc(), *by_creation()).limit(1).collect()
        return rows[0].asDict() if rows else None

    def register_facet_parser(self, prefix: str, parser: Callable[[str], Mapping[str, Any] | None]) -> None:
        """Artifacts whose key begins with ``prefix`` get the facet that ``parser(key)`` gives; the longest prefix counts."""
        self.parsers[prefix] = parser

    def log_facet(self, of: str, namespace: str | None, facet: Mapping[str, Any], schema_name: str | None = None, schema_version: str | None = None, entity: str = "run") -> str:
        """Store a facet of a run or artifact as a document and as typed rows; returns its id."""
        shown = json.loads(canonical_json(facet))
        check_depth(shown)
        key, table, path = facet_id(facet), {"run": "config", "artifact": "artifact"}[entity], {"run": "key", "artifact": "key_path"}[entity]
        self.catalog.append(f"{table}_facet", [{"facet_id": key, "namespace": namespace, "schema_name": schema_name, "schema_version": schema_version, "facet": canonical_json(facet), "created_at": now()}])
        rows = [dict(zip(NAMES, r)) for r in flatten(shown)]
        if rows:
            self.catalog.append({"run": "run_config_kv", "artifact": "artifact_kv"}[entity], [{f"{entity}_id": of, "facet_id": key, "namespace": namespace, path: r.pop("key_path"), **r, "created_at": now()} for r in rows])
        return key

    def log_artifact(self, path: str, key: str, *, run_id: str | None = None, direction: str = "output", driver: str | None = None, meta: Mapping[str, Any] | None = None, parent: str | None = None, facet: Mapping[str, Any] | None = None, content: str | None = None) -> dict:
        """Record a file and its link to a run: the given one, else the one that is open. Inputs keep no producer."""
        run_id = run_id or (self.active[-1].run["id"] if self.active else None)
        made = {"id": str(uuid.uuid4()), "key": key, "container_uri": path, "driver": driver or driver_for(path), "hash": content or file_hash(path, self.fast_hash, self.spark), "parent_artifact_id": parent, "run_id": run_id if direction == "output" else None, "meta": canonical_json(meta or {}), "created_at": now()}
        parser = max((p for p in self.parsers if key.startswith(p)), key=len, default=None)
        facet = facet if facet is not None or parser is None else self.parsers[parser](key)
        with self.lock:
            self.catalog.append("artifact", [made])
            if run_id:
                self.catalog.append("run_artifact_link", [{"run_id": run_id, "artifact_id": made["id"], "direction": direction, "is_implicit": False, "created_at": now()}])
            if facet:
                self.log_facet(made["id"], None, facet, entity="artifact")
        return made

    def attributed_run(self, artifact: Mapping[str, Any], run_id: str | None = None) -> str:
        """The run that ingested rows belong to: the given one, else the open one, else the one that made the artifact."""
        found = run_id or (self.active[-1].run["id"] if self.active else None)
        if found is None and artifact.get("run_id") and not self.catalog.read("run").where(F.col("id") == artifact["run_id"]).isEmpty():
            found = artifact["run_id"]
        if found is None:
            raise RuntimeError(f"artifact {artifact['id']} can't be attributed to a run")
        return found

    def ingest(self, artifact: Mapping[str, Any], df: DataFrame | None = None, run_id: str | None = None, **options: Any) -> bool:
        """Ingest an artifact's file, or ``df`` in its place, into the table of its key."""
        from loomspan.plans.views import mark_ingested
        from loomspan.sources.sinks import ingest

        run_id = self.attributed_run(artifact, run_id)
        here = [(b.run.get("year"), b.run.get("iteration")) for b in self.active if b.run["id"] == run_id]
        run = here[0] if here else self.catalog.read("run").where(F.col("id") == run_id).select("year", "iteration").head()
        df = df if df is not None else load(self.spark, artifact["container_uri"], artifact["driver"])
        done = ingest(self.catalog, artifact["key"], df, run_id, artifact["id"], *(run or (None, None)), content_hash=artifact.get("hash"), **options)
        mark_ingested(self.catalog, artifact["id"], artifact["key"])
        return done

    def log_dataframe(self, df: DataFrame, key: str, *, run_id: str | None = None, path: str | None = None, driver: str = "parquet", direction: str = "output", meta: Mapping[str, Any] | None = None, ingest: bool = False, profile: bool = False, **options: Any) -> dict:
        """Write a frame under the run's outputs (or to ``path``), record it, and on wish ingest it and keep its schema profile."""
        from loomspan.sources.sinks import write_single

        run_id = run_id or (self.active[-1].run["id"] if self.active else None)
        at = path or f"{self.root}/outputs/{run_id or 'loose'}/{key}.{driver}"
        write_single(df, at, driver, overwrite=True)
        made = self.log_artifact(at, key, run_id=run_id, direction=direction, driver=driver, meta=meta)
        if profile:
            from loomspan.operators.schemas import observe

            observe(self.catalog, made, df)
        if ingest:
            self.ingest(made, df, run_id, **options)
        return made

    @contextmanager
    def trace(self, name: str, *, config: Mapping[str, Any] | None = None, inputs: Mapping[str, str] | None = None, outputs: Sequence[str] = (), cache_mode: str = "reuse", code: Callable | str | None = None, **fields: Any) -> Iterator[Trace]:
        """A block as a run: what it logs belongs to it. On a cache hit ``hit`` tells so, and the block may skip its work.

        ``code`` is the function or text that stands for the block's code; ``fields`` are columns of the run.
        """
        block = self.begin(name, config=config, inputs=inputs, outputs=outputs, cache_mode=cache_mode, code=code, **fields)
        try:
            yield block
        except Exception as e:
            self.end(block, "failed", str(e))
            raise
        self.end(block)

    def begin(self, name: str, *, config: Mapping[str, Any] | None = None, inputs: Mapping[str, str] | None = None, outputs: Sequence[str] = (), cache_mode: str = "reuse", code: Callable | str | None = None, **fields: Any) -> Trace:
        """Open a run; end it with :meth:`end`."""
        if cache_mode not in MODES:
            raise ValueError(f"cache_mode must be one of {', '.join(MODES)}")
        with self.lock:
            given = {k: self._input(k, ref) for k, ref in (inputs or {}).items()}
        code_id = code_hash(code) if callable(code) else sha256(code or name)
        parts = self._identity(config or {}, name, given, code_id, fields.get("year"), fields.get("iteration"))
        hit = self._cached(*parts, outputs) if cache_mode == "reuse" else None
        run = self._opened(name, parts, fields)
        self.active.append(block := Trace(self, run, {k: a for k, (a, _) in given.items()}, config or {}, outputs, cache_mode, hit))
        self._emit("start", run)
        return block

    def end(self, block: Trace, status: str = "completed", error: str | None = None) -> RunResult:
        """Close an open run. A completed one must have logged its declared outputs; on a cache hit they are the earlier run's."""
        self.active.remove(block)
        made = {a["key"]: a["container_uri"] for a in block.logged}
        lost = [k for k in block.outputs if k not in made] if status == "completed" and not block.hit else []
        if lost:
            status, error = "failed", f"run {block.run['model_name']} gave no output {', '.join(lost)}"
        linked = {a["id"] for a in block.logged}
        reused = [] if not block.hit or made else [r.artifact_id for r in self.catalog.read("run_artifact_link").where((F.col("run_id") == block.hit[0]["id"]) & (F.col("direction") == "output")).collect()]
        meta = {**({"error": error} if error else {}), **({"cached_run_id": block.hit[0]["id"]} if block.hit else {})}
        if block.cache_mode != "readonly":
            links = [(a["id"], "input") for a in block.inputs.values()] + [(a, "output") for a in reused if a not in linked]
            if links:
                self.catalog.append("run_artifact_link", [{"run_id": block.run["id"], "artifact_id": a, "direction": d, "is_implicit": False, "created_at": now()} for a, d in links])
            self.catalog.append("run", [block.run | {"status": status, "ended_at": now(), "updated_at": now(), "meta": canonical_json(meta)}])
            if block.config:
                self.log_facet(block.run["id"], block.run["model_name"], block.config)
        self._emit("complete" if status == "completed" else "failed", block.run)
        if lost:
            raise ValueError(error)
        return RunResult(block.run["id"], block.hit is not None, made or (block.hit[1] if block.hit else {}), meta)

    @staticmethod
    def _identity(config: Mapping, model: str, given: Mapping, code_id: str, year: Any = None, iteration: Any = None, epoch: int | None = None, version: int | None = None) -> tuple[str, str, str]:
        """The hashes of configuration, inputs and code."""
        inputs = sha256("|".join(sorted(s for _, s in given.values()))) if given else sha256("empty_inputs")
        return run_config_hash(config, model, year, iteration, epoch, version), inputs, code_id

    @staticmethod
    def _opened(model: str, parts: tuple[str, str, str], fields: Mapping[str, Any]) -> dict:
        config_id, input_id, code_id = parts
        run = {"id": f"{model}_{uuid.uuid4().hex[:10]}", "status": "running", "model_name": model, "config_hash": config_id, "git_hash": code_id, "input_hash": input_id, **fields}
        return run | {"signature": sha256(f"code:{code_id}|conf:{config_id}|in:{input_id}"), "started_at": now(), "created_at": now(), "updated_at": now()}

    def _input(self, key: str, ref: str) -> tuple[dict, str]:
        """The artifact of an input (logged if it is a new file) and its signature."""
        known = self.artifact(ref)
        if known is None:
            if not files.exists(self.spark, ref):
                raise FileNotFoundError(f"input {key}: {ref}")
            content = file_hash(ref, self.fast_hash, self.spark)
            same = self.catalog.read("artifact").where((F.col("container_uri") == ref) & (F.col("hash") == content)).limit(1).collect()
            known = same[0].asDict() if same else {"id": str(uuid.uuid4()), "key": key, "container_uri": ref, "driver": driver_for(ref), "hash": content, "created_at": now()}
            if not same:
                self.catalog.append("artifact", [known])
        if known.get("run_id"):
            producer = self.catalog.read("run").where(F.col("id") == known["run_id"]).select("signature").head()
            made = f"sig:{producer.signature}" if producer and producer.signature else f"run:{known['run_id']}"
            return known, "|".join([f"driver:{known['driver']}", f"key:{known['key']}", made, *([f"hash:{known['hash']}"] if known.get("hash") else [])])
        return known, f"driver:{known['driver']}|container_uri:{known['container_uri']}|file:{known['hash']}"

    def _cached(self, config: str, inputs: str, code: str, wanted: Sequence[str], validate: str = "eager") -> tuple[dict, dict[str, str]] | None:
        """The newest completed run of this identity with all wanted outputs. ``eager`` asks that each is in its place or ingested; ``lazy`` doesn't look."""
        found = run_queries.cache_matches(self.catalog.read("run"), config, inputs, code).limit(1).collect()
        if not found:
            return None
        links = self.catalog.read("run_artifact_link").where((F.col("run_id") == found[0].id) & (F.col("direction") == "output")).select(F.col("artifact_id").alias("id"))
        rows = self.catalog.read("artifact").join(links, "id", "left_semi").select("key", "container_uri", ingested().alias("ingested")).collect()
        made = {r.key: r.container_uri for r in rows}
        whole = all(k in made for k in wanted) and (validate == "lazy" or all(r.ingested or files.exists(self.spark, r.container_uri) for r in rows))
        return (found[0].asDict(), made) if whole else None

    def run(
        self,
        fn: Callable[..., DataFrame | Mapping[str, DataFrame] | None] | str,
        name: str | None = None,
        *,
        config: Mapping[str, Any] | None = None,
        inputs: Mapping[str, str] | None = None,
        outputs: Sequence[str] = (),
        year: int | None = None,
        iteration: int | None = None,
        stage: str | None = None,
        phase: str | None = None,
        tags: Sequence[str] = (),
        facet: Mapping[str, Any] | None = None,
        parent_run_id: str | None = None,
        cache_mode: str = "reuse",
        cache_epoch: int | None = None,
        extra_code: Iterable[str] = (),
        description: str | None = None,
        code_identity: str | None = None,
        depends_on: Iterable[str] = (),
        identity_inputs: Mapping[str, str] | None = None,
        cache_hydration: str = "metadata",
        materialize_to: str | None = None,
        archives: Iterable[str] = (),
        validate_cached_outputs: str = "eager",
        stage_inputs_to: str | None = None,
    ) -> RunResult:
        """Call ``fn(config=..., <input key>=DataFrame, ...)`` unless a completed run of the same code, configuration and inputs
        has outputs that are all there.

        ``fn`` returns a DataFrame for its only output or one per output key; they are written as Parquet. ``overwrite``
        always runs; ``readonly`` runs without recording. A step that fails is recorded as failed and raises.

        ``depends_on`` are files and ``identity_inputs`` named files that make part of the identity but are no inputs.
        ``cache_hydration`` says what a hit brings to ``materialize_to``: nothing (metadata), the declared outputs, or all;
        ``inputs-missing`` instead rebuilds inputs that are gone, from ``archives`` or ingested rows, before a step runs.
        ``stage_inputs_to`` is a folder that inputs are copied to and read from.
        """
        if cache_mode not in MODES:
            raise ValueError(f"cache_mode must be one of {', '.join(MODES)}")
        if cache_hydration not in HYDRATION or cache_hydration.startswith("outputs") and not materialize_to:
            raise ValueError(f"cache_hydration must be one of {', '.join(HYDRATION)}; outputs need materialize_to")
        fn = imported(fn)
        declared: Step = getattr(fn, "step", Step())
        model = name or declared.name or fn.__name__
        outputs, tags = list(outputs) or list(declared.outputs), [*tags, *declared.tags]
        with self.lock:
            given = {k: self._input(k, ref) for k, ref in (inputs or {}).items()}
        more = {f"depends_on:{p}": file_hash(p, self.fast_hash, self.spark) for p in depends_on} | {f"identity:{k}": file_hash(p, self.fast_hash, self.spark) for k, p in (identity_inputs or {}).items()}
        code_id = code_hash(fn, extra_code) if code_identity is None else code_version(fn, code_identity, extra_code)
        parts = self._identity({**(config or {}), **({"__files__": more} if more else {})}, model, given, code_id, year, iteration, cache_epoch, declared.cache_version)
        if cache_mode == "reuse":
            hit = self._cached(*parts, outputs, validate_cached_outputs)
            if hit:
                return RunResult(hit[0]["id"], True, hit[1], self._hydrated(hit[0]["id"], cache_hydration, outputs, materialize_to, archives))
        fields = {"parent_run_id": parent_run_id, "description": description, "year": year, "iteration": iteration, "stage": stage, "phase": phase, "tags": tags}
        run = self._opened(model, parts, fields)
        meta = self._miss(run) if cache_mode == "reuse" else {}
        self._emit("start", run)
        made: dict[str, str] = {}
        try:
            places = self._placed({k: a for k, (a, _) in given.items()}, cache_hydration == "inputs-missing", archives, stage_inputs_to)
            frames = {k: load(self.spark, places[k], a["driver"]) for k, (a, _) in given.items()}
            result = fn(config=dict(config or {}), **frames)
            produced = {} if result is None else dict(result) if isinstance(result, Mapping) else {(outputs or [model])[0]: result}
            lost = [k for k in outputs if k not in produced]
            if lost:
                raise ValueError(f"step {model} gave no output {', '.join(lost)}")
            for key, df in produced.items():
                made[key] = f"{self.root}/outputs/{run['id']}/{key}.parquet"
                df.write.parquet(made[key])
        except Exception as e:
            self._finish(run | {"status": "failed"}, meta | {"error": str(e)[:2000]}, given, {}, config, facet, cache_mode)
            files.remove(self.spark, f"{self.root}/outputs/{run['id']}")
            self._emit("failed", run)
            raise
        self._finish(run | {"status": "completed"}, meta, given, made, config, facet, cache_mode)
        self._emit("complete", run)
        return RunResult(run["id"], False, made, meta)

    def _hydrated(self, run_id: str, how: str, outputs: Sequence[str], to: str | None, archives: Iterable[str]) -> dict:
        """What a cache hit brought to ``to``, by key."""
        if not how.startswith("outputs"):
            return {}
        from loomspan.runtime.recovery import hydrate

        return {"hydrated": hydrate(self.catalog, run_id, to, None if how == "outputs-all" else outputs, archives=archives)}

    def _placed(self, inputs: Mapping[str, dict], rebuild: bool, archives: Iterable[str], stage_to: str | None) -> dict[str, str]:
        """Where each input is read: its place, rebuilt there if it is gone and that is wished, or its copy in the staging folder."""
        from loomspan.runtime.recovery import restore, stage_inputs

        for a in inputs.values():
            if rebuild and not files.exists(self.spark, a["container_uri"]):
                restore(self.catalog, a, archives)
        places = {k: a["container_uri"] for k, a in inputs.items()}
        return stage_inputs(self.spark, places, stage_to) if stage_to else places

    def _miss(self, run: dict) -> dict:
        """Why there was no cache hit, against the closest of the recent completed runs of the model."""
        one = self.spark.createDataFrame([[run[c] for c in ("id", "model_name", *run_queries.COMPONENTS)]], "id string, model_name string, config_hash string, input_hash string, git_hash string")
        row = run_queries.explain_misses(one, self.catalog.read("run")).head()
        return {"cache_miss": {"reason": row.reason, "candidate_run_id": row.candidate_run_id, "confidence": row.confidence}}

    def _finish(self, run: dict, meta: dict, given: dict, made: dict[str, str], config: Mapping | None, facet: Mapping | None, mode: str) -> None:
        if mode == "readonly":
            return
        run |= {"ended_at": now(), "updated_at": now(), "meta": canonical_json(meta)}
        artifacts = [{"id": str(uuid.uuid4()), "key": k, "container_uri": p, "driver": "parquet", "hash": file_hash(p, self.fast_hash, self.spark), "run_id": run["id"], "created_at": now()} for k, p in made.items()]
        links = [{"run_id": run["id"], "artifact_id": a["id"], "direction": "output", "is_implicit": False, "created_at": now()} for a in artifacts]
        links += [{"run_id": run["id"], "artifact_id": a["id"], "direction": "input", "is_implicit": False, "created_at": now()} for a, _ in given.values()]
        with self.lock:
            self.catalog.append("run", [run])
            if artifacts:
                self.catalog.append("artifact", artifacts)
            if links:
                self.catalog.append("run_artifact_link", links)
            shown = facet if facet is not None else config
            if shown:
                self.log_facet(run["id"], run["model_name"], shown)

    @contextmanager
    def scenario(self, name: str, **fields: Any) -> Iterator[Scenario]:
        """A run that holds the runs of its steps; it fails if the block does."""
        run = {"id": f"{name}_{uuid.uuid4().hex[:10]}", "model_name": name, "started_at": now(), "created_at": now(), "updated_at": now(), **fields}
        status = "failed"
        try:
            yield Scenario(self, run["id"])
            status = "completed"
        finally:
            self.catalog.append("run", [run | {"status": status, "ended_at": now(), "updated_at": now()}])


@dataclass
class Trace:
    """An open run: its row, inputs and what it logged. ``hit`` is the earlier run and its outputs, or None."""

    tracker: Tracker
    run: dict
    inputs: dict[str, dict]
    config: Mapping[str, Any]
    outputs: Sequence[str]
    cache_mode: str
    hit: tuple[dict, dict[str, str]] | None
    logged: list[dict] = field(default_factory=list)

    def load(self, key: str) -> DataFrame:
        """An input of the run, or an output of the earlier run of a hit."""
        if key in self.inputs:
            return load(self.tracker.spark, self.inputs[key]["container_uri"], self.inputs[key]["driver"])
        if self.hit and key in self.hit[1]:
            return load(self.tracker.spark, self.hit[1][key])
        raise KeyError(key)

    def log_dataframe(self, df: DataFrame, key: str, **options: Any) -> dict:
        self.logged.append(self.tracker.log_dataframe(df, key, run_id=self.run["id"], **options))
        return self.logged[-1]

    def log_artifact(self, path: str, key: str, **options: Any) -> dict:
        self.logged.append(self.tracker.log_artifact(path, key, run_id=self.run["id"], **options))
        return self.logged[-1]


def run_spec(tracker: Tracker, spec: Mapping[str, Any]) -> RunResult:
    """Run what a mapping says: ``fn`` (a function or module:function) and the arguments of :meth:`Tracker.run`."""
    return tracker.run(**{"name": None, **spec})


@dataclass
class Scenario:
    """The steps of one scenario share its id as parent, and find each other's outputs by key."""

    tracker: Tracker
    run_id: str
    known: dict[str, str] = field(default_factory=dict)

    def run(self, fn: Callable, name: str | None = None, *, inputs: Mapping[str, str] | Sequence[str] | None = None, **options: Any) -> RunResult:
        refs = dict(inputs) if isinstance(inputs, Mapping) else {k: k for k in inputs or ()}
        done = self.tracker.run(fn, name, inputs={k: self.known.get(r, r) for k, r in refs.items()}, parent_run_id=self.run_id, **options)
        links = self.tracker.catalog.read("run_artifact_link").where((F.col("run_id") == done.run_id) & (F.col("direction") == "output")).select(F.col("artifact_id").alias("id"))
        self.known |= {r.key: r.id for r in self.tracker.catalog.read("artifact").join(links, "id", "left_semi").select("key", "id").collect()}
        return done

    def map_runs(self, rows: Iterable[Mapping[str, Any]], fn: Callable | str, name_template: str, max_workers: int = 4, cancel_on_failure: bool = True, **options: Any) -> list[RunResult]:
        """One run per row of parameters, several at a time as Spark jobs of one application; results in the order of the rows."""
        with ThreadPoolExecutor(max_workers) as pool:
            jobs = [pool.submit(run_spec, self.tracker, {"fn": imported(fn), "name": name_template.format(**r), "config": dict(r), "parent_run_id": self.run_id, **options}) for r in rows]
            try:
                return [j.result() for j in jobs]
            except Exception:
                if cancel_on_failure:
                    for j in jobs:
                        j.cancel()
                raise
