"""Tracked runs, containers, configuration plans, bindings and catalog versions."""

import json
import subprocess
from contextlib import nullcontext
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import files
from loomspan.operators import artifacts, facets, lineage, runs, runset, schemas
from loomspan.plans import admin
from loomspan.plans.catalog import Catalog, WriteConflict
from loomspan.runtime import identity, recovery
from loomspan.runtime.bindings import BindingBuilder
from loomspan.runtime.tracker import Tracker, run_spec
from loomspan.sources import config_plans, containers, drivers, sinks

T0 = datetime(2025, 1, 1)


def values(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.fixture
def tracker(spark, tmp_path):
    return Tracker(spark, f"file://{tmp_path}/t")


# --- the catalog


def test_readers_keep_their_version(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.append("run", [{"id": f"r{i}", "status": "running"} for i in range(3)])
    before = c.read("run")
    c.upsert("run", [{"id": "r1", "status": "completed"}])
    c.replace("artifact", c.read("artifact"))
    assert values(before, "id", "status") == {(f"r{i}", "running") for i in range(3)}
    assert values(c.read("run"), "id", "status") == {("r0", "running"), ("r1", "completed"), ("r2", "running")}
    c.drop("artifact")
    assert c.tables() == ["run"] and c.vacuum("run") >= 1 and c.read("run").count() == 3


def test_an_upsert_rewrites_only_parts_with_its_keys(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/c")
    for n in "abc":
        c.append("run", [{"id": f"{n}{i}"} for i in range(2)])
    old = {p["part"] for p in c._parts("run")[1]}
    c.upsert("run", [{"id": "b1", "status": "failed"}, {"id": "new"}])
    kept = {p["part"] for p in c._parts("run")[1]} & old
    assert len(kept) == 2 and c.read("run").count() == 7 and values(c.read("run").where("status = 'failed'"), "id") == {"b1"}


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = Catalog(spark, f"{tmp_path}/c"), Catalog(spark, f"{tmp_path}/c")
    one.append("run", [{"id": "a"}])
    seen = two._parts("run")
    one.append("run", [{"id": "b"}])
    with pytest.raises(WriteConflict):
        two._commit("run", *seen)
    stale = iter([seen])
    fresh = two._parts
    monkeypatch.setattr(two, "_parts", lambda table: next(stale, None) or fresh(table))
    two.append("run", [{"id": "c"}])
    assert values(one.read("run"), "id") == {"a", "b", "c"}


def test_new_columns_rewrite_nothing(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/c")
    sinks.ingest(c, "t", spark.createDataFrame([(1,)], "x int"), "r1", "a1")
    first = c._parts("t")[1]
    sinks.ingest(c, "t", spark.createDataFrame([("two", 2.5)], "x string, y double"), "r2", "a2")
    assert c._parts("t")[1][:1] == first
    assert values(c.read("t"), "x", "y", "prov_run_id") == {("1", None, "r1"), ("two", 2.5, "r2")}
    assert c.drop_parts("t", "run_id", ["r1"]) == 1 and values(c.read("t"), "x") == {"two"}


def test_export_takes_all_that_hangs_on_runs(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/c")
    c.append("run", [{"id": "r"}, {"id": "other"}])
    c.append("artifact", [{"id": "a", "key": "k", "run_id": "r", "content_id": "c1"}, {"id": "b", "key": "k", "run_id": "other", "content_id": "c2"}])
    c.append("artifact_content", [{"content_id": "c1", "content_hash": "h"}, {"content_id": "c2", "content_hash": "h2"}])
    c.append("run_config_kv", [{"run_id": "r", "facet_id": "f", "namespace": "m", "key": "x"}])
    c.append("config_facet", [{"facet_id": "f", "namespace": "m", "facet": "{}"}, {"facet_id": "g", "namespace": "m", "facet": "{}"}])
    c.append("artifact_kv", [{"artifact_id": "a", "facet_id": "f2", "namespace": "m", "key_path": "x"}])
    c.append("artifact_facet", [{"facet_id": "f2", "namespace": "m", "facet": "{}"}])
    c.append("artifact_schema_observation", [{"id": "o", "artifact_id": "a", "schema_id": "s"}])
    c.append("artifact_schema_relation", [{"schema_id": "s", "field_name": "x", "target_table": "t"}, {"schema_id": "z", "field_name": "x"}])
    shard = admin.export(c, ["r"], f"{tmp_path}/shard")
    assert values(shard.read("artifact_content"), "content_id") == {"c1"} and values(shard.read("config_facet"), "facet_id") == {"f"}
    assert values(shard.read("artifact_facet"), "facet_id") == {"f2"} and values(shard.read("artifact_schema_relation"), "schema_id") == {"s"}
    fresh = Catalog(spark, f"{tmp_path}/fresh")
    done = admin.merge(fresh, shard)
    assert {t: done[t] for t in ("run", "artifact", "artifact_content", "config_facet", "artifact_facet", "artifact_schema_relation")} == dict.fromkeys(("run", "artifact", "artifact_content", "config_facet", "artifact_facet", "artifact_schema_relation"), 1)


# --- tracked runs


def test_trace_block(spark, tracker, tmp_path):
    (tmp_path / "in.csv").write_text("id,v\n1,2\n")
    with tracker.trace("blk", config={"k": 1}, inputs={"table": f"{tmp_path}/in.csv"}, outputs=["doubled"], code="v1", year=2030) as t:
        assert t.hit is None
        t.log_dataframe(t.load("table").selectExpr("id", "v * 2 AS v"), "doubled", ingest=True, profile=True)
    row = tracker.catalog.read("run").head()
    assert (row.status, row.year) == ("completed", 2030) and values(tracker.catalog.read("run_config_kv"), "key", "value_num") == {("k", 1.0)}
    assert values(tracker.catalog.read("doubled"), "v", "prov_year", "prov_run_id") == {(4, 2030, row.id)}
    assert tracker.catalog.read("artifact_schema_field").count() == 2
    with tracker.trace("blk", config={"k": 1}, inputs={"table": f"{tmp_path}/in.csv"}, outputs=["doubled"], code="v1", year=2030) as t:
        assert t.hit[0]["id"] == row.id and t.load("doubled").head().v == 4
    assert tracker.catalog.read("run_artifact_link").where("direction = 'output'").count() == 2
    with pytest.raises(ValueError, match="gave no output"):
        with tracker.trace("blk", outputs=["nothing"], cache_mode="overwrite"):
            pass
    with pytest.raises(RuntimeError, match="boom"):
        with tracker.trace("blk", cache_mode="overwrite"):
            raise RuntimeError("boom")
    assert tracker.catalog.read("run").where("status = 'failed'").count() == 2 and not tracker.active
    with pytest.raises(KeyError):
        t.load("unknown")


def test_attribution_and_facet_parsers(spark, tracker, tmp_path):
    (tmp_path / "skims_2030.csv").write_text("a,b\n1,2\n")
    tracker.register_facet_parser("skims", lambda k: {"family": "skims"})
    tracker.register_facet_parser("skims_", lambda k: {"family": "skims", "year": int(k.split("_")[1])})
    loose = tracker.log_artifact(f"{tmp_path}/skims_2030.csv", "skims_2030")
    assert values(tracker.catalog.read("artifact_kv"), "key_path", "value_str", "value_num") == {("family", "skims", None), ("year", None, 2030.0)}
    with pytest.raises(RuntimeError, match="attributed"):
        tracker.ingest(loose)
    with tracker.trace("t") as t:
        assert tracker.attributed_run(loose) == t.run["id"] and tracker.attributed_run(loose, "given") == "given"
        made = t.log_artifact(f"{tmp_path}/skims_2030.csv", "out")
    assert tracker.attributed_run(made) == t.run["id"]
    assert tracker.ingest(made) and not tracker.ingest(made)
    shown = facets.config_facets(tracker.catalog.read("artifact_facet"))
    assert {json.loads(r.facet)["year"] for r in shown.collect()} == {2030}


def add(config, table):
    return table.select((F.col("v") + config["n"]).alias("v"))


def test_identity_files_hydration_and_staging(spark, tracker, tmp_path):
    (tmp_path / "in.csv").write_text("v\n1\n")
    (tmp_path / "lib.txt").write_text("one")
    call = {"fn": add, "name": "add", "config": {"n": 1}, "inputs": {"table": f"{tmp_path}/in.csv"}, "outputs": ["sum"], "depends_on": [f"{tmp_path}/lib.txt"]}
    first = run_spec(tracker, {**call, "stage_inputs_to": f"{tmp_path}/staged"})
    assert (tmp_path / "staged" / "in.csv").exists() and not first.cache_hit
    hit = run_spec(tracker, {**call, "cache_hydration": "outputs-requested", "materialize_to": f"{tmp_path}/h"})
    assert hit.cache_hit and hit.meta == {"hydrated": {"sum": "copied"}} and drivers.load(spark, f"{tmp_path}/h/sum.parquet").head().v == 2
    (tmp_path / "lib.txt").write_text("two")
    assert not run_spec(tracker, call).cache_hit
    with pytest.raises(ValueError, match="cache_hydration"):
        run_spec(tracker, {**call, "cache_hydration": "outputs-all"})
    recovery.archive(tracker.catalog, first.run_id, f"{tmp_path}/archive")
    made = recovery.outputs_of(tracker.catalog, first.run_id)[0]
    files.remove(spark, made["container_uri"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tracker.run(add, "again", config={"n": 5}, inputs={"table": made["id"]}, outputs=["sum"])
    done = tracker.run(add, "again", config={"n": 5}, inputs={"table": made["id"]}, outputs=["sum"], cache_hydration="inputs-missing", archives=[f"{tmp_path}/archive"])
    assert drivers.load(spark, done.outputs["sum"]).head().v == 7
    assert tracker.run(add, "again", config={"n": 5}, inputs={"table": made["id"]}, outputs=["sum"], validate_cached_outputs="lazy").cache_hit


def test_sweep_by_import_string(spark, tracker):
    with tracker.scenario("s") as s:
        done = s.map_runs([{"n": 2}, {"n": 3}], "test_runtime:numbers", "n_{n}", outputs=["x"])
    assert [drivers.load(spark, d.outputs["x"]).count() for d in done] == [2, 3]
    with pytest.raises(ValueError, match="module:function"):
        run_spec(tracker, {"fn": "numbers"})


def numbers(config):
    from pyspark.sql import SparkSession

    return SparkSession.active().range(config["n"]).toDF("x")


# --- identities and bindings


def test_code_identity(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    with pytest.raises(identity.CodeIdentityError):
        identity.git_version(str(tmp_path))
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    clean = identity.git_version(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 2\n")
    assert len(clean) == 40 and identity.git_version(str(tmp_path)).startswith(f"{clean}-dirty-")
    assert identity.callable_hash(add, "source") != identity.callable_hash(add, "module") == identity.callable_hash(numbers, "module")
    assert identity.callable_hash(add, "source", ["a.py"], str(tmp_path)) != identity.callable_hash(add, "source", ["gone.py"], str(tmp_path))
    with pytest.raises(identity.CodeIdentityError):
        identity.callable_hash(len, "source")
    identity.check_depth({"a": [1]}, 3)
    with pytest.raises(ValueError, match="deeper"):
        identity.check_depth({"a": [1]}, 2)
    assert identity.keep_by(["*.csv"])("a.csv") and not identity.keep_by(["*.csv"])("a.txt") and identity.keep_by(None) is None


def test_bindings():
    build = lambda uri, **meta: BindingBuilder("step", "contract").bind("x", {"id": "a", "hash": "h", "container_uri": uri}).with_metadata(**meta)
    one = build("/here", k=1).admit("x", "hash:h").with_diagnostics(note="n").freeze()
    assert one.digest() == build("/there", k=1).freeze().digest() != build("/here", k=2).freeze().digest()
    assert json.loads(one.evidence())["inputs"]["x"]["source"] == "/here" and one.row("r", "i", T0)["binding_hash"] == one.digest()
    with pytest.raises(TypeError):
        one.inputs["y"] = 1
    for broken, match in ((build("u").admit("y", "hash:h"), "not bound"), (build("u").admit("x", "hash:other"), "was seen"), (build("u").admit("x", "hash:h", "hash:h"), "go together")):
        with pytest.raises(ValueError, match=match):
            broken.freeze()
    with pytest.raises(ValueError, match="no content identity"):
        BindingBuilder("s", "c").bind("x", {"id": "a"})


# --- containers and configuration plans


class Array:
    def __init__(self, data, dims=(), attrs=None):
        self.data, self.dims, self.attrs = np.asarray(data), dims, attrs or {}
        self.shape, self.dtype = self.data.shape, self.data.dtype

    def __getitem__(self, at):
        return self.data[at]


def test_metadata_of_open_stores():
    store = SimpleNamespace(data_vars={"t": Array(np.zeros((2, 3)), ("y", "x"), {"unit": "K"})}, coords={"x": Array([1, 2, 3], ("x",))})
    got = list(containers.variable_rows(store))
    assert [(r["variable_name"], r["variable_type"], r["dims"], r["shape"], r["attributes"]) for r in got] == [("t", "data", ["y", "x"], [2, 3], '{"unit": "K"}'), ("x", "coordinate", ["x"], [3], "{}")]
    group = {"data": {"am": Array(np.ones((4, 5)))}, "lookup": {"deep": {"zone": Array([1, 2])}}}
    assert [(r["matrix_name"], r["matrix_path"], r["n_rows"], r["n_cols"]) for r in containers.matrix_rows(group)] == [("am", "/data/am", 4, 5), ("zone", "/lookup/deep/zone", 2, None)]
    tables = list(containers.h5_tables(group, lambda p: p.startswith("data"), chunk_rows=3))
    assert [t["table_path"] for t in tables] == ["data/am"] and tables[0]["table_hash"] == containers.dataset_hash(Array(np.ones((4, 5)))) != containers.dataset_hash(Array(np.zeros((4, 5))))
    rows = containers.child_artifacts({"id": "c", "key": "store", "container_uri": "/x.h5", "run_id": "r"}, tables, {"data/am": containers.Child(description="morning")})
    assert rows[0]["key"] == "store_data_am" and rows[0]["parent_artifact_id"] == "c" and rows[0]["run_id"] == "r" and json.loads(rows[0]["meta"])["description"] == "morning"


def test_files_are_read_by_executors(spark, tmp_path):
    paths = spark.createDataFrame([("/a",), ("/b",)], "path string")
    got = containers.rows_of_files(paths, lambda p: iter([{"table_path": p + "t", "shape": [1], "dtype": "i8", "table_hash": None}]), containers.H5_TABLES)
    assert values(got, "path", "table_path") == {("/a", "/at"), ("/b", "/bt")}
    with pytest.raises(Exception, match="/a: no such"):
        containers.rows_of_files(paths.limit(1), lambda p: (_ for _ in ()).throw(OSError("no such")), containers.H5_TABLES).collect()


def test_arrays_are_read_in_slabs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drivers, "SLAB_CELLS", 10)
    data = np.arange(21.0).reshape(7, 3)
    np.save(tmp_path / "m.npy", data)
    at = str(tmp_path / "m.npy")
    parts = drivers.ranges("m", 7, 3)
    assert parts == [("m", 0, 3), ("m", 3, 6), ("m", 6, 7)] and drivers.ranges("m", 0, 3) == []
    got = drivers.slabs(spark, parts, lambda n, a, b: drivers.matrix_cells(n, np.load(at)[a:b], a), "matrix string, row long, col long, value double")
    assert values(got, "row", "col", "value") == {(i, j, data[i, j]) for i in range(7) for j in range(3)}


def test_geojson(spark, tmp_path):
    feature = lambda kind, coords, **props: {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}
    doc = {"type": "FeatureCollection", "features": [feature("Point", [1.5, -2], a=1), feature("Polygon", [[[0, 0], [10, 0], [10, 5e0], [0, 0]]], b="x"), {"type": "Feature", "properties": None, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": [], "crs": {"properties": {"name": "EPSG:3857"}}}')
    got = {r.path.rpartition("/")[2]: r for r in containers.metadata_rows(spark, [f"{tmp_path}/a.geojson", f"{tmp_path}/b.geojson"], "geojson").collect()}
    a, b = got["a.geojson"], got["b.geojson"]
    assert (list(a.bounds), a.crs, a.feature_count, a.geometry_types, a.column_names) == ([0.0, -2.0, 10.0, 5.0], "OGC:CRS84", 3, ["Point", "Polygon"], ["a", "b", "geometry"])
    assert (b.crs, b.feature_count, b.geometry_types) == ("EPSG:3857", 0, [])


class Adapter:
    model_name, adapter_version = "toy", "1"

    def __init__(self, at):
        self.at = at

    def discover(self, roots, *, strict=False):
        return config_plans.CanonicalConfig(tuple(roots), (f"{self.at}/s.csv",), f"{self.at}/s.csv")

    def canonicalize(self, config, *, strict=False):
        rows = config_plans.IngestSpec("constants", lambda run: [{"name": "n", "value": 3.0}], "name string, value double", "settings")
        return config_plans.Canonicalized([config_plans.ArtifactSpec(config.primary, "settings")], [rows], {"settings": "h1"})

    def build_facet(self, config, *, facet_spec):
        return {k: 3 for k in facet_spec["keys"]}


def test_config_plan(spark, tracker, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,2\n")
    plan = config_plans.prepare(Adapter(tmp_path), [tmp_path], facet_spec={"keys": ["n"]})
    assert plan.ok and plan.signature == config_plans.prepare(Adapter(tmp_path), ["/elsewhere"]).signature
    assert config_plans.run_config(plan, {"a": 1})["__config_plan__"]["identity_hash"] == plan.identity_hash
    made = config_plans.apply(tracker, plan, "r1")
    assert set(made) == {"settings"} and values(tracker.catalog.read("constants"), "name", "value", "prov_run_id") == {("n", 3.0, "r1")}
    assert values(tracker.catalog.read("run_config_kv"), "run_id", "key", "namespace") == {("r1", "n", "toy")}
    broken = config_plans.validate(config_plans.ConfigPlan("toy", plan.config, config_plans.Canonicalized([config_plans.ArtifactSpec("", "k", "sideways")] * 2)))
    assert len(broken.problems) == 6
    with pytest.raises(ValueError, match="occurs 2 times"):
        config_plans.apply(tracker, broken, "r1")
    bare = SimpleNamespace(model_name="bare", discover=Adapter(tmp_path).discover, canonicalize=Adapter(tmp_path).canonicalize)
    with pytest.raises(ValueError, match="no facets"):
        config_plans.prepare(bare, [], facet_spec={})


# --- lookups


def test_schemas_of_contents(spark, tracker):
    c = tracker.catalog
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    c.append("artifact", [{"id": i, "key": "k", "hash": "h", "content_id": "c"} for i in ("a1", "a2")])
    first = schemas.observe(c, {"id": "a1", "key": "k", "hash": "h"}, df)
    assert schemas.observe(c, {"id": "a2", "key": "k", "hash": "h", "container_uri": "/gone", "driver": "csv"}) == schemas.observe(c, {"id": "a3", "key": "k"}, df) == first
    assert c.read("artifact_schema").count() == 1 and c.read("artifact_schema_observation").count() == 3
    own, rows = schemas.declared_profile("trips", [{"name": "x", "logical_type": "int"}, {"name": "z", "logical_type": "str"}], [{"field_name": "x", "target_table": "persons", "target_field": "id"}])
    for table, listed in rows.items():
        c.append(table, listed)
    assert [tuple(r) for r in schemas.schema_links(c.read("artifact_schema_relation"), c.read("artifact_schema")).collect()] == [(own, "trips", "x", "persons", "id")]
    c.append("artifact_schema_observation", [{"id": "u", "artifact_id": "a1", "schema_id": own, "source": "user_provided", "observed_at": T0}])
    for column, content in (("hash", "h"), ("content_id", "c")):
        assert [(r[column], r.schema_id, r.artifact_id) for r in schemas.observations_by(c.read("artifact_schema_observation"), c.read("artifact"), column).collect()] == [(content, own, "a1")]
    fields = c.read("artifact_schema_field")
    assert values(schemas.schemas_like(fields, ["x"]), "schema_id") == {first, own}
    assert values(schemas.schemas_like(fields, ["z", "x"], compatible=False), "schema_id") == {own}


def test_small_lookups(spark, tmp_path, capsys):
    known = spark.createDataFrame([("a", "h", "csv", T0, "/d/x.csv", None), ("b", "h", "csv", datetime(2026, 1, 1), "file:///d/y", None), ("c", None, "csv", T0, "/d/z", '{"is_ingested": true}'), ("d", "g", "csv", T0, "/d/gone", "{}")], "id string, hash string, driver string, created_at timestamp_ntz, container_uri string, meta string")
    assert values(artifacts.newest_per_hash(known), "hash", "id") == {("h", "b"), ("g", "d")}
    listing = spark.createDataFrame([("file:/d/x.csv",), ("/d/y/part-1.parquet",)], "path string")
    assert values(artifacts.missing_files(known, listing), "id") == {"d"}
    few = spark.createDataFrame([("r1", 2030, T0), ("r2", 2040, datetime(2026, 1, 1))], "id string, year int, created_at timestamp_ntz")
    assert runset.RunSet(few)[0].id == "r2" and runset.RunSet(few)[1].id == "r1"
    for at in (2, -1):
        with pytest.raises(IndexError):
            runset.RunSet(few)[at]
    assert runs.indexed(few, "year")[2030].id == "r1"
    with pytest.raises(ValueError, match="several"):
        runs.indexed(few.withColumn("year", F.lit(1)), "year")
    metric = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = runset.compare_metrics(metric([("a", 2.0), ("b", 0.0), ("l", 1.0)]), metric([("a", 3.0), ("b", 1.0), ("r", 1.0)]), ["metric"], decimals=2)
    assert values(got, "metric", "delta", "ratio") == {("a", 1.0, 1.5), ("b", 1.0, None)}
    lineage.print_tree([{"path": ["a"], "depth": 0, "artifact_id": "a", "run_id": "r"}, {"path": ["a", "b"], "depth": 1, "artifact_id": "b", "run_id": None}], show_run_ids=False)
    assert capsys.readouterr().out == "a\n  b\n"
    (tmp_path / "x.csv").write_text("a\n" + "\n".join(map(str, range(7))))
    assert [len(b) for b in drivers.file_batches(spark, f"{tmp_path}/x.csv", rows=3)] == [3, 3, 1]
    assert sum(len(b) for b in drivers.file_batches(spark, f"{tmp_path}/x.csv", max_rows=4)) == 4
    assert len(drivers.load_pandas(spark, f"{tmp_path}/x.csv", limit=2)) == 2 and drivers.preview(spark, f"{tmp_path}/x.csv").count() == 5


def test_zipped_feed(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "stop_id,stop_lat\nA,1.5\nB,\n")
        z.writestr("__MACOSX/stops.txt", "a,b\n")
        z.writestr("readme.txt", "a, b\n")
    assert drivers.feed_members(spark, f"{tmp_path}/feed.zip") == ["stops.txt"]
    assert values(drivers.read_feed_member(spark, f"{tmp_path}/feed.zip", "stops.txt"), "stop_id", "stop_lat") == {("A", 1.5), ("B", None)}
    with pytest.raises(KeyError), nullcontext():
        drivers.read_feed_member(spark, f"{tmp_path}/feed.zip", "stops.txt", ["nothing"])
