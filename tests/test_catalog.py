import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomspan.operators import arrays, coefficients, gtfs
from loomspan.plans import admin
from loomspan.plans.catalog import Catalog
from loomspan.runtime.tracker import Tracker, step
from loomspan.sources import drivers, manifests, sinks
from loomspan.streaming import landing

T0 = datetime(2025, 1, 1)


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/catalog")
    c.append("run", [{"id": i, "parent_run_id": p, "status": s, "model_name": "m", "created_at": T0} for i, p, s in (("root", None, "completed"), ("child", "root", "completed"), ("other", None, "running"))])
    c.append("artifact", [{"id": f"a{i}", "key": f"k{i}", "run_id": r, "driver": "csv"} for i, r in enumerate(["root", "child", "other"])])
    c.append("run_artifact_link", [{"run_id": r, "artifact_id": a, "direction": d} for r, a, d in (("root", "a0", "output"), ("child", "a0", "input"), ("child", "a1", "output"), ("other", "a1", "input"), ("other", "a2", "output"))])
    c.append("run_config_kv", [{"run_id": "child", "facet_id": "f", "namespace": "m", "key": "x", "value_type": "int", "value_num": 1.0}])
    c.replace("rows", spark.createDataFrame([("root", 1), ("child", 2), ("other", 3)], "prov_run_id string, v int"))
    c.replace("cache", spark.createDataFrame([("h", 1)], "content_hash string, v int"))
    return c


def ids(df, c="id"):
    return {r[c] for r in df.collect()}


def test_upsert_and_versions(spark, catalog):
    catalog.upsert("run", [{"id": "root", "status": "failed"}, {"id": "new", "status": "running"}])
    assert {(r.id, r.status) for r in catalog.read("run").collect()} == {("root", "failed"), ("child", "completed"), ("other", "running"), ("new", "running")}
    assert catalog.read("artifact_facet").count() == 0
    catalog.snapshot(f"{catalog.root}-copy", {"note": 1})
    assert Catalog(spark, f"{catalog.root}-copy").read("run").count() == 4
    catalog.compact("run")
    assert catalog.read("run").count() == 4


def test_purge(catalog):
    plan = admin.purge(catalog, ["root"], dry_run=True)
    assert plan.rows == {"run": 2, "run_artifact_link": 3, "run_config_kv": 1, "run_binding_invocation": 0, "artifact": 1, "artifact_kv": 0, "artifact_schema_observation": 0, "rows": 2}
    assert catalog.read("run").count() == 3
    admin.purge(catalog, ["root"])
    assert ids(catalog.read("run")) == {"other"} and ids(catalog.read("artifact")) == {"a1", "a2"} and ids(catalog.read("rows"), "prov_run_id") == {"other"}
    assert catalog.read("cache").count() == 1 and catalog.read("run_config_kv").count() == 0


def test_export_and_merge(spark, catalog, tmp_path):
    shard = admin.export(catalog, ["root"], f"{tmp_path}/shard")
    assert ids(shard.read("run")) == {"root", "child"} and ids(shard.read("artifact")) == {"a0", "a1"} and shard.path("cache") is None
    with pytest.raises(ValueError, match="both"):
        admin.merge(catalog, shard)
    assert admin.merge(catalog, shard, conflict="skip")["conflicts_detected"] == 2
    empty = Catalog(spark, f"{tmp_path}/empty")
    empty.replace("rows", spark.createDataFrame([("x", 7, "only here")], "prov_run_id string, v bigint, more string"))
    done = admin.merge(empty, shard)
    assert done["rows"] == 2 and done["run"] == 2 and empty.read("rows").columns == ["prov_run_id", "v", "more"]
    narrow = Catalog(spark, f"{tmp_path}/narrow")
    narrow.replace("rows", spark.createDataFrame([("x", True)], "prov_run_id string, v boolean"))
    with pytest.raises(ValueError, match="fit"):
        admin.merge(narrow, shard)


def test_reports(catalog):
    got = {r.metric: r.value for r in admin.inspect(catalog.read("run"), catalog.read("artifact"), catalog.read("run_artifact_link"), catalog.read("run").limit(0)).collect()}
    assert got["runs"] == 3 and got["runs_completed"] == 2 and got["zombie_runs"] == 1 and got["orphaned_artifacts"] == 0 and got["json_db_differences"] == 3
    assert {(r.issue, r.id) for r in admin.doctor(catalog.read("run").where("id <> 'root'"), catalog.read("artifact"), catalog.read("run_artifact_link")).collect()} == {("zombie_run", "other"), ("completed_without_end", "child"), ("dangling_parent", "child"), ("missing_producer", "a0")}


def test_status_and_snapshots(spark, catalog, tmp_path):
    admin.fix_status(catalog, "other", "failed", reason="killed")
    with pytest.raises(ValueError, match="ended"):
        admin.fix_status(catalog, "other", "running")
    assert json.loads(catalog.read("run").where("id = 'other'").head().meta) == {"status_reason": "killed"}
    for r in ("root", "other"):
        admin.write_json(catalog, f"{tmp_path}/json", r)
    (tmp_path / "json" / "bad.json").write_text("{")
    fresh = Catalog(spark, f"{tmp_path}/rebuilt")
    assert admin.rebuild_from_json(fresh, f"{tmp_path}/json", dry_run=True) == 2
    assert admin.rebuild_from_json(fresh, f"{tmp_path}/json", mode="full") == 2
    assert ids(fresh.read("run")) == {"root", "other"} and ids(fresh.read("artifact")) == {"a0", "a1", "a2"}
    assert admin.rebuild_from_json(fresh, f"{tmp_path}/json") == 0


def test_ingest_contract(spark, catalog):
    contract = spark.createDataFrame([], "id bigint, x double").schema
    one = spark.createDataFrame([(1, 2)], "id int, x int")
    assert sinks.ingest(catalog, "t", one, "r1", "a1", 2030, contract=contract, content_hash="h1")
    assert not sinks.ingest(catalog, "t", one, "r2", "a2", contract=contract, content_hash="h1")
    with pytest.raises(sinks.ContractError, match="outside"):
        sinks.ingest(catalog, "t", one.withColumn("y", F.lit(1)), "r1", "a1", contract=contract)
    with pytest.raises(sinks.ContractError, match="fit"):
        sinks.ingest(catalog, "t", one.withColumn("x", F.lit("a")), "r1", "a1", contract=contract)
    assert sinks.ingest(catalog, "t", one.withColumn("y", F.lit("new")), "r3", "a3", contract=contract, additive=True)
    assert {(r.id, r.x, r.y, r.prov_run_id) for r in catalog.read("t").collect()} == {(1, 2.0, None, "r1"), (1, 2.0, "new", "r3")}


def test_materialize(spark, catalog, tmp_path):
    sinks.ingest(catalog, "t", spark.createDataFrame([(1, "a")], "id int, s string"), "r1", "a1")
    for driver in ("csv", "parquet"):
        sinks.materialize(catalog.read("t"), "a1", f"{tmp_path}/out.{driver}", driver)
        assert [tuple(r) for r in drivers.load(spark, f"{tmp_path}/out.{driver}").collect()] == [(1, "a")]
    with pytest.raises(FileExistsError):
        sinks.materialize(catalog.read("t"), "a1", f"{tmp_path}/out.csv", "csv")


def test_drivers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id;v\n1;a\n2;b\n")
    assert drivers.load(spark, f"{tmp_path}/x.csv", sep=";", nrows=1).count() == 1
    with pytest.raises(TypeError, match="no option"):
        drivers.load(spark, f"{tmp_path}/x.csv", colour="red")
    with pytest.raises(ValueError, match="no driver"):
        drivers.driver_for("x.unknown")
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert drivers.load(spark, f"{tmp_path}/x.json").agg(F.sum("a")).head()[0] == 3
    hot = spark.createDataFrame([("a1", 1)], "prov_artifact_id string, v int")
    assert drivers.load_artifact(spark, f"{tmp_path}/gone.csv", "csv", hot, "a1").count() == 1
    with pytest.raises(FileNotFoundError):
        drivers.load_artifact(spark, f"{tmp_path}/gone.csv", "csv", hot, "a1", fallback="never")


@pytest.fixture
def feed(tmp_path):
    at = tmp_path / "feed"
    at.mkdir()
    days = "monday,tuesday,wednesday,thursday,friday,saturday,sunday"
    texts = {
        "calendar.txt": f"service_id,{days},start_date,end_date\nS1,1,0,0,0,0,0,0,20240101,20241231\nS2,0,1,0,0,0,0,0,20240101,bad\nS3,1,0,0,0,0,0,0,20240101,\n",
        "calendar_dates.txt": "service_id,date,exception_type\nS2,20240101,1\nS3,20240101,1\nS3,20240101,2\n",
        "trips.txt": "trip_id,service_id,route_id\nT1,S1,R1\nT2,S2,R1\nT3,S3,R2\n",
        "routes.txt": "route_id,route_type\nR1,3\nR2,x\n",
        "stop_times.txt": "trip_id,stop_id,stop_sequence\nT1,A,1\nT2,B,1.0\nT3,C,2\n",
        "stops.txt": "\ufeffstop_id,stop_lat\nA,1.5\nB,\nC,2\n",
        "license.txt": "all, rights\n",
        "notes.txt": "prose only\n",
    }
    for n, t in texts.items():
        (at / n).write_text(t, encoding="utf-8")
    return str(at)


def test_feed_slice(spark, feed):
    members = drivers.feed_members(spark, feed)
    assert "license.txt" not in members and "notes.txt" not in members and len(members) == 6
    tables = {m[:-4]: drivers.read_feed_member(spark, feed, m) for m in members}
    assert dict(tables["routes"].dtypes)["route_type"] == "bigint" and ids(tables["routes"], "route_type") == {3, None}
    assert ids(tables["stops"], "stop_lat") == {1.5, None, 2.0} and ids(tables["stop_times"], "stop_sequence") == {1, 2}
    cut = gtfs.service_slice(tables, date(2024, 1, 1))
    assert ids(cut["trips"], "trip_id") == {"T1", "T2"} and ids(cut["stops"], "stop_id") == {"A", "B"} and ids(cut["routes"], "route_id") == {"R1"}
    assert ids(gtfs.service_slice(tables, date(2024, 1, 2))["trips"], "trip_id") == {"T2"}
    assert gtfs.service_slice(tables, None)["trips"].count() == 3
    assert gtfs.table_hash(tables["stops"]).head() == gtfs.table_hash(tables["stops"].orderBy(F.col("stop_id").desc())).head()
    assert {tuple(r) for r in gtfs.trips_per_route(tables["trips"]).collect()} == {("R1", 2), ("R2", 1)}


def test_coefficients(spark):
    wide = spark.createDataFrame([("coef_1", "1.0", "2.0", "T"), ("#c", "1", "2", ""), ("coef_2", "", "3", None)], "coefficient_name string, segment_a string, segment_b string, constrain string")
    got = {(r.source_type, r.coefficient_name, r.segment, r.value_num, r.constrained) for r in coefficients.coefficient_rows(wide).collect()}
    assert got == {("template", "coef_1", "segment_a", 1.0, True), ("template", "coef_1", "segment_b", 2.0, True), ("template", "coef_2", "segment_b", 3.0, False)}
    direct = spark.createDataFrame([("time", "1.1", "d"), ("cost", "x", "d")], "coefficient_name string, value string, description string")
    assert {(r.source_type, r.coefficient_name, r.value_num) for r in coefficients.coefficient_rows(direct).collect()} == {("direct", "time", 1.1), ("direct", "cost", None)}
    dims = spark.createDataFrame([("work", "am", "0.5")], "purpose string, period string, coefficient string")
    assert json.loads(coefficients.coefficient_rows(dims).head().dims_json) == {"purpose": "work", "period": "am"}
    probs = spark.createDataFrame([(0, "am", 0.6, 0.4)], "row_index int, period string, early double, late double")
    assert coefficients.probability_rows(probs).head().asDict() == {"row_index": 0, "dims": {"period": "am"}, "probs": {"early": 0.6, "late": 0.4}}
    assert coefficients.probability_entries(probs).count() == 2
    values = spark.createDataFrame([("r1", "a", "1"), ("r2", "a", "1"), ("r1", "b", "2"), ("r2", "b", "2"), ("r3", "a", "1")], "run string, name string, value string")
    assert {(r.a, r.b, tuple(r.runs)) for r in coefficients.combinations(values, "run", "name", "value", ["a", "b"]).collect()} == {("1", "2", ("r1", "r2"))}
    assert {(r.a, r.b) for r in coefficients.combinations(values, "run", "name", "value", ["a", "b"], require_all=False, missing="-").collect()} == {("1", "2"), ("1", "-")}
    with pytest.raises(ValueError, match="several"):
        coefficients.collapsed(values, ["run"], "value", "name", "error")


def test_arrays(spark):
    rows = spark.createDataFrame([("r", ["x", "y"], [2, 3]), ("r", ["x"], [5])], "run_id string, dims array<string>, shape array<bigint>")
    assert {tuple(r) for r in arrays.dimension_sizes(rows).collect()} == {("r", "x", 5), ("r", "y", 3)}
    assert ids(arrays.variables(rows.withColumn("kind", F.lit("data"))), "n_cells") == {6, 5}
    m = spark.createDataFrame([("a", "m1", 2, 3), ("b", "m1", 4, 4), ("a", "m2", 1, 1)], "run_id string, matrix_name string, n_rows int, n_cols int")
    assert {tuple(r) for r in arrays.compare_matrices(m, ["a", "b"]).collect()} == {("m1", "2x3", "4x4"), ("m2", "1x1", "N/A")}
    assert {tuple(r) for r in arrays.zone_counts(m).collect()} == {("a", 2), ("b", 4)}


def test_files(spark, tmp_path):
    for n in ("o/skims_2030_am.parquet", "o/skims_2040_pm.parquet", "o/skims_x_am.parquet", "o/tmp/skims_2030_am.parquet"):
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(n)
    files = manifests.list_files(spark, f"{tmp_path}/o")
    got = manifests.output_set(files, ["**/*.parquet"], ["tmp/*"], "skims_{year:int}_{period}.parquet")
    assert [(r.rel, r.year, r.period) for r in got.collect()] == [("skims_2030_am.parquet", 2030, "am"), ("skims_2040_pm.parquet", 2040, "pm")]
    m = manifests.manifest(spark, f"{tmp_path}/o")
    assert m.count() == 4 and manifests.manifest_hash(m).head() == manifests.manifest_hash(m.orderBy(F.rand())).head()
    uri = spark.createDataFrame([("out://a/b",), ("/data/x/y",), ("/data/z",)], "u string")
    assert [r[0] for r in uri.select(manifests.resolve(F.col("u"), {"out": "/data/x"})).collect()] == ["/data/x/a/b", "/data/x/y", "/data/z"]
    assert [r[0] for r in uri.select(manifests.virtualize(F.col("u"), {"d": "/data", "out": "/data/x"})).collect()] == ["out://a/b", "out://y", "d://z"]


def test_tracked_runs(spark, tmp_path):
    tracker, calls = Tracker(spark, f"{tmp_path}/t"), []
    tracker.on("complete", lambda run: calls.append(run["id"]))
    (tmp_path / "in.csv").write_text("id,v\n1,2\n3,4\n")

    @step(outputs=["doubled"], tags=["t"])
    def double(config, table):
        return table.select("id", (F.col("v") * config["factor"]).alias("v"))

    def total(config, doubled):
        return doubled.agg(F.sum("v").alias("total"))

    with tracker.scenario("scn") as s:
        first = s.run(double, config={"factor": 2}, inputs={"table": f"{tmp_path}/in.csv"})
        last = s.run(total, outputs=["total"], inputs=["doubled"])
    assert drivers.load(spark, last.outputs["total"]).head().total == 12 and calls == [first.run_id, last.run_id]
    again = tracker.run(double, config={"factor": 2}, inputs={"table": f"{tmp_path}/in.csv"})
    assert again.cache_hit and again.outputs == first.outputs
    other = tracker.run(double, config={"factor": 3}, inputs={"table": f"{tmp_path}/in.csv"})
    assert not other.cache_hit and other.meta["cache_miss"] == {"reason": "config_changed", "candidate_run_id": first.run_id, "confidence": "high"}
    assert not tracker.run(double, config={"factor": 2}, inputs={"table": f"{tmp_path}/in.csv"}, cache_mode="overwrite").cache_hit
    runs = {r.id: r for r in tracker.catalog.read("run").collect()}
    assert runs[first.run_id].parent_run_id == s.run_id and runs[s.run_id].status == "completed" and runs[first.run_id].tags == ["t"]

    def broken(config):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        tracker.run(broken)
    assert tracker.catalog.read("run").where("status = 'failed'").count() == 1
    with pytest.raises(FileNotFoundError):
        tracker.run(total, inputs={"doubled": "nowhere"})
    with pytest.raises(ValueError, match="cache_mode"):
        tracker.run(total, cache_mode="sometimes")


def test_sweep(spark, tmp_path):
    def cell(config):
        return spark.range(config["n"]).toDF("x")

    tracker = Tracker(spark, f"{tmp_path}/t")
    with tracker.scenario("sweep") as s:
        done = s.map_runs([{"n": 1}, {"n": 2}], cell, "cell_{n}", outputs=["x"])
    assert [drivers.load(spark, d.outputs["x"]).count() for d in done] == [1, 2]
    events = sinks.run_events(tracker.catalog.read("run"), tracker.catalog.read("run_artifact_link"), tracker.catalog.read("artifact"))
    assert {json.loads(r.event)["eventType"] for r in events.collect()} == {"COMPLETE"}


def test_streams(spark, tmp_path, small):
    spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(2).write.parquet(f"{tmp_path}/landing")
    schema = "event_id long, ts timestamp, event_type string, value double"
    got = []
    q = landing.ingest_stream(landing.landing(spark, f"{tmp_path}/landing", schema), lambda df, n: got.append(df.count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(got) == spark.read.parquet(f"{small}/events.parquet").count()
    counts = landing.windowed_counts(landing.landing(spark, f"{tmp_path}/landing", schema), "ts", ["event_type"])
    q = counts.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).head()[0] == sum(got)
