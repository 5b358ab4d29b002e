from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspan.plans import views
from loomspan.plans.catalog import Catalog
from loomspan.runtime import recovery
from loomspan.runtime.tracker import Tracker
from loomspan.sources import configs, drivers, sinks

T0 = datetime(2025, 1, 1)


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/catalog")
    for i, n in enumerate("ab"):
        spark.createDataFrame([(i + 1, 10.0 * (i + 1))], "id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
    c.append("run", [{"id": f"run_{n}", "parent_run_id": "scn", "model_name": "beam", "status": "completed", "year": 2018, "iteration": 0} for n in "abh"])
    c.append("artifact", [{"id": f"art_{n}", "key": f"link_{n}", "container_uri": f"{tmp_path}/{n}.parquet", "driver": "parquet", "run_id": f"run_{n}", "meta": "{}", "created_at": T0 + timedelta(hours=i)} for i, n in enumerate("abh")])
    c.append("artifact_schema_observation", [{"id": n, "artifact_id": f"art_{n}", "schema_id": "s1", "source": "file"} for n in "abh"])
    c.append("artifact_schema_field", [{"schema_id": "s1", "ordinal_position": i, "name": n, "logical_type": t} for i, (n, t) in enumerate((("id", "BIGINT"), ("value", "DOUBLE")))])
    kv = lambda a, k, t, **v: {"artifact_id": f"art_{a}", "facet_id": "f", "namespace": "beam", "key_path": k, "value_type": t, "created_at": T0, **v}
    c.append("artifact_kv", [kv(n, "sub", "int", value_num=float(i)) for i, n in enumerate("abh")] + [kv("a", "mode", "str", value_str="own"), kv("b", "mode", "null")])
    c.append("run_config_kv", [{"run_id": f"run_{n}", "facet_id": "f", "namespace": "beam", "key": "mode", "value_type": "str", "value_str": "of run", "created_at": T0} for n in "abh"])
    sinks.ingest(c, "link_h", spark.createDataFrame([(9, 90.0)], "id long, value double"), "run_h", "art_h")
    views.mark_ingested(c, "art_h", "link_h")
    return c


def test_grouped_view(spark, catalog):
    got = views.grouped_view(catalog, ["s1"], "v_links", attach_facets=["sub", "mode"], missing="error")
    assert dict(got.dtypes)["sub"] == "bigint" and dict(got.dtypes)["mode"] == "string"
    want = {(1, 10.0, 0, "own", "run_a", "scn"), (2, 20.0, 1, None, "run_b", "scn"), (9, 90.0, 2, "of run", "run_h", "scn")}
    assert {(r.id, r.value, r["sub"], r.mode, r.prov_run_id, r.prov_scenario_id) for r in spark.table("v_links").collect()} == want
    assert {r.id for r in views.grouped_view(catalog, ["s1"], "v1", predicates=["sub>=1"]).collect()} == {2, 9}
    assert {r.id for r in views.grouped_view(catalog, ["s1"], "v2", mode="hot_only").collect()} == {9}
    assert {r.id for r in views.grouped_view(catalog, ["s1"], "v3", run_id="run_a").collect()} == {1}
    none = views.grouped_view(catalog, ["s1"], "v4", year=1999, attach_facets=["sub"], system=False)
    assert none.count() == 0 and dict(none.dtypes) == {"id": "bigint", "value": "double", "sub": "string"}
    assert views.grouped_view(catalog, ["other"], "v5", schema_compatible=True).count() == 0


def test_hybrid_view_of_a_key(spark, catalog):
    assert [tuple(r)[:2] for r in views.hybrid_view(catalog, "link_a").collect()] == [(1, 10.0)]
    registry = views.ViewRegistry(catalog)
    registry.register("Link_H")
    assert registry.Link_H.head().prov_scenario_id == "scn" and spark.table("v_link_h").count() == 1
    with pytest.raises(AttributeError):
        _ = registry.unknown


def test_recovery(spark, tmp_path):
    tracker = Tracker(spark, f"{tmp_path}/t")
    done = tracker.run(lambda config: spark.range(3).toDF("x"), "make", outputs=["x"])
    a = recovery.outputs_of(tracker.catalog, done.run_id)[0]
    assert recovery.check_identity(a, a["container_uri"]).status == "verified"
    assert recovery.check_identity({}, a["container_uri"]).status == "unverified"
    assert recovery.check_identity(a, f"{tmp_path}/gone").status == "unreadable"
    assert recovery.hydrate(tracker.catalog, done.run_id, f"{tmp_path}/h") == {"x": "copied"}
    assert recovery.hydrate(tracker.catalog, done.run_id, f"{tmp_path}/h") == {"x": "preserved"}
    recovery.archive(tracker.catalog, done.run_id, f"{tmp_path}/archive", move=True)
    moved = recovery.outputs_of(tracker.catalog, done.run_id)[0]
    assert moved["container_uri"].startswith(f"{tmp_path}/archive") and drivers.load(spark, moved["container_uri"]).count() == 3
    sinks.ingest(tracker.catalog, "x", spark.range(3).toDF("x"), done.run_id, a["id"])
    import shutil

    shutil.rmtree(f"{tmp_path}/archive")
    assert recovery.hydrate(tracker.catalog, done.run_id, f"{tmp_path}/h2") == {"x": "rebuilt"}
    assert recovery.hydrate(tracker.catalog, done.run_id, f"{tmp_path}/h3", keys=["other"]) == {}
    assert recovery.NoopTracker().run(lambda config, n: n + config["k"], config={"k": 1}, inputs={"n": 2}).meta["result"] == 3


def test_configs(spark, tmp_path):
    (tmp_path / "common.conf").write_text("beam {\n rate = 0.5\n name = \"x y\"\n}\n")
    (tmp_path / "base.conf").write_text('include "common.conf"\nbeam.on = true  # note\nlist = [1, 2]\n')
    (tmp_path / "overlay.conf").write_text('include "base.conf"\nbeam.rate = 0.25\npath = "/data/in/f.csv"\n')
    tree = configs.read_conf(f"{tmp_path}/overlay.conf")
    assert tree == {"beam": {"rate": 0.25, "name": "x y", "on": True}, "list": [1, 2], "path": "/data/in/f.csv"}
    rows = {(r.key, r.value_type) for r in configs.setting_frame(spark, {"h": tree}).collect()}
    assert rows == {("beam.rate", "num"), ("beam.name", "str"), ("beam.on", "bool"), ("list", "json"), ("path", "str")}
    assert configs.aliased(tree, {"in": "/data/in", "d": "/data"})["path"] == "in://f.csv"
    (tmp_path / "loop.conf").write_text('include "loop.conf"\n')
    with pytest.raises(ValueError, match="cycle"):
        configs.read_conf(f"{tmp_path}/loop.conf")
