import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspan.functions import hashing
from loomspan.functions.predicates import Predicate, literal, parse
from loomspan.operators import artifacts, facets, lineage, recency, runs, schemas
from loomspan.operators.runset import RunSet, diff_values
from loomspan.plans.catalog import schema_of

T0 = datetime(2025, 1, 1)


def make_runs(spark, rows):
    schema = schema_of("run")
    base = {"status": "completed", "model_name": "sim", "tags": [], "created_at": T0, "meta": "{}"}
    full = [{**base, "created_at": T0 + timedelta(hours=i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([[r.get(f.name) for f in schema] for r in full], schema)


def make_kv(spark, rows):
    """rows: (run, namespace, key, value)."""
    out = [(r, "f", n, k, *facets.flatten({"x": v})[0][1:], T0) for r, n, k, v in rows]
    return spark.createDataFrame(out, schema_of("run_config_kv"))


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(("text", "want"), [("true", ("bool", True)), (" FALSE ", ("bool", False)), ("null", ("null", None)), ("12", ("num", 12)), ("1.5", ("num", 1.5)), ("1e3", ("num", 1000.0)), ("abc", ("str", "abc")), ("-", ("str", "-"))])
def test_literals(text, want):
    assert literal(text) == want


def test_predicates():
    assert parse("year>=2030") == Predicate("year", ">=", "num", 2030)
    assert parse("simulate.a.b = x") == Predicate("a.b", "=", "str", "x", "simulate")
    assert parse("x<=1.5").op == "<="
    for bad in ("year", "=3", "year=", "mode>=fast"):
        with pytest.raises(ValueError):
            parse(bad)


def test_facets_flatten():
    rows = facets.flatten({"a": {"b.c": 1, "d": {}}, "e": [1], "f": None, "g": True, "h": 2.0, "": "blank"})
    assert [r[:2] for r in rows] == [("a.b\\.c", "int"), ("e", "json"), ("f", "null"), ("g", "bool"), ("h", "float")]
    assert len(facets.flatten({"e": [1]}, json_leaves=False)) == 0


def test_facets_of_a_column(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1.5}}'), (2, "[]"), (3, None), (4, "{")], "id long, facet string")
    assert [tuple(r)[:4] for r in facets.flatten_column(df, "id", "facet").collect()] == [(1, "a.b", "float", None)]


def test_pivot(spark):
    kv = make_kv(spark, [("a", "simulate", "alpha", 0.1), ("a", "simulate", "beta", 2), ("a", "simulate", "mode", "fast"), ("b", "simulate", "alpha", 0.2), ("b", "other", "beta", 9)])
    got = facets.pivot_facets(kv, ["alpha", "beta", "mode"], namespace="simulate", value_columns={"mode": "value_str"}, prefix="cfg_", labels={"mode": "m"})
    assert {tuple(r) for r in got.collect()} == {("a", 0.1, 2.0, "fast"), ("b", 0.2, None, None)}
    for bad in ([], ["alpha", "alpha"]):
        with pytest.raises(ValueError):
            facets.pivot_facets(kv, bad)


def test_find_runs(spark):
    r = make_runs(spark, [{"id": "a", "year": 2030, "tags": ["x", "y"]}, {"id": "b__1", "status": "failed"}, {"id": "b_2", "meta": '{"k": true}'}, {"id": "c", "description": "b__note"}])
    kv = make_kv(spark, [("a", "sim", "n", 1), ("b_2", "sim", "n", 1.0), ("c", "other", "n", 1)])
    assert ids(runs.find_runs(r)) == ["c", "b_2", "b__1", "a"]
    assert ids(runs.find_runs(r, tags=["x", "y"])) == ["a"] and ids(runs.find_runs(r, tags=["x", "z"])) == []
    assert ids(runs.find_runs(r, run_scope="b")) == ["c", "b__1"]
    assert ids(runs.find_runs(r, kv=kv, facet={"n": 1})) == ["c", "a"] and ids(runs.find_runs(r, kv=kv, facet={"n": 1}, namespace="sim")) == ["a"]
    assert ids(runs.find_runs(r, kv=kv, facet={"n": 1.0})) == ["b_2"]
    assert ids(runs.find_runs(r, metadata={"k": True}, limit=1)) == [] and ids(runs.find_runs(r, metadata={"k": True}, limit=2)) == ["b_2"]
    assert ids(runs.find_run(r, year=2030)) == ["a"]
    for bad in ({"year": 1999}, {"status": "completed"}):
        with pytest.raises(ValueError):
            runs.find_run(r, **bad)


def test_latest_run_prefers_iterations(spark):
    r = make_runs(spark, [{"id": "a", "iteration": 2}, {"id": "b", "iteration": 2}, {"id": "c", "iteration": 1}, {"id": "d"}])
    assert ids(runs.find_latest_run(r)) == ["b"]
    assert ids(recency.first_of_group(r, ["iteration"], recency.by_creation()).orderBy("id")) == ["b", "c", "d"]
    assert ids(recency.latest_by_struct(r, ["iteration"], ["created_at", "id"]).orderBy("id")) == ["b", "c", "d"]


def test_loose_matching(spark):
    r = make_runs(spark, [{"id": "a", "model_name": "BEAM", "year": 2030, "ended_at": T0}, {"id": "b", "model_name": None, "meta": '{"model": "beam", "year": "2030", "cache_epoch": 2}', "ended_at": T0 + timedelta(days=1)}, {"id": "c", "model_name": "beam", "year": 2031}])
    assert ids(runs.matching_runs(r, model=" beam", year="2030")) == ["b", "a"]
    assert ids(runs.matching_runs(r, model="beam", cache_epoch="2")) == ["b"]
    assert ids(runs.matching_runs(r, model="beam", cache_epoch=2, allow_missing_epoch=True)) == ["b", "a", "c"]


def test_miss_explanation(spark):
    parts = dict(zip(runs.COMPONENTS, "xyz"))
    r = make_runs(spark, [{"id": "far", "config_hash": "1", "input_hash": "2", "git_hash": "3"}, {"id": "near", **parts, "config_hash": "old"}, {"id": "near2", **parts, "git_hash": "old"}, {"id": "failed", **parts, "status": "failed"}, {"id": "other", **parts, "model_name": "m2"}])
    new = make_runs(spark, [{"id": "new", **parts}, {"id": "none", "model_name": "unknown"}])
    got = {x.id: tuple(x)[1:] for x in runs.explain_misses(new, r).collect()}
    assert got == {"new": ("near2", 2, "code_changed", "high"), "none": (None, None, "no_similar_prior_run", "low")}


def test_run_sets(spark):
    r = make_runs(spark, [{"id": "base_a", "year": 2025}, {"id": "base_b", "year": 2025}, {"id": "policy", "year": 2030}, {"id": "open"}])
    kv = make_kv(spark, [("base_a", "sim", "scenario", "base"), ("base_b", "sim", "scenario", "base"), ("base_b", "z", "scenario", "wrong"), ("policy", "sim", "scenario", "policy")])
    s = RunSet(r, kv, "all")
    assert list(s.split_by("year")) == [None, 2025, 2030]
    assert ids(s.filter(scenario="base").latest(["year", "scenario"]).runs) == ["base_b"]
    assert ids(s.filter(year=None).runs) == ["open"]
    left = s.latest(["year"])
    pairs = left.align(RunSet(left.runs.withColumn("id", F.concat("id", F.lit("2")))), ["year"]).pairs
    assert {tuple(x) for x in pairs.collect()} == {(None, "open", "open2"), (2025, "base_b", "base_b2"), (2030, "policy", "policy2")}
    with pytest.raises(ValueError, match="several runs"):
        s.align(left, ["year"])


def test_pair_differences_and_functions(spark):
    r = make_runs(spark, [{"id": "a", "year": 1, "model_name": "m"}, {"id": "b", "year": 1, "model_name": "n"}])
    kv = make_kv(spark, [("a", "m", "x", 1), ("a", "m", "gone", True), ("b", "n", "x", 2), ("b", "n", "new", "t"), ("b", "m", "hidden", 0)])
    pair = RunSet(r, kv).filter(id="a").align(RunSet(r, kv).filter(id="b"), ["year"])
    got = {(x.key, x.left_value, x.right_value, x.status) for x in pair.config_diffs().collect()}
    assert got == {("x", "1", "2", "changed"), ("gone", "true", None, "removed"), ("new", None, "t", "added")}
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0)], "run_id string, v double")
    out = pair.apply(rows, rows, "run_id", lambda x, y: x.iloc[:0][["v"]].assign(v=[]) if not len(y) else x[["v"]].sum().to_frame().T + y[["v"]].sum(), "v double")
    assert [(x.v, json.loads(x.align_key)) for x in out.collect()] == [(13.0, {"year": 1})]


def test_value_differences(spark):
    a = spark.createDataFrame([("k", "1"), ("n", None), ("l", "x")], "key string, value string")
    b = spark.createDataFrame([("k", "1"), ("n", None), ("r", "x")], "key string, value string")
    assert {(r.key, r.status) for r in diff_values(a, b, ["key"]).collect()} == {("k", "same"), ("n", "same"), ("l", "removed"), ("r", "added")}
    assert diff_values(a, b, ["key"], include_equal=False).count() == 2


@pytest.fixture
def graph(spark):
    made = [("a0", None), ("a1", "r1"), ("a2", "r2"), ("a3", "r3"), ("loop", "r4")]
    arts = spark.createDataFrame([(i, "k", "u", None, None, "csv", f"h{n % 2}", None, None, r, None, T0 + timedelta(hours=n)) for n, (i, r) in enumerate(made)], schema_of("artifact"))
    edges = [("r1", "a0", "input"), ("r1", "a1", "output"), ("r2", "a1", "input"), ("r2", "a2", "output"), ("r3", "a1", "input"), ("r3", "a2", "input"), ("r3", "a3", "output"), ("r4", "loop", "input"), ("r4", "loop", "output")]
    return arts, spark.createDataFrame(edges, "run_id string, artifact_id string, direction string")


def test_lineage(spark, graph):
    arts, links = graph
    rows = lineage.lineage(arts, links, spark.createDataFrame([("a3",), ("loop",)], "artifact_id string")).collect()
    assert {(r.artifact_id, r.depth) for r in rows if r.root == "a3"} == {("a3", 0), ("a1", 1), ("a2", 1), ("a0", 2), ("a1", 2), ("a0", 3)}
    assert [r.artifact_id for r in rows if r.root == "loop"] == ["loop"]
    assert lineage.format_tree([r for r in rows if r.root == "a3"]).splitlines()[:3] == ["a3 <- r3", "  a1 <- r1", "    a0"]
    assert lineage.lineage(arts, links, spark.createDataFrame([("a3",)], "artifact_id string"), max_depth=1).count() == 3
    assert {r.run_id for r in lineage.connected_runs(links, "r1").collect()} == {"r2", "r3"}


def reached(made, inputs, root):
    """{artifact: least depth}, by plain Python."""
    depth, level = {root: 0}, [root]
    while level:
        onward = []
        for a in level:
            for b in inputs.get(made.get(a), ()) if made.get(a) is not None else ():
                if b not in depth:
                    depth[b] = depth[a] + 1
                    onward.append(b)
        level = onward
    return depth


def test_lineage_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made = {f"a{i}": f"r{i}" for i in range(3000)}
    arts = spark.createDataFrame([(a, r, T0 + timedelta(hours=int(a[1:]))) for a, r in made.items()], "id string, run_id string, created_at timestamp")
    links = spark.createDataFrame([(f"r{i}", a, "input") for i in range(3000) for a in (f"a{i - 1}", "shared")], "run_id string, artifact_id string, direction string")
    staged, write = [], lineage.stage
    monkeypatch.setattr(lineage, "stage", lambda df, name: staged.append(name) or write(df, name) if len(staged) < 40 else pytest.fail("a job for each level"))
    start = spark.createDataFrame([("a2999",), ("a5",)], "artifact_id string")
    rows = {(r.root, r.artifact_id): r for r in lineage.lineage_nodes(arts, links, start).collect()}
    assert len(rows) == 3000 + 2 + 6 + 2
    assert (rows["a2999", "a0"].depth, rows["a2999", "a-1"].depth, rows["a2999", "shared"].depth, rows["a5", "a0"].depth) == (2999, 3000, 1, 5)
    assert (rows["a2999", "a7"].run_id, rows["a2999", "a-1"].run_id) == ("r7", None)
    assert {(r.root, r.artifact_id): r.depth for r in lineage.lineage_nodes(arts, links, start, bucket_rows=2000).collect()} == {k: r.depth for k, r in rows.items()}


@pytest.mark.parametrize("bucket_rows", [40, 400, lineage.BUCKET_ROWS])
def test_lineage_nodes_in_any_buckets(spark, bucket_rows):
    import random

    rng = random.Random(7)
    # Cycles, links back in time, runs of many inputs and outputs, inputs without a row, a null input, artifacts without run or time.
    made = {f"a{i}": rng.choice([None, *(f"r{min(99, max(0, i // 3 + d))}" for d in (0, 0, 0, 0, 0, 0, 0, 1, -7))]) for i in range(300)}
    inputs = {f"r{i}": {f"a{max(0, i * 3 - rng.randrange(-3, 25))}" for _ in range(rng.randrange(1, 5))} | set(rng.sample(["gone", "a2", "a299", None], rng.choice([0, 0, 1]))) for i in range(100)}
    inputs["r60"] |= {f"a{i}" for i in range(0, 180, 2)}
    arts = spark.createDataFrame([(a, r, T0 + timedelta(hours=int(a[1:])) if rng.random() < 0.9 else None) for a, r in made.items()], "id string, run_id string, created_at timestamp")
    links = spark.createDataFrame([(r, a, "input") for r, found in inputs.items() for a in found] + [(None, "a1", "input"), ("r1", "a290", "output")], "run_id string, artifact_id string, direction string")
    roots = ["a219", "a236", "a293", "a284", "a0"]
    got = [(r.root, r.artifact_id, r.run_id, r.depth) for r in lineage.lineage_nodes(arts, links, spark.createDataFrame([(r,) for r in [*roots, "gone"]], "artifact_id string"), bucket_rows=bucket_rows).collect()]
    expected = [(root, a, made.get(a), d) for root in roots for a, d in reached(made, inputs, root).items()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert len(expected) > 300


def test_descendants_of_runs(spark):
    r = make_runs(spark, [{"id": "a"}, {"id": "b", "parent_run_id": "a"}, {"id": "c", "parent_run_id": "b"}, {"id": "x", "parent_run_id": "y"}, {"id": "y", "parent_run_id": "x"}])
    seeds = spark.createDataFrame([("a",), ("x",)], "id string")
    assert {tuple(x) for x in lineage.descendant_runs(r, seeds).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", 0), ("y", 1)}


def test_artifact_search(spark, graph):
    arts, links = graph
    assert ids(artifacts.linked(arts, links, creator="r1", consumer="r3")) == ["a1"]
    assert ids(artifacts.get_artifact(arts, "k")) == ["loop"] and ids(artifacts.get_artifact(arts, "a0")) == ["a0"]
    assert ids(artifacts.latest_at(arts, arts.select("container_uri"))) == ["loop"]
    assert ids(artifacts.latest_by_hash(arts, "h1")) == ["a3"]
    assert sorted(ids(artifacts.same_content(arts, "a1"))) == ["a3"]
    assert {(r.content_hash, r.n_artifacts) for r in artifacts.contents(arts).collect()} == {("h0", 3), ("h1", 2)}
    assert artifacts.fill_content_ids(arts).where("content_id IS NULL").count() == 0


def test_identities(spark):
    assert hashing.canonical_json({"b": 1, "a": [1, {"é": None}]}) == '{"a":[1,{"\\u00e9":null}],"b":1}'
    assert hashing.config_hash({"a": 1, "t": 5}, ["t"]) == hashing.config_hash({"a": 1})
    assert hashing.config_hash({"a": 1}) != hashing.sha256('{"a":1}')
    assert hashing.run_config_hash({}, "m", 2030) != hashing.run_config_hash({}, "m", 2031)
    df = spark.createDataFrame([("c", "f", "i")], "a string, b string, c string")
    assert df.select(hashing.run_signature("a", "b", "c")).head()[0] == hashing.sha256("code:c|conf:f|in:i")
    rows = spark.createDataFrame([("r", "b"), ("r", "a"), ("none", None)], "run string, sig string")
    assert {tuple(r) for r in hashing.merkle_hash(rows, "run", "sig").collect()} == {("r", hashing.sha256("a|b")), ("none", hashing.sha256("empty_inputs"))}


def test_schema_profiles(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    assert schemas.profile(a)[0] == schemas.profile(spark.createDataFrame([], a.schema))[0] != schemas.profile(a.select("name", "id"))[0]
    fields = spark.createDataFrame([("s", n) for n in "ab"] + [("t", n) for n in "abc"] + [("u", "a"), ("v", "z")], "schema_id string, name string")
    assert {tuple(r) for r in schemas.compatible(fields, "s").collect()} == {("s", "equal"), ("t", "superset"), ("u", "subset")}
    assert schemas.parse_type("DECIMAL(10, 3)").simpleString() == "decimal(10,3)" and schemas.parse_type("hugeint").simpleString() == "decimal(38,0)" and schemas.parse_type("int[]").simpleString() == "array<int>"
    source = schemas.render_class("my table", spark.createDataFrame([], "`a b` int, class string, d decimal(5,2)").schema)
    scope: dict = {}
    exec(source, scope)
    assert list(scope["my_table"].__dataclass_fields__) == ["a_b", "class_", "d"]
    seen = spark.createDataFrame([("1", "a", "s1", "duckdb", T0), ("2", "a", "s2", "file", T0), ("3", "b", "s3", "dlt", T0), ("4", "b", "s4", "dlt", T0 + timedelta(1))], "id string, artifact_id string, schema_id string, source string, observed_at timestamp_ntz")
    assert {(r.artifact_id, r.schema_id) for r in schemas.chosen_observations(seen).collect()} == {("a", "s2"), ("b", "s4")}
    assert {r.schema_id for r in schemas.chosen_observations(seen, "duckdb").collect()} == {"s1", "s4"}
