import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators import views
from loomspan.operators.views import Source


def test_union_of_drifting_runs(spark):
    cold = spark.createDataFrame([(1, "old")], "id long, legacy_col string")
    hot = spark.createDataFrame([(2, "fresh", 3)], "id long, new_col string, persons int")
    got = views.union_by_name([cold, hot])
    assert got.columns == ["id", "legacy_col", "new_col", "persons"]
    assert {tuple(r) for r in got.collect()} == {(1, "old", None, None), (2, None, "fresh", 3)}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("bigint", "string", "string"), ("boolean", "int", "int"), ("int", "double", "double"), ("void", "date", "date"), ("date", "timestamp_ntz", "timestamp_ntz"), ("decimal(10,2)", "decimal(5,4)", "decimal(12,4)"),
        ("int", "decimal(5,1)", "double"), ("struct<a:int>", "struct<a:bigint,b:string>", "struct<a:bigint,b:string>"), ("array<int>", "array<string>", "array<string>"), ("struct<a:int>", "int", "string"), ("smallint", "bigint", "bigint"),
    ],
)
def test_widening(spark, a, b, want):
    x, y = (T.NullType() if t == "void" else T.StructType.fromDDL(f"c {t}")[0].dataType for t in (a, b))
    assert views.wider(x, y).simpleString() == want == views.wider(y, x).simpleString().replace("struct<a:bigint,b:string>", want)


def test_number_and_text_do_not_fail(spark):
    got = views.union_by_name([spark.createDataFrame([(1, True)], "k long, f boolean"), spark.createDataFrame([("x", 7)], "k string, f int")])
    assert {tuple(r) for r in got.collect()} == {("1", 1), ("x", 7)}


def test_nested_values_widen(spark):
    got = views.union_by_name([spark.sql("SELECT named_struct('a', 1) AS s"), spark.sql("SELECT named_struct('a', 2L, 'b', 'x') AS s"), spark.sql("SELECT cast(NULL AS struct<a:int>) AS s")])
    assert sorted(str(r.s) for r in got.collect()) == sorted([str(T.Row(a=1, b=None)), str(T.Row(a=2, b="x")), "None"])


def test_typed_empty_view(spark):
    got = views.typed_empty(spark, {"id": "bigint"}, {"year": ["int"], "share": ["int", "float"], "on": ["bool"], "mode": ["str", "int"], "none": []})
    assert dict(got.dtypes) == {"id": "bigint", "year": "bigint", "share": "double", "on": "boolean", "mode": "string", "none": "string", **views.SYSTEM}
    assert got.count() == 0


@pytest.fixture
def files(spark, tmp_path):
    spark.createDataFrame([(1, 10.0)], "id long, value double").coalesce(1).write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([(2, 20.0, "x")], "id long, value double, extra string").coalesce(1).write.parquet(f"{tmp_path}/b.parquet")
    (tmp_path / "c.csv").write_text("Id,The Value\n3,30.5\n")
    facts = [("a.parquet", "parquet", {"year": 2018, "sub": 1}), ("b.parquet", "parquet", {"year": 2019}), ("c.csv", "csv", {}), ("d.json", "json", {})]
    return [Source(f"{tmp_path}/{n}", d, f"run_{n[0]}", f"art_{n[0]}", 2018, i, "scn", f) for i, (n, d, f) in enumerate(facts)]


@pytest.mark.parametrize("literal", [32, 0])
def test_files_with_runs_and_facets(spark, files, literal, monkeypatch):
    monkeypatch.setattr(views, "MAX_LITERAL_FILES", literal)
    got = views.hybrid(spark, None, files, facets={"year": ["int"], "sub": ["int"]}, missing="error")
    found = {(r.id, r.value, r.extra, r.the_value, r.prov_run_id, r.prov_iteration, r.year, r["sub"]) for r in got.collect()}
    assert found == {(1, 10.0, None, None, "run_a", 0, 2018, 1), (2, 20.0, "x", None, "run_b", 1, 2019, None), (3, None, None, 30.5, "run_c", 2, None, None)}


def test_hot_and_cold_rows_together(spark, files):
    table = spark.createDataFrame([(9, 90.0, 4, "run_h", "art_h", 2020, None)], "id long, value double, persons int, prov_run_id string, prov_artifact_id string, prov_year int, prov_iteration int")
    hot = views.hot_rows(table, None, spark.createDataFrame([("run_h", "parent")], "id string, parent_run_id string"))
    got = views.hybrid(spark, hot, files[:1])
    assert {(r.id, r.persons, r.prov_run_id, r.prov_scenario_id) for r in got.collect()} == {(9, 4, "run_h", "parent"), (1, None, "run_a", "scn")}
    assert views.hybrid(spark, hot, files[:1], mode="hot_only").count() == 1
    assert views.hybrid(spark, hot, files[:1], mode="cold_only").count() == 1
    assert not set(views.SYSTEM) & set(views.hybrid(spark, hot, files[:1], system=False).columns)


def test_filter_on_a_run_prunes_its_files(spark, files):
    view = views.hybrid(spark, None, files[:2])
    plan = view.where(F.col("prov_run_id") == "run_a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_missing_files(spark, files, tmp_path):
    gone = [Source(f"{tmp_path}/gone.parquet", "parquet", "r")]
    assert views.hybrid(spark, None, gone, columns={"id": "bigint"}).count() == 0
    assert views.hybrid(spark, None, gone, missing="skip_silent").count() == 0
    with pytest.raises(FileNotFoundError):
        views.hybrid(spark, None, gone, missing="error")
    with pytest.raises(ValueError, match="policy"):
        views.hybrid(spark, None, gone, missing="ignore")
    with pytest.raises(ValueError, match="mode"):
        views.hybrid(spark, None, gone, mode="warm")


def test_views_are_replaced_or_refused(spark):
    views.register(spark.range(1).toDF("x"), "v_test")
    views.register(spark.range(2).toDF("x"), "v_test")
    assert spark.table("v_test").count() == 2
    with pytest.raises(ValueError, match="exists"):
        views.register(spark.range(1), "v_test", if_exists="error")


def test_normalized_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a_b", "1st", "é"])
    assert views.normalized_names(df).columns == ["a_b", "a_b_1", "_1st", "_"]


def test_many_files_of_differing_schemas_are_widened(spark, tmp_path, monkeypatch):
    """A view gives the same rows whether its files are read one by one or by schema."""
    from loomspan.operators import views

    sources = []
    for i in range(6):
        kind = ("bigint", "string", "int")[i % 3]
        at = str(tmp_path / f"f{i}.parquet")
        from loomspan.sources.sinks import write_single

        write_single(spark.createDataFrame([(i,)], "x int").selectExpr(f"cast(x AS {kind}) AS x").coalesce(1), at)
        sources.append(views.Source(at, "parquet", run_id=f"r{i}", facets={"year": 2000 + i}))
    read = lambda: views.cold_rows(spark, sources, {"year": ["int"]})
    one_by_one = read()
    monkeypatch.setattr(views, "MAX_LITERAL_FILES", 3)
    grouped = read()
    assert dict(grouped.dtypes) == dict(one_by_one.dtypes) and dict(grouped.dtypes)["x"] == "string"
    order = sorted(one_by_one.columns)
    assert sorted(map(tuple, grouped.select(order).collect()), key=repr) == sorted(map(tuple, one_by_one.select(order).collect()), key=repr)
