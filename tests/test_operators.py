"""The operators of the data problems on small literal inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspan.functions import ids
from loomspan.functions.types import plain_number, promote, promoted
from loomspan.operators import drift, eav, nested, orphans, profile
from loomspan.operators.copydiff import Copy, diff_copies
from loomspan.operators.skew import heavy_keys, join_unique

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def found(df):
    return {tuple(r) for r in df.collect()}


def test_ids_in_any_spelling(spark):
    u = "0A1B2C3D-0000-1111-2222-333344445555"
    df = spark.createDataFrame([(f" {u}\n",), ("{" + u.lower() + "}",), (u.replace("-", ""),), ("  ",), (None,), ("No-Uuid",)], "x string")
    assert [r[0] for r in df.select(ids.artifact_id("x")).collect()] == [u.lower()] * 3 + [None, None, "no-uuid"]
    assert [r[0] for r in spark.createDataFrame([(" A\t",), ("\r\n",)], "x string").select(ids.run_id("x")).collect()] == ["A", None]


def test_plain_numbers(spark):
    df = spark.createDataFrame([("1.50000",), ("-0.00001",), ("100",), ("1E+3",), ("0.12345",)], "x string")
    assert [r[0] for r in df.select(plain_number(F.col("x").cast("decimal(38,10)"))).collect()] == ["1.5", "0", "100", "1000", "0.1235"]


def test_promotion(spark):
    cases = [set(), {"null"}, {"integer"}, {"integer", "float"}, {"date", "timestamp"}, {"boolean", "integer"}, {"string", "null"}]
    df = spark.createDataFrame([(sorted(c),) for c in cases], "k array<string>")
    assert [r[0] for r in df.select(promoted(F.col("k"))).collect()] == [promote(c) for c in cases]


def copies(spark, rows):
    return Copy(spark.createDataFrame(rows, "k string, a string, b string, v int, extra string"), ["v"])


def test_copies_differ_field_by_field(spark):
    base = [(f"k{i}", f"a{i}", None if i % 3 else "b", 1, "x") for i in range(500)]
    other = [r for r in base if r[0] not in ("k7", "k99")] + [("new", None, None, 1, "y"), (None, "a", "b", 1, "y")]
    other = [(k, "changed" if k == "k42" else a, "" if k == "k43" else b, v, e) for k, a, b, v, e in other]
    got = found(diff_copies(copies(spark, base), copies(spark, other), "k", ["a", "b"]))
    assert got == {("k7", "missing_in_right"), ("k99", "missing_in_right"), ("new", "missing_in_left"), ("k42", "a"), ("k43", "b")}


def test_current_version_and_repeated_rows_of_copies(spark):
    a = copies(spark, [("k", "old", "b", 1, ""), ("k", "new", "b", 2, ""), ("k", "new", "b", 2, "")])
    b = copies(spark, [("k", "new", "b", 5, "")])
    assert found(diff_copies(a, b, "k", ["a", "b"])) == set()


def test_empty_copies(spark):
    none, one = copies(spark, []), copies(spark, [("k", "a", "b", 1, "")])
    assert found(diff_copies(none, none, "k", ["a"])) == set()
    assert found(diff_copies(one, none, "k", ["a"])) == {("k", "missing_in_right")}


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_orphans_with_and_without_heavy_targets(spark, heavy):
    schema = "h string, t string, loaded_at timestamp_ntz"
    refs = spark.createDataFrame([(f"h{i}", "hot", T2) for i in range(20)] + [("h1", "gone", T1), ("h2", "late", T1), ("h2", "late", T3), ("h3", "here", T2), ("h4", None, T1), ("h5", "back", None)], schema)
    rows = spark.createDataFrame([("late", T2), ("here", T1), ("back", T1), ("gone", T1)], "id string, loaded_at timestamp_ntz")
    purges = spark.createDataFrame([("gone", T2), ("hot", T1), ("here", T1)], "id string, loaded_at timestamp_ntz")
    p = orphans.pointers(refs, "t", "f", F.col("h"), F.col("t"), "x")
    got = orphans.orphan_references(p, orphans.records(rows, F.col("id"), "x"), orphans.records(purges, F.col("id"), "x"), min_heavy=heavy)
    assert found(got) == {("t", "f", f"h{i}", "x:hot", "deleted", "2024-02") for i in range(20)} | {("t", "f", "h1", "x:gone", "deleted", "2024-01"), ("t", "f", "h2", "x:late", "late", "2024-01")}
    counted = {(r.kind, r.period): (r.n_references, r.n_targets) for r in orphans.orphan_counts(got).collect()}
    assert counted == {("deleted", "2024-02"): (20, 1), ("deleted", "2024-01"): (1, 1), ("late", "2024-01"): (1, 1)}


def test_join_with_heavy_keys_keeps_all_rows(spark):
    long = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2), ("alone", 3)], "k string, i int")
    few = spark.createDataFrame([("hot", "a"), ("cold", "b")], "k string, v string")
    heavy = heavy_keys(long.groupBy("k").count(), "k", "count", min_rows=10)
    assert heavy == ["hot"]
    assert sorted(map(str, found(join_unique(long, few, "k", heavy)))) == sorted(map(str, found(long.join(few, "k", "left"))))


KV = "e string, namespace string, a string, value_type string, value_str string, value_num double, value_bool boolean, value_json string, created_at timestamp_ntz"


def test_wide_table_and_back(spark):
    rows = [
        ("e1", "n", " Key ", "int", "+17 ", None, None, None, T1),
        ("e1", "n", "key", "INT", None, 18.0, None, None, T2),
        ("e1", None, "key", "str", None, None, None, '"a b "', T1),
        ("e1", "n", "flag", "bool", "YES", None, None, None, T1),
        ("e2", "n", "flag", "boolean", None, 0.0, None, None, T1),
        ("e2", "n", "x.y", "float", None, 2.50001, None, None, T1),
        ("e2", "n", "nan", "float", None, float("nan"), None, None, T1),
        ("e2", "n", "bad", "int", "1.5", None, None, None, T1),
        ("e2", "n", "json", "json", None, None, None, "[1]", T1),
        ("e3", "n", "null", "null", None, None, None, None, T1),
        (None, "n", "key", "int", "1", None, None, None, T1),
        ("e4", "n", None, "int", "1", None, None, None, T1),
    ]
    values = eav.current_values(spark.createDataFrame(rows, KV), F.col("e"), F.col("a"))
    wide, columns = eav.stitch(values)
    assert dict(columns) == {"key": "string", "flag": "boolean", "x.y": "double"}
    assert found(wide.select("entity_id", "namespace")) == {("e1", "n"), ("e1", ""), ("e2", "n"), ("e3", "n")}
    assert found(eav.melt(wide, columns)) == {("e1", "n", "key", "18"), ("e1", "", "key", "a b"), ("e1", "n", "flag", "true"), ("e2", "n", "flag", "false"), ("e2", "n", "x.y", "2.5")}


def test_many_blocks_are_aligned(spark, monkeypatch):
    monkeypatch.setattr(eav, "BLOCK", 7)
    rows = [(f"e{i}", "n", f"k{j}", "int", str(i * 10 + j), None, None, None, T1) for i in range(100) for j in range(1 + i % 4)]
    wide, columns = eav.stitch(eav.current_values(spark.createDataFrame(rows, KV), F.col("e"), F.col("a")))
    assert wide.count() == 100
    assert found(eav.melt(wide, columns)) == {(e, n, k, v) for e, n, k, _, v, *_ in rows}


def test_findings_and_states(spark):
    checks = [profile.Check("id", False, unique=True), profile.Check("x", True, 0, 10), profile.Check("m", False, enum=("a", "b")), profile.Check("z", True, pattern="Z[0-9]")]
    rows = [("s", T1, 1, 1.0, "a", "Z1"), ("s", T1, 2, float("nan"), "a", None), ("s", T2, 1, 11.0, "b", "Z1\n"), ("s", T2, 1, 9.0, "c", "Z12"), ("s", T2, None, 5.0, "", "")]
    df = spark.createDataFrame(rows, "scn string, at timestamp_ntz, id long, x double, m string, z string")
    states = profile.profile_states(df, ["scn", "at"], checks)
    got = {(r.at, r.column_name, r.finding) for r in profile.findings(states, "scn", "at", checks).collect()}
    assert got == {(T2, "id", "null"), (T2, "id", "shift"), (T2, "x", "range"), (T2, "x", "shift"), (T2, "m", "enum"), (T2, "m", "shift"), (T2, "z", "pattern"), (T2, "z", "shift")}
    assert {(r.at, r.column_name) for r in profile.duplicate_loads(df, ["scn", "at"], checks).collect()} == {(T2, "id")}
    parts = profile.profile_states(df.withColumn("part", F.col("id") % 2), ["scn", "at", "part"], checks)
    merged = profile.merge_states(parts.drop("part"), ["scn", "at"])
    assert {r.at: (r.n, r.x__nulls, r.x__sum) for r in merged.collect()} == {r.at: (r.n, r.x__nulls, r.x__sum) for r in states.collect()}
    assert found(profile.findings(merged, "scn", "at", checks)) == found(profile.findings(states, "scn", "at", checks))


def test_shares_on_the_limit_are_no_shift(spark):
    checks = [profile.Check("x", True)]
    rows = [("s", T1, None if i < 2 else 1.0) for i in range(10)] + [("s", T2, None if i < 3 else 1.0) for i in range(10)] + [("s", T3, None if i < 41 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "scn string, at timestamp_ntz, x double")
    assert {r.at for r in profile.findings(profile.profile_states(df, ["scn", "at"], checks), "scn", "at", checks).collect()} == {T3}


def test_control_limits(spark):
    rows = [("s", datetime(2024, 1, d), "c", "m", float(v)) for d, v in enumerate([10, 11, 10, 11, 30], 1)]
    df = spark.createDataFrame(rows, "scn string, at timestamp_ntz, column_name string, metric string, value double")
    assert [r.value for r in profile.control_limits(df, "scn", "at").collect()] == [30.0]


def test_listed_objects_of_any_shape(spark):
    inner = json.dumps({"steps": {"name": "lone"}})
    doc = {"steps": [{"n": 1, "steps": [None, {"n": 2}]}, 5, [{"feeds": [{"k": "x"}]}], json.dumps(inner)], "o": {"feeds": "no json", "services": None, "a.b": {"feeds": {}}}, "t": inner}
    docs = spark.createDataFrame([("d", json.dumps(doc)), ("e", json.dumps(json.dumps(doc))), ("bad", "{"), ("nan", '{"steps": [{"x": NaN}]}'), ("null", None), ("blank", ""), ("list", "[]")], "doc_id string, doc string")
    objects = nested.listed_objects(docs, ["steps", "feeds", "services"])
    want = {("steps[0]", ""), ("steps[0].steps[1]", "steps[0]"), ("steps[2][0].feeds[0]", ""), ("steps[3]", ""), ("steps[3].steps[0]", "steps[3]"), ("o.a.b.feeds[0]", ""), ("t.steps[0]", "")}
    got = found(objects.select("doc_id", "path", "parent_path"))
    assert got == {(d, *w) for d in "de" for w in want}
    states = [r.variant for r in nested.variants(objects.where("list_name = 'steps'")).collect()]
    table = nested.subtype_table(objects, "steps", states, ["steps", "feeds", "services"])
    assert dict(table.dtypes)["m_n"] == "bigint" and dict(table.dtypes)["m_name"] == "string"
    assert {(r.path, r.m_n, r.m_name) for r in table.where("doc_id = 'd'").collect()} >= {("steps[0]", 1, None), ("t.steps[0]", None, "lone")}


def test_deep_nesting(spark):
    doc: dict = {}
    for _ in range(400):
        doc = {"steps": [doc]}
    objects = nested.listed_objects(spark.createDataFrame([("d", json.dumps(doc)), ("x", '{"steps":[' * 200_000)], "doc_id string, doc string"), ["steps"])
    assert objects.count() == 400


def fields(spark, schemas):
    rows = [(s, p, n, t) for s, own in schemas.items() for p, n, t in own]
    return drift.header_schemas(spark.createDataFrame(rows, "schema_id string, ordinal_position int, name string, logical_type string"))


def test_schema_changes(spark):
    schemas = {
        "s1": [(1, "a", "int"), (2, "b", "str"), (3, "c", "double"), (None, "n", "bool"), (5, "same", "long")],
        "s2": [(1, "A ", "BIGINT"), (2, "b2", "varchar"), (4, "d", "date"), (None, "m", "bool"), (1, "a", "int"), (9, "same", "text")],
    }
    files = spark.createDataFrame([("k", "f1", T1, "s1"), ("k", "f2", T2, "s2"), ("k", "f3", T3, "s2"), ("other", "g1", T1, "s2"), (None, "h", T1, "s1")], "k string, f string, at timestamp_ntz, schema_id string")
    got = found(drift.drift_log(files, fields(spark, schemas), "k", "f", "at"))
    changes = {("renamed", "b2", "b"), ("added", "d", ""), ("removed", "c", ""), ("added", "m", ""), ("removed", "n", ""), ("retyped", "same", "")}
    assert got == {("k", "f2", *c) for c in changes}
    union = {r.field_name: r.kind for r in drift.union_schemas(files.where("k = 'k'"), fields(spark, schemas), "k").collect()}
    assert union["same"] == "string" and union["a"] == "integer" and union["d"] == "date"
    records = spark.createDataFrame([("k", "f1", 1, '{"a": 1, "same": 5}'), ("k", "f1", 1, '{"a": 1, "same": 5}'), ("k", "f2", 1, '{" A": "x", "same": "t", "d": "2024-01-02"}'), ("k", "f2", 2, "broken")], "k string, f string, row_no int, record string")
    rows = drift.unified_values(records, drift.union_schemas(files.where("k = 'k'"), fields(spark, schemas), "k"), "k", "f")
    values = {(r.f, r.row_no, r.field_name): r.value for r in rows.collect()}
    assert len(values) == 3 * len(union)
    wide = drift.unified_table(records, drift.union_schemas(files, fields(spark, schemas), "k"), "k", "k", "f")
    assert dict(wide.dtypes)["f_a"] == "bigint" and dict(wide.dtypes)["f_d"] == "date"
    assert {(r.f, r.row_no, r.f_a, r.f_same) for r in wide.collect()} == {("f1", 1, 1, "5"), ("f2", 1, None, "t"), ("f2", 2, None, None)}
    assert values["f1", 1, "same"] == "5" and values["f2", 1, "a"] is None and values["f2", 1, "d"] == "2024-01-02" and values["f2", 2, "same"] is None


def test_record_with_names_that_clash(spark):
    union = spark.createDataFrame([("k", "a", "integer")], "k string, field_name string, kind string")
    records = spark.createDataFrame([("k", "f", 1, '{"a": 1, " A": 2, "A ": 3}'), ("k", "f", 2, None), ("k", "f", 3, "[]")], "k string, f string, row_no int, record string")
    assert {(r.row_no, r.value) for r in drift.unified_values(records, union, "k", "f").collect()} == {(1, "3"), (2, None), (3, None)}


def test_order_across_blocks(spark):
    rows = [("k", f"f{m}{d}", datetime(2024, m, d), f"s{m}{d}") for m in (1, 4) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "k string, f string, at timestamp_ntz, s string")
    got = {r.s: r.previous for r in drift.before_in_order(df, "k", "at", "f", "s").collect()}
    assert got == {"s11": None, "s12": "s11", "s13": "s12", "s41": "s13", "s42": "s41", "s43": "s42"}


def test_typed_table_knows_the_members_of_all_variants(spark):
    objects = spark.range(100_200).select(
        F.lit("d").alias("doc_id"), F.lit("steps").alias("list_name"), F.col("id").cast("int").alias("position"), F.col("id").cast("string").alias("path"), F.lit("").alias("parent_path"),
        F.concat(F.lit("{a:"), F.when(F.col("id") < 100_100, "integer").otherwise("string"), F.lit(",b:{x"), F.col("id"), F.lit(":float},steps:[steps]"), F.when(F.col("id") == 100_150, ",z:boolean").otherwise(""), F.lit("}")).alias("variant"),
        F.create_map(F.lit("a"), F.col("id").cast("string")).alias("members"),
    )
    kinds = nested.member_kinds(objects, "steps", ["steps"])
    assert kinds == {"a": {"integer", "string"}, "b": {"string"}, "z": {"boolean"}}
    assert nested.typed_table(objects, "steps", kinds).dtypes[-3:] == [("m_a", "string"), ("m_b", "string"), ("m_z", "boolean")]
