"""Values, types and renamings that must come through whole."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomspan.functions.types import number_text
from loomspan.operators import drift, eav, nested, orphans, profile
from loomspan.operators import copydiff
from loomspan.operators.copydiff import Copy, diff_copies
from loomspan.operators.skew import heavy_keys
from loomspan.queries import problems

AT = datetime(2024, 1, 1)
KV = "e string, a string, namespace string, value_type string, value_str string, value_num double, value_bool boolean, value_json string, created_at timestamp_ntz"


def wide(spark, rows, **options):
    df = spark.createDataFrame([(e, a, "n", kind, s, n, None, None, AT) for e, a, kind, s, n in rows], KV)
    return eav.stitch(eav.current_values(df, F.col("e"), F.col("a"), **options))


def test_doubles_stay_doubles(spark):
    values = [1e-12, 3e30, 1.23456789012345, -0.0, 1e300, 0.1]
    table, columns = wide(spark, [(f"e{i}", "x", "float", None, v) for i, v in enumerate(values)] + [("t", "x", "float", "2.5e-7", None)])
    assert columns == [("x", "double")]
    assert {r.entity_id: r.v_x for r in table.collect()} == {**{f"e{i}": v for i, v in enumerate(values)}, "t": 2.5e-7}
    assert {r.value for r in eav.melt(table, columns).collect()} == {"0", "3" + "0" * 30, "1.2346", "1" + "0" * 300, "0.1"}


def test_mixed_kinds_keep_all_digits(spark):
    rows = [("a", "m", "float", None, 0.123456789), ("b", "m", "str", "text", None), ("c", "m", "float", None, 5.0), ("d", "big", "int", "123456789012345678901234567890", None), ("e", "huge", "int", "9" * 50, None), ("f", "n", "int", None, 1e15), ("g", "n", "float", None, 0.5)]
    table, columns = wide(spark, rows)
    assert dict(columns) == {"m": "string", "big": "decimal(38,0)", "huge": "string", "n": "string"}
    got = {r.entity_id: r for r in table.collect()}
    assert [got[k].v_m for k in "abc"] == ["0.123456789", "text", "5"]
    assert got["d"].v_big == Decimal("123456789012345678901234567890") and got["e"].v_huge == "9" * 50 and got["f"].v_n == "1000000000000000"
    short, columns = wide(spark, rows, decimals=4)
    assert {r.entity_id: r.value for r in eav.melt(short, columns).where("attr = 'm'").collect()} == {"a": "0.1235", "b": "text", "c": "5"}


@pytest.mark.parametrize(("text", "same"), [("2020", "2020"), ("+2020.0", "2020"), ("2.02e3", "2020"), ("007", "7"), ("-0", "0"), ("0.10", "0.1"), ("1e-1", "0.1"), ("x", "text:x"), ("1f", "text:1f"), ("NaN", "text:NaN"), ("1.00000000001", "1.00000000001"), ("12345678901234567890123", "12345678901234567890123")])
def test_numbers_however_written(spark, text, same):
    assert spark.range(1).select(number_text(F.lit(text))).head()[0] == same


def test_null_differs_from_any_text(spark):
    rows = lambda v, w: Copy(spark.createDataFrame([("k", v, w, 1)], "k string, a string, b string, v int"), ["v"])
    diff = lambda x, y: {tuple(r) for r in diff_copies(x, y, "k", ["a", "b"]).collect()}
    assert diff(rows(None, ""), rows("\x00", "")) == {("k", "a")}
    assert diff(rows(None, ""), rows("", None)) == {("k", "a"), ("k", "b")}
    assert diff(rows(None, None), rows(None, None)) == set()


def test_integers_beyond_64_bits(spark):
    docs = [("d", json.dumps({"steps": [{"a": 12345678901234567890123, "b": 1}, {"a": 5, "b": 2}]}))]
    objects = nested.listed_objects(spark.createDataFrame(docs, "doc_id string, doc string"), ["steps"])
    table = nested.typed_table(objects, "steps", nested.member_kinds(objects, "steps", ["steps"]))
    assert dict(table.dtypes)["m_a"] == "string" and dict(table.dtypes)["m_b"] == "bigint"
    assert {r.m_a for r in table.collect()} == {"12345678901234567890123", "5"}


def test_heavy_keys_are_relative_to_a_partition(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.createDataFrame([(f"k{i}", 1) for i in range(99)] + [("hot", 99 // (4 * parts) + 20), (None, 500)], "k string, n long")
    assert heavy_keys(counts.where("k IS NOT NULL"), "k", "n") == ["hot"]


def test_orphans_of_hot_and_other_targets(spark):
    held = [(f"h{i}", "gone" if i % 2 else f"t{i % 40}", AT + timedelta(days=i)) for i in range(400)] + [("late", "t0", AT - timedelta(days=9)), ("none", None, AT)]
    refs = orphans.pointers(spark.createDataFrame(held, "h string, t string, loaded_at timestamp_ntz"), "x", "t", F.col("h"), F.col("t"), "x")
    rows = spark.createDataFrame([(f"t{i}", AT) for i in range(0, 40, 2) if i != 4], "id string, loaded_at timestamp_ntz")
    purges = spark.createDataFrame([("t6", AT + timedelta(days=1)), ("gone", AT)], "id string, loaded_at timestamp_ntz")
    got = {(r.holder_id, r.target, r.kind) for r in orphans.orphan_references(refs, orphans.records(rows, F.col("id"), "x"), orphans.records(purges, F.col("id"), "x")).collect()}
    kind = {"gone": "deleted", "t4": "missing", "t6": "deleted"}
    assert got == {(h, f"x:{t}", kind[t]) for h, t, _ in held if t in kind} | {("late", "x:t0", "late")}


def test_states_are_only_made_of_new_files(spark, tmp_path):
    checks = [profile.Check("x", True, 0, 10)]
    at, store = str(tmp_path / "loads"), profile.StateStore(str(tmp_path / "states"), ["s"], checks)
    write = lambda rows: spark.createDataFrame(rows, "s string, x double").coalesce(1).write.mode("append").parquet(at)
    write([("a", 1.0), ("a", None), ("b", 50.0)])
    assert len(store.update(spark.read.parquet(at))) == 1 and store.update(spark.read.parquet(at)) == []
    write([("a", 3.0), ("c", 4.0)])
    assert len(store.update(spark.read.parquet(at))) == 1
    whole = profile.profile_states(spark.read.parquet(at), ["s"], checks)
    pick = lambda df: {(r.s, r.n, r.x__nulls, r.x__low_high, r.x__sum, r.x__min, r.x__max) for r in df.collect()}
    assert pick(store.read(spark)) == pick(whole)


def followed(files, changes):
    """Plain Python: the last name of each field's chain of renamings, file by file. ``files`` are (dataset, file, names) in order."""
    columns, lives, since = {}, {}, {}
    names: dict = {}
    for n, (dataset, file, fields) in enumerate(files):
        old = names.get(dataset, {})
        renamed = {new: was for kind, new, was in changes.get(file, ()) if kind == "renamed"}
        names[dataset] = now = {}
        for f in fields:
            now[f] = old.get(renamed.get(f, f)) if f in renamed or f in old else None
            if now[f] is None:
                now[f] = (dataset, n, f)
                since[now[f]] = n
            if f not in old:
                lives.setdefault(now[f], []).append((n, f))
            columns[file, f] = now[f]
    last = {chain: max(begun)[1] for chain, begun in lives.items()}
    return {(file, f, last[chain]) for (file, f), chain in columns.items() if last[chain] != f}, last


def test_renamed_fields_are_one_column(spark):
    rng = random.Random(3)
    schemas, files, order = {}, [], []
    for d in range(4):
        names = ["a", "b", "c"]
        for n in range(12):
            names = list(names)
            if n and rng.random() < 0.8:
                i = rng.randrange(len(names))
                names[i] = f"{rng.choice('xyz')}{d}{n}"
            if n and rng.random() < 0.2:
                names = [*names, f"new{n}"]
            file, schema = f"f{d}{n:02}", f"s{d}{n}"
            schemas[schema] = [(i, name, "int") for i, name in enumerate(names)]
            files.append((f"k{d}", file, AT + timedelta(hours=n), schema))
            order.append((f"k{d}", file, names))
    known = drift.header_schemas(spark.createDataFrame([(s, p, n, t) for s, own in schemas.items() for p, n, t in own], "schema_id string, ordinal_position int, name string, logical_type string"))
    table = spark.createDataFrame(files, "k string, f string, at timestamp_ntz, schema_id string")
    log = drift.drift_log(table, known, "k", "f", "at")
    changes: dict = {}
    for r in log.collect():
        changes.setdefault(r.f, []).append((r.change, r.field_name, r.old_name))
    want, last = followed(order, changes)
    columns = drift.column_names(table, known, log, "k", "f", "at")
    assert {(r.f, r.field_name, r.column) for r in columns.collect()} == want and want
    union = drift.union_schemas(table, known, "k", columns, "f")
    assert {(r.k, r.field_name) for r in union.collect()} == {(chain[0], name) for chain, name in last.items()}
    records = spark.createDataFrame([(k, f, 1, json.dumps({n: i for i, n in enumerate(names)})) for k, f, names in order], "k string, f string, row_no int, record string")
    rows = drift.unified_values(drift.renamed_members(records, columns, "k", "f"), union, "k", "f").where("value IS NOT NULL")
    named = {(f, n): c for f, n, c in want}
    assert {(r.f, r.field_name, r.value) for r in rows.collect()} == {(f, named.get((f, n), n), str(i)) for _, f, names in order for i, n in enumerate(names)}


def test_names_that_come_again(spark):
    """x becomes y while an earlier y became z; a name that ends and comes back later is the same column."""
    schemas = {"1": "xyq", "2": "xzq", "3": "yz", "4": "yzq"}
    known = drift.header_schemas(spark.createDataFrame([(s, {"x": 0, "y": 1, "z": 1, "q": 2}[n] if (s, n) != ("3", "y") and (s, n) != ("4", "y") else 0, n, "int") for s, ns in schemas.items() for n in ns], "schema_id string, ordinal_position int, name string, logical_type string"))
    table = spark.createDataFrame([("k", f"f{s}", AT + timedelta(hours=int(s)), s) for s in schemas], "k string, f string, at timestamp_ntz, schema_id string")
    log = drift.drift_log(table, known, "k", "f", "at")
    columns = drift.column_names(table, known, log, "k", "f", "at")
    assert {tuple(r) for r in columns.collect()} == {("k", "f1", "x", "y"), ("k", "f2", "x", "y"), ("k", "f1", "y", "z")}
    assert {r.field_name for r in drift.union_schemas(table, known, "k", columns, "f").collect()} == {"y", "z", "q"}


def test_wide_tables_hold_what_is_listed(spark, small):
    """The wide tables against the listed values of p4_found, read column by column."""
    listed = {(r.entity, r.entity_id, r.namespace, r.attr): r.value_text for r in problems.p4_found(spark, small).collect()}
    got = {}
    for entity, query in (("run", problems.p4_run_wide), ("artifact", problems.p4_artifact_wide)):
        table = query(spark, small)
        for r in table.collect():
            for name, kind in table.dtypes[2:]:
                v = r[name]
                if v is not None:
                    got[entity, r.entity_id, r.namespace, name[2:]] = eav._plain(v) if kind == "double" else str(v).lower() if kind == "boolean" else str(v)
    assert got.keys() == listed.keys()
    assert all(v == listed[k] or float(v) == pytest.approx(float(listed[k]), abs=5e-5) for k, v in got.items())


@pytest.mark.parametrize("name", problems.META_LISTS)
def test_typed_tables_of_lists_hold_all_members(spark, small, name):
    """Each typed table against a plain walk of the same objects."""
    table = problems.META_TABLES[f"p6_{name}"](spark, small)
    objects = problems._meta_objects(spark, small).where(F.col("list_name") == name).collect()
    want = {(r.doc_id, r.path): r.members for r in objects}
    rows = table.collect()
    assert {(r.doc_id, r.path) for r in rows} == set(want)
    for r in rows:
        for column, kind in table.dtypes[5:]:
            text, v = want[r.doc_id, r.path].get(column[2:]), r[column]
            if text is None:
                assert v is None
            elif kind == "string":
                assert v == text
            elif kind == "boolean":
                assert v == (text == "true")
            else:
                assert v is not None and float(v) == float(text)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_the_sieve_keeps_all_suspects_and_few_others(spark, n):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("x").alias("_other"))
    suspects = rows.where(F.expr(f"substring(k, 2) % 50 = 0 AND substring(k, 2) < {n * 50}")).select("k")
    kept = {r.k for r in copydiff.sieve(rows, "k", suspects, n).collect()}
    assert {r.k for r in suspects.collect()} <= kept and len(kept) <= n + 20_000 / copydiff.SLOTS_PER_KEY * 1.5


def test_a_full_bitmap_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "MOST_SLOT_BITS", 4)
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert copydiff.sieve(rows, "k", rows, 100).count() == 100
