"""Every query against its SQL, and the problem queries against plain Python."""

import inspect

import brute
import pyarrow.parquet as pq
import pytest
from helpers import duck, rows, sql_rows

from loomspan.queries import core, engine, more, problems

SQL = core.SQL | more.SQL | engine.SQL | problems.SQL
ALL = core.QUERIES | more.QUERIES | engine.QUERIES | problems.QUERIES
FOUND = {
    "p1": ["run_id", "difference"],
    "p2": ["table_name", "ref_field", "holder_id", "target_id", "kind", "period"],
    "p3": ["tree", "node_id", "ancestor_id", "steps"],
    "p4": ["entity", "entity_id", "namespace", "attr", "value_text"],
    "p5": ["scenario_id", "load_date", "column_name", "finding"],
    "p6": ["run_id", "path", "parent_path"],
    "p7": ["artifact_key", "artifact_id", "change", "field_name", "old_name"],
}


@pytest.fixture(scope="module")
def db(small):
    return duck(small)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, small, db, name):
    df = ALL[name](spark, small)
    names, want = sql_rows(db, SQL[name])
    assert sorted(df.columns) == names
    assert rows(df) == want


def expected(folder, problem):
    tables = inspect.signature(getattr(brute, problem)).parameters
    return getattr(brute, problem)(*(pq.read_table(f"{folder}/{t}.parquet").to_pylist() for t in tables))


@pytest.mark.parametrize("problem", FOUND)
def test_found_equals_plain_python(spark, small, problem):
    df = ALL[f"{problem}_found"](spark, small)
    assert df.columns == FOUND[problem]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(small, problem)


@pytest.mark.parametrize("name", [n for n in ALL if n[0] == "p" and n[1].isdigit() or n in problems.META_TABLES])
def test_problem_query_on_empty_tables(spark, empty_folder, name):
    assert ALL[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", core.QUERIES | more.QUERIES | engine.QUERIES)
def test_core_query_on_empty_tables(spark, empty_folder, name):
    ALL[name](spark, empty_folder).collect()


@pytest.mark.parametrize("problem", ["p1", "p2", "p3", "p4", "p6", "p7"])
def test_nulls_copies_and_clashing_columns_change_nothing(spark, small, dirty_folder, problem):
    clean = {tuple(r) for r in ALL[f"{problem}_found"](spark, small).collect()}
    assert {tuple(r) for r in ALL[f"{problem}_found"](spark, dirty_folder).collect()} == clean


def test_profile_of_dirty_tables(spark, small, dirty_folder):
    clean = {tuple(r) for r in problems.p5_found(spark, small).collect()}
    dirty = {tuple(r) for r in problems.p5_found(spark, dirty_folder).collect()}
    assert clean <= dirty
    assert {r[0] for r in dirty - clean} <= {None}


@pytest.mark.parametrize("name", ["p3_paths", "p4_run_wide", "p5_metrics", "p5_anomalies", "p6_variants", "p7_unified", "p7_union_schema", *problems.META_TABLES])
def test_other_problem_queries_run_on_dirty_tables(spark, dirty_folder, name):
    ALL[name](spark, dirty_folder).collect()
