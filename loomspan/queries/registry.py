"""Queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its name, with DuckDB SQL unless SQL can't express it."""

        def add(fn: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return fn(prepare(spark), folder)

            run.__name__, run.__doc__ = fn.__name__, fn.__doc__
            self.queries[fn.__name__] = run
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return add


# DuckDB macros can't be created by the driver, so shared expressions are pasted as text.
def trim_sql(column: str) -> str:
    return f"nullif(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '')"


def uuid_sql(column: str) -> str:
    bare = f"regexp_replace(lower({column}), '[{{}}\\s-]', '', 'g')"
    return f"CASE WHEN length({bare}) = 32 THEN substr({bare},1,8)||'-'||substr({bare},9,4)||'-'||substr({bare},13,4)||'-'||substr({bare},17,4)||'-'||substr({bare},21) ELSE nullif(lower(trim({column})), '') END"


CURRENT_RUNS = f"""cur AS (
  SELECT * EXCLUDE (id, parent_run_id, loaded_at, rid, pid), rid AS id, pid AS parent_run_id FROM
    (SELECT *, {trim_sql('id')} AS rid, {trim_sql('parent_run_id')} AS pid FROM run)
  WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY updated_at DESC, loaded_at DESC) = 1)"""

CURRENT_ARTIFACTS = f"""art AS (
  SELECT * EXCLUDE (id, parent_artifact_id, run_id, loaded_at, aid, pid, rid), aid AS id, pid AS parent_artifact_id, rid AS run_id FROM
    (SELECT *, {uuid_sql('id')} AS aid, {uuid_sql('parent_artifact_id')} AS pid, {trim_sql('run_id')} AS rid FROM artifact)
  WHERE aid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY aid ORDER BY loaded_at DESC, created_at DESC) = 1)"""

LINKS = f"""lnk AS (SELECT DISTINCT {trim_sql('run_id')} AS run_id, {uuid_sql('artifact_id')} AS artifact_id, direction FROM run_artifact_link)"""
