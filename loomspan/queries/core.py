"""Queries of the engine's own operators over the test tables, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import hashing, ids
from loomspan.functions.types import plain_double
from loomspan.operators import arrays, artifacts, coefficients, facets, gtfs, lineage, recency, runs, schemas, views
from loomspan.operators.runset import RunSet, diff_values
from loomspan.operators.skew import heavy_keys, join_unique
from loomspan.plans import admin
from loomspan.queries.registry import CURRENT_ARTIFACTS, CURRENT_RUNS, LINKS, Registry, trim_sql, uuid_sql
from loomspan.session import read_table, stage

query = Registry()


def current_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs under stripped ids, one row each: the one updated last."""
    run = read_table(spark, folder, "run").withColumns({"id": ids.run_id("id"), "parent_run_id": ids.run_id("parent_run_id")}).where("id IS NOT NULL")
    return recency.latest_by_struct(run, ["id"], ["updated_at", "loaded_at"]).drop("loaded_at")


def current_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    a = read_table(spark, folder, "artifact").withColumns({"id": ids.artifact_id("id"), "parent_artifact_id": ids.artifact_id("parent_artifact_id"), "run_id": ids.run_id("run_id")}).where("id IS NOT NULL")
    return recency.latest_by_struct(a, ["id"], ["loaded_at", "created_at"]).drop("loaded_at")


def links(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "run_artifact_link").select(ids.run_id("run_id").alias("run_id"), ids.artifact_id("artifact_id").alias("artifact_id"), "direction").distinct()


def run_kv(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "run_config_kv").withColumn("run_id", ids.run_id("run_id")).distinct()


RUN_KV = f"kv AS (SELECT DISTINCT * REPLACE ({trim_sql('run_id')} AS run_id) FROM run_config_kv)"


def artifact_kv(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "artifact_kv").withColumn("artifact_id", ids.artifact_id("artifact_id")).distinct()


ARTIFACT_KV = f"akv AS (SELECT DISTINCT * REPLACE ({uuid_sql('artifact_id')} AS artifact_id) FROM artifact_kv)"


# --- hybrid and grouped views -------------------------------------------------------------------------------------


def _orders_by_run(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    even = orders.where("o_orderkey % 2 = 0").withColumn("prov_run_id", F.lit("run_a"))
    odd = orders.where("o_orderkey % 2 <> 0").drop("o_orderpriority").withColumn("prov_run_id", F.lit("run_b"))
    return views.union_by_name([even, odd])


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run_id, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price,
  sum(CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS n_urgent,
  count(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS n_priority FROM orders GROUP BY 1""")
def hybrid_view_drift_agg(spark, folder):
    """Aggregates over a view whose two runs differ in their columns."""
    v = _orders_by_run(spark, folder)
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    return v.groupBy(F.col("prov_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), urgent.alias("n_urgent"), F.count("o_orderpriority").alias("n_priority"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS prov_run_id FROM orders""")
def hybrid_view_rows(spark, folder):
    """The rows of the same view."""
    return _orders_by_run(spark, folder).drop("o_orderdate")


@query("""SELECT key, price, flag FROM (SELECT o_orderkey::VARCHAR AS key, o_totalprice::DOUBLE AS price, 1 AS flag FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'k' || o_orderkey, o_custkey::DOUBLE, o_orderkey::INT % 3 FROM orders WHERE o_orderstatus = 'O')""")
def hybrid_type_widening(spark, folder):
    """Number with text becomes text, float with whole number float, boolean with whole number whole number."""
    orders = read_table(spark, folder, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.lit(True).alias("flag"))
    b = orders.where("o_orderstatus = 'O'").select(F.concat(F.lit("k"), "o_orderkey").alias("key"), F.col("o_custkey").alias("price"), (F.col("o_orderkey").cast("int") % 3).alias("flag"))
    return views.union_by_name([a, b])


@query("""SELECT NULL::BIGINT AS id, NULL::DOUBLE AS income, NULL::BIGINT AS year, NULL::VARCHAR AS mode, NULL::VARCHAR AS prov_run_id, NULL::VARCHAR AS prov_artifact_id,
  NULL::INT AS prov_year, NULL::INT AS prov_iteration, NULL::VARCHAR AS prov_scenario_id WHERE 1 = 0""")
def typed_empty_view(spark, folder):
    """A view of an empty selection keeps its columns and types."""
    return views.hybrid(spark, None, [], columns={"id": "bigint", "income": "double"}, facets={"year": ["int"], "mode": ["str", "int"]})


@query("""SELECT event_id, event_type AS prov_run_id, (props->>'$.k')::BIGINT AS k, e.user_id % 7 AS prov_year, m.n AS facet_n FROM events e
  JOIN (SELECT event_type AS t, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1) m ON e.event_type = m.t""")
def grouped_view_facets(spark, folder):
    """Ingested rows of the selected artifacts only, with their facets as columns."""
    events = read_table(spark, folder, "events")
    table = events.select("event_id", F.col("event_type").alias("prov_artifact_id"), F.col("event_type").alias("prov_run_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.col("user_id") % 7).alias("prov_year"), F.lit(None).cast("int").alias("prov_iteration"))
    chosen = events.where(F.col("event_type").isin("click", "view", "purchase")).groupBy(F.col("event_type").alias("artifact_id")).agg(F.count(F.lit(1)).alias("facet_n"))
    members = chosen.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("run_id", "string"), ("year", "bigint"), ("iteration", "int"), ("scenario_id", "string"))))
    return views.hot_rows(table, members, facets=["facet_n"]).select("event_id", "prov_run_id", "k", "prov_year", "facet_n")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'r' || o_orderkey % 5 END, 'm' || o_orderstatus) AS prov_run_id, CASE WHEN o_orderkey % 3 > 0 THEN 2020 ELSE 2030 END AS prov_year, 's' || o_orderstatus AS prov_scenario_id
  FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def grouped_view_hot_coalesce(spark, folder):
    """Empty system columns of ingested rows are filled from the artifact's run."""
    own = F.col("o_orderkey") % 3 > 0
    table = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("prov_artifact_id"), F.when(own, F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string"))).alias("prov_run_id"), F.when(own, F.lit(2020)).alias("prov_year"), F.lit(None).cast("int").alias("prov_iteration"))
    members = spark.createDataFrame([(s, f"m{s}", 2030, None, f"s{s}") for s in ("F", "O")], "artifact_id string, run_id string, year int, iteration int, scenario_id string")
    return views.hot_rows(table, members).select("o_orderkey", "prov_run_id", "prov_year", "prov_scenario_id")


@query(f"""WITH {CURRENT_RUNS} SELECT l.o_orderkey, c.year AS run_year, c.parent_run_id AS prov_scenario_id FROM
  (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) l LEFT JOIN (SELECT *, row_number() OVER (ORDER BY id) AS n FROM cur) c ON l.n = c.n""")
def hybrid_scenario_join(spark, folder):
    """Ingested rows get their scenario from the parent of their run; rows without a run keep null."""
    from pyspark.sql.window import Window

    one = Window.orderBy("id")
    known = current_runs(spark, folder).select("id", "parent_run_id", "year", F.row_number().over(one).alias("n"))
    rows = read_table(spark, folder, "orders").select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).alias("n"))
    table = rows.join(known.select("n", F.col("id").alias("prov_run_id")), "n", "left")
    out = views.hot_rows(table, None, known.select("id", "parent_run_id"))
    return out.join(known.select(F.col("id").alias("prov_run_id"), F.col("year").alias("run_year")), "prov_run_id", "left").select("o_orderkey", "run_year", "prov_scenario_id")


# --- facets -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, 'k' AS key_path, 'int' AS value_type, NULL::VARCHAR AS value_str, (props->>'$.k')::DOUBLE AS value_num, NULL::BOOLEAN AS value_bool, NULL::VARCHAR AS value_json FROM events WHERE props IS NOT NULL""")
def facet_flatten_kv(spark, folder):
    """JSON settings to typed rows."""
    return facets.flatten_column(read_table(spark, folder, "events"), "event_id", "props")


@query(f"""WITH {RUN_KV} SELECT run_id, max(CASE WHEN key = 'random_seed' THEN value_num END) AS cfg_seed, max(CASE WHEN key = 'chunk_size' THEN value_num END) AS cfg_chunk_size,
  max(CASE WHEN key = 'output.format' THEN value_str END) AS cfg_format FROM kv WHERE namespace = 'activitysim' AND key IN ('random_seed', 'chunk_size', 'output.format') GROUP BY 1""")
def facet_pivot(spark, folder):
    """Configuration keys as columns, one row per run."""
    return facets.pivot_facets(run_kv(spark, folder).where("NOT coalesce(isnan(value_num), false)").unionByName(run_kv(spark, folder).where("isnan(value_num)")), ["random_seed", "chunk_size", "output.format"], namespace="activitysim", value_columns={"output.format": "value_str"}, prefix="cfg_", labels={"random_seed": "cfg_seed", "output.format": "cfg_format"})


@query(f"""WITH {CURRENT_ARTIFACTS}, {ARTIFACT_KV} SELECT id, key FROM art WHERE id IN (SELECT artifact_id FROM akv WHERE key_path = 'iteration' AND value_type IN ('int', 'float') AND value_num >= 1 AND NOT isnan(value_num))
  AND id IN (SELECT artifact_id FROM akv WHERE key_path = 'artifact_family' AND value_type = 'str' AND value_str = 'skims' AND namespace = 'simulate')""")
def facet_predicates_and(spark, folder):
    """Artifacts that meet two predicates, one of them in a namespace."""
    kv = artifact_kv(spark, folder).withColumn("value_num", F.nanvl("value_num", F.lit(None)))
    return facets.having_all(current_artifacts(spark, folder), "id", kv, "artifact_id", ["iteration>=1", "simulate.artifact_family=skims"]).select("id", "key")


@query(f"""WITH {ARTIFACT_KV} SELECT artifact_id, key_path, value_type, CASE WHEN NOT isnan(value_num) THEN value_num END AS value_num FROM akv QUALIFY row_number() OVER (PARTITION BY artifact_id, key_path ORDER BY created_at DESC, facet_id DESC, namespace DESC NULLS LAST) = 1""")
def facet_newest_value(spark, folder):
    """Of several values of one key the newest counts; NaN is null."""
    kv = artifact_kv(spark, folder).withColumn("value_num", F.nanvl("value_num", F.lit(None)))
    order = [F.col("created_at").desc(), F.col("facet_id").desc(), F.col("namespace").desc_nulls_last()]
    return recency.first_of_group(kv, ["artifact_id", "key_path"], order).select("artifact_id", "key_path", "value_type", "value_num")


# Numbers as text differ between engines, so the queries write them plainly, with six decimals at most.
_TEXT = """CASE WHEN value_type = 'bool' THEN value_bool::VARCHAR WHEN value_type IN ('int', 'float', 'num') THEN CASE WHEN isnan(value_num) THEN 'NaN' WHEN value_type = 'int' THEN trunc(value_num)::BIGINT::VARCHAR
  WHEN round(value_num, 6) = 0 THEN '0' ELSE regexp_replace(printf('%.6f', value_num), '\\.?0+$', '') END WHEN value_type = 'json' THEN value_json ELSE value_str END"""


def with_plain_numbers(kv: DataFrame) -> DataFrame:
    """Typed rows whose floats are plain text instead."""
    number = F.col("value_type").isin("float", "num") & F.col("value_num").isNotNull()
    plain = F.when(F.isnan("value_num"), "NaN").otherwise(plain_double(F.col("value_num"), 6))
    return kv.withColumn("value_str", F.when(number, plain).otherwise(F.col("value_str"))).withColumn("_float", number)


def plain_typed_text() -> Column:
    return F.when(F.col("_float"), F.col("value_str")).otherwise(facets.typed_text())


@query(f"""WITH {RUN_KV} SELECT key, value_type, {_TEXT} AS v, count(*) AS n FROM kv GROUP BY 1, 2, 3""")
def facet_typed_values(spark, folder):
    """The values of every key read as text, and how often each occurs."""
    kv = with_plain_numbers(run_kv(spark, folder))
    return kv.groupBy("key", "value_type", plain_typed_text().alias("v")).agg(F.count(F.lit(1)).alias("n"))


# --- runs ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {CURRENT_RUNS} SELECT id, created_at FROM cur WHERE status = 'completed' AND model_name = 'beam' AND list_contains(tags, 'baseline') ORDER BY created_at DESC, id DESC LIMIT 50""")
def find_runs_topk(spark, folder):
    """The newest runs that meet equality and tag conditions."""
    return runs.find_runs(current_runs(spark, folder), status="completed", model_name="beam", tags=["baseline"], limit=50).select("id", "created_at")


@query(f"""WITH {CURRENT_RUNS}, {RUN_KV} SELECT id FROM cur WHERE id IN (SELECT run_id FROM kv WHERE key = 'write_trip_matrices' AND value_type = 'bool' AND value_bool = true)
  AND id IN (SELECT run_id FROM kv WHERE key = 'output.compress' AND value_type = 'bool' AND value_bool = false)""")
def find_runs_by_facets(spark, folder):
    """Runs by facets, strict in type."""
    return runs.find_runs(current_runs(spark, folder), kv=run_kv(spark, folder), facet={"write_trip_matrices": True, "output.compress": False}, limit=None).select("id")


@query(f"""WITH {CURRENT_RUNS} SELECT id FROM (SELECT * FROM cur WHERE model_name = 'urbansim' ORDER BY created_at DESC, id DESC LIMIT 40) WHERE json_valid(meta) AND meta->>'$.cache_mode' = 'reuse'""")
def find_runs_metadata(spark, folder):
    """A condition on meta is applied after the limit."""
    return runs.find_runs(current_runs(spark, folder), model_name="urbansim", metadata={"cache_mode": "reuse"}, limit=40).select("id")


@query(f"""WITH {CURRENT_RUNS} SELECT replace(id, '_2', '__2') AS id FROM cur WHERE replace(id, '_2', '__2') = 'beam' OR starts_with(replace(id, '_2', '__2'), 'beam__')""")
def run_scope_prefix(spark, folder):
    """Runs of a scope: the name itself or followed by two underscores; a single underscore is no match."""
    scoped = current_runs(spark, folder).withColumns({"id": F.regexp_replace("id", "_2", "__2"), "description": F.lit(None).cast("string")})
    return runs.find_runs(scoped, run_scope="beam", limit=None).select("id")


@query(f"""WITH {CURRENT_RUNS} SELECT id, ended_at FROM cur WHERE lower(trim(model_name)) = 'activitysim' AND year = 2030 AND lower(trim(coalesce(stage, CASE WHEN json_valid(meta) THEN coalesce(meta->>'$.stage', meta->>'$.stage_name') END))) = 'simulate'
  ORDER BY ended_at DESC NULLS LAST, updated_at DESC NULLS LAST, created_at DESC NULLS LAST, started_at DESC NULLS LAST, id DESC LIMIT 30""")
def matching_runs_loose(spark, folder):
    """Runs that match without regard to case and number spelling, the most recent first."""
    return runs.matching_runs(current_runs(spark, folder), model=" ActivitySim", year="2030", stage="SIMULATE", limit=30).select("id", "ended_at")


@query(f"""WITH {CURRENT_RUNS} SELECT id FROM cur WHERE contains(id, '2040_1') OR contains(coalesce(model_name, ''), '2040_1') OR contains(coalesce(parent_run_id, ''), '2040_1') OR len(list_filter(tags, lambda t: contains(t, '2040_1'))) > 0 ORDER BY created_at DESC, id DESC LIMIT 25""")
def search_runs(spark, folder):
    """Substring search over ids, models, parents and tags."""
    return runs.search(current_runs(spark, folder), "2040_1", limit=25).select("id")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_group(spark, folder):
    """The latest order of each customer, without sorting whole groups."""
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return recency.latest_by_struct(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(f"""WITH {CURRENT_RUNS} SELECT model_name, year, id FROM cur QUALIFY row_number() OVER (PARTITION BY model_name, year ORDER BY created_at DESC NULLS LAST, id DESC) = 1""")
def runset_latest(spark, folder):
    """The newest run of each model and year; a missing year is a group."""
    return RunSet(current_runs(spark, folder)).latest(["model_name", "year"]).runs.select("model_name", "year", "id")


@query(f"""WITH {CURRENT_RUNS} SELECT id, iteration FROM cur WHERE model_name = 'beam' ORDER BY iteration DESC NULLS LAST, created_at DESC NULLS LAST, id DESC LIMIT 1""")
def find_latest_run(spark, folder):
    """The run of the greatest iteration; runs without one come last."""
    return runs.find_latest_run(current_runs(spark, folder), model_name="beam").select("id", "iteration")


@query(f"""WITH {CURRENT_RUNS}, l AS (SELECT * FROM cur WHERE model_name = 'beam' QUALIFY row_number() OVER (PARTITION BY year, stage ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
  r AS (SELECT * FROM cur WHERE model_name = 'urbansim' QUALIFY row_number() OVER (PARTITION BY year, stage ORDER BY created_at DESC NULLS LAST, id DESC) = 1)
  SELECT l.year, l.stage, l.id AS left_id, r.id AS right_id FROM l JOIN r ON l.year IS NOT DISTINCT FROM r.year AND l.stage IS NOT DISTINCT FROM r.stage""")
def align_null_safe(spark, folder):
    """One-to-one alignment of two sets of runs; nulls equal each other."""
    known = current_runs(spark, folder)
    left, right = (RunSet(known).filter(model_name=m).latest(["year", "stage"]) for m in ("beam", "urbansim"))
    return left.align(right, ["year", "stage"]).pairs


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS id FROM orders GROUP BY 1, 2)
  SELECT f.o_custkey AS customer, f.id::VARCHAR AS left_id, x.id::VARCHAR AS right_id FROM o f JOIN o x USING (o_custkey) WHERE f.o_orderstatus = 'F' AND x.o_orderstatus = 'O'""")
def align_inner(spark, folder):
    """Alignment on one key; keys of one side only drop out."""
    one = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")).agg(F.max("o_orderkey").cast("string").alias("id"))
    left, right = (RunSet(one.where(F.col("status") == s)) for s in ("F", "O"))
    return left.align(right, ["customer"]).pairs


@query("""WITH a AS (SELECT p_size AS key, min(p_type) AS value FROM part WHERE p_brand = 'Brand#11' GROUP BY 1), b AS (SELECT p_size AS key, min(p_type) AS value FROM part WHERE p_brand = 'Brand#22' GROUP BY 1)
  SELECT key, a.value AS left_value, b.value AS right_value, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (key)""")
def config_diff_full_outer(spark, folder):
    """Settings of two sides with what became of each."""
    part = read_table(spark, folder, "part")
    side = lambda brand: part.where(F.col("p_brand") == brand).groupBy(F.col("p_size").alias("key")).agg(F.min("p_type").alias("value"))
    return diff_values(side("Brand#11"), side("Brand#22"), ["key"])


@query(f"""WITH {CURRENT_RUNS}, {RUN_KV}, l AS (SELECT * FROM cur WHERE model_name = 'beam' QUALIFY row_number() OVER (PARTITION BY year ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
  r AS (SELECT * FROM cur WHERE model_name = 'beam' AND status = 'failed' QUALIFY row_number() OVER (PARTITION BY year ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
  p AS (SELECT l.year, l.id AS left_id, r.id AS right_id FROM l JOIN r ON l.year IS NOT DISTINCT FROM r.year),
  v AS (SELECT run_id, key, value FROM (SELECT *, {_TEXT} AS value FROM kv WHERE namespace = 'beam') QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY created_at DESC, facet_id DESC) = 1),
  a AS (SELECT year, left_id, right_id, key, value FROM p JOIN v ON v.run_id = left_id), b AS (SELECT year, left_id, right_id, key, value FROM p JOIN v ON v.run_id = right_id)
  SELECT coalesce(a.year, b.year) AS year, coalesce(a.left_id, b.left_id) AS left_id, coalesce(a.right_id, b.right_id) AS right_id, coalesce(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value,
  CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'same' ELSE 'changed' END AS status
  FROM a FULL JOIN b ON a.left_id = b.left_id AND a.right_id = b.right_id AND a.key = b.key""")
def aligned_config_diffs(spark, folder):
    """Configuration differences of aligned runs."""
    known, kv = current_runs(spark, folder), with_plain_numbers(run_kv(spark, folder))
    kv = kv.withColumn("value_type", F.when(F.col("_float"), "str").otherwise(F.col("value_type"))).drop("_float")
    left = RunSet(known, kv).filter(model_name="beam").latest(["year"])
    right = RunSet(known, kv).filter(model_name="beam", status="failed").latest(["year"])
    pair = left.align(right, ["year"])
    out = pair.config_diffs()
    return out.select("year", "left_id", "right_id", "key", "left_value", "right_value", "status")


@query(f"""WITH {CURRENT_RUNS} SELECT status, count(*) AS n FROM cur GROUP BY 1""")
def split_by_counts(spark, folder):
    """Sizes of the parts of a set of runs."""
    return RunSet(current_runs(spark, folder)).counts("status")


@query(f"""WITH {CURRENT_RUNS} SELECT id, duration_seconds FROM (SELECT id, tags, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM cur ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 60) WHERE list_contains(tags, 'calib')""")
def history_durations(spark, folder):
    """The newest runs with durations; tags are tested after the limit."""
    return runs.history(current_runs(spark, folder), 60, ["calib"]).select("id", "duration_seconds")


@query(f"""WITH {CURRENT_RUNS}, one AS (SELECT config_hash, input_hash, git_hash FROM cur WHERE status = 'completed' AND config_hash IS NOT NULL AND input_hash IS NOT NULL AND git_hash IS NOT NULL ORDER BY id LIMIT 1)
  SELECT cur.id FROM cur JOIN one USING (config_hash, input_hash, git_hash) WHERE status = 'completed'""")
def cache_lookup(spark, folder):
    """Completed runs of one cache identity."""
    known = current_runs(spark, folder)
    one = known.where("status = 'completed'").na.drop(subset=runs.COMPONENTS).orderBy("id").select(*runs.COMPONENTS).head()
    return runs.cache_matches(known, *(one or ("", "", ""))).select("id")


@query(f"""WITH {CURRENT_RUNS}, r AS (SELECT * FROM cur WHERE status = 'failed'),
  h AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM cur WHERE status = 'completed'),
  p AS (SELECT r.id, h.id AS c_id, h.created_at AS c_at, r.config_hash IS NOT DISTINCT FROM h.config_hash AS s0, r.input_hash IS NOT DISTINCT FROM h.input_hash AS s1, r.git_hash IS NOT DISTINCT FROM h.git_hash AS s2
    FROM r JOIN h ON r.model_name = h.model_name AND h.n <= 20),
  b AS (SELECT *, s0::INT + s1::INT + s2::INT AS matched FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s0::INT + s1::INT + s2::INT DESC, c_at DESC, c_id DESC) = 1)
  SELECT r.id, b.c_id AS candidate_run_id, b.matched, CASE WHEN b.c_id IS NULL THEN 'no_similar_prior_run' WHEN s0 AND s1 AND s2 THEN 'exact_match_lookup_inconclusive' WHEN s0 AND s1 THEN 'code_changed' WHEN s0 AND s2 THEN 'inputs_changed' WHEN s1 AND s2 THEN 'config_changed'
    WHEN s0 THEN 'inputs_and_code_changed' WHEN s1 THEN 'config_and_code_changed' WHEN s2 THEN 'config_and_inputs_changed' ELSE 'all_components_changed' END AS reason,
    CASE WHEN b.c_id IS NULL OR matched IN (0, 3) THEN 'low' WHEN matched = 2 THEN 'high' ELSE 'medium' END AS confidence FROM r LEFT JOIN b ON r.id = b.id""")
def explain_cache_misses(spark, folder):
    """The closest earlier run of each failed run and what differs."""
    known = current_runs(spark, folder)
    return runs.explain_misses(known.where("status = 'failed'"), known)


@query(f"""WITH {CURRENT_RUNS} SELECT id, coalesce(stage, CASE WHEN json_valid(meta) THEN meta->>'$.stage' END) AS stage, coalesce(phase, CASE WHEN json_valid(meta) THEN meta->>'$.phase' END) AS phase FROM cur""")
def stage_phase_backfill(spark, folder):
    """Stage and phase from meta where they are missing."""
    return admin.stage_phase_from_meta(current_runs(spark, folder)).select("id", "stage", "phase")


# --- artifacts ----------------------------------------------------------------------------------------------------


@query(f"""WITH {CURRENT_ARTIFACTS}, {LINKS}, a AS (SELECT run_id FROM lnk WHERE direction = 'output' GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1), b AS (SELECT artifact_id FROM lnk WHERE direction = 'output' AND run_id IN (SELECT run_id FROM a)),
  c AS (SELECT run_id FROM lnk WHERE direction = 'input' AND artifact_id IN (SELECT artifact_id FROM b) GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1)
  SELECT id, key FROM art WHERE id IN (SELECT artifact_id FROM b) AND id IN (SELECT artifact_id FROM lnk WHERE direction = 'input' AND run_id IN (SELECT run_id FROM c))""")
def artifact_creator_consumer(spark, folder):
    """Artifacts that one run made and another read."""
    known = links(spark, folder)
    top = lambda df: (df.groupBy("run_id").count().orderBy(F.col("count").desc(), "run_id").head() or [None])[0]
    creator = top(known.where("direction = 'output'"))
    made = known.where((F.col("direction") == "output") & (F.col("run_id") == creator)).select("artifact_id")
    consumer = top(known.where("direction = 'input'").join(made, "artifact_id", "left_semi"))
    return artifacts.linked(current_artifacts(spark, folder), known, creator=creator, consumer=consumer or "").select("id", "key")


@query(f"""WITH {CURRENT_ARTIFACTS}, {ARTIFACT_KV} SELECT id, key FROM art WHERE starts_with(key, 'p') AND id IN (SELECT artifact_id FROM akv WHERE key_path = 'is_final' AND value_type = 'bool' AND value_bool)
  AND id IN (SELECT artifact_id FROM akv WHERE key_path = 'artifact_family' AND starts_with(value_str, 's')) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 40""")
def artifacts_by_facets(spark, folder):
    """Artifacts by predicate, key prefix and family prefix."""
    return artifacts.by_facets(current_artifacts(spark, folder), artifact_kv(spark, folder), ["is_final=true"], key_prefix="p", family_prefix="s", limit=40).select("id", "key")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT container_uri, table_path, id FROM art WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY container_uri, table_path ORDER BY created_at DESC NULLS LAST, id DESC) = 1""")
def latest_artifact_at_uri(spark, folder):
    """The newest artifact at each address."""
    known = current_artifacts(spark, folder)
    return artifacts.latest_at(known, known.select("container_uri", "table_path"), ["container_uri", "table_path"]).select("container_uri", "table_path", "id")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT hash AS content_hash, driver, count(*) AS n_artifacts, min(id) AS first_id, sha256(hash || '|' || coalesce(driver, '')) AS content_id FROM art WHERE hash IS NOT NULL GROUP BY 1, 2""")
def artifact_contents(spark, folder):
    """The distinct contents of artifacts."""
    return artifacts.contents(current_artifacts(spark, folder))


@query("""SELECT sha256(text) AS content_hash, lower(trim(source)) AS source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2""")
def content_dedup(spark, folder):
    """Documents by content and source."""
    docs = read_table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash"), F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""WITH {CURRENT_ARTIFACTS}, one AS (SELECT parent_artifact_id AS p FROM art WHERE parent_artifact_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, key FROM art JOIN one ON parent_artifact_id = p""")
def child_artifacts(spark, folder):
    """The members of a container."""
    known = current_artifacts(spark, folder)
    one = known.where("parent_artifact_id IS NOT NULL").groupBy("parent_artifact_id").count().orderBy(F.col("count").desc(), "parent_artifact_id").head()
    return artifacts.children(known, one[0] if one else "").select("id", "key")


# --- catalog care -------------------------------------------------------------------------------------------------


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS}, {LINKS} SELECT 'runs_' || coalesce(status, 'unknown') AS metric, count(*) AS value FROM cur GROUP BY 1 UNION ALL SELECT 'runs', count(*) FROM cur UNION ALL SELECT 'artifacts', count(*) FROM art UNION ALL SELECT 'links', count(*) FROM lnk
  UNION ALL SELECT 'orphaned_artifacts', count(*) FROM art WHERE id NOT IN (SELECT artifact_id FROM lnk WHERE artifact_id IS NOT NULL) UNION ALL SELECT 'zombie_runs', count(*) FROM cur WHERE status = 'running' AND ended_at IS NULL""")
def inspect_report(spark, folder):
    """Health metrics of a catalog."""
    return admin.inspect(current_runs(spark, folder), current_artifacts(spark, folder), links(spark, folder))


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS} SELECT 'zombie_run' AS issue, id FROM cur WHERE status = 'running' AND ended_at IS NULL UNION ALL SELECT 'completed_without_end', id FROM cur WHERE status = 'completed' AND ended_at IS NULL
  UNION ALL SELECT 'dangling_parent', id FROM cur c WHERE parent_run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur p WHERE p.id = c.parent_run_id)
  UNION ALL SELECT 'missing_producer', id FROM art WHERE run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur p WHERE p.id = art.run_id)""")
def doctor_report(spark, folder):
    """Broken invariants of a catalog."""
    return admin.doctor(current_runs(spark, folder), current_artifacts(spark, folder), links(spark, folder))


@query("""SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING bool_and(o_orderkey % 50 <> 0)""")
def purge_orphans_all_links(spark, folder):
    """Records all of whose links lie in the selection."""
    link = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("artifact_id"))
    chosen = read_table(spark, folder, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("id"))
    return admin.purge_orphans(link, chosen).withColumnRenamed("artifact_id", "l_partkey")


@query("""SELECT DISTINCT l_partkey AS content_hash FROM lineitem WHERE l_orderkey % 20 > 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 20 = 0)""")
def unreferenced_hashes(spark, folder):
    """Contents that only the selected runs refer to."""
    link = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("content_hash"))
    return admin.unreferenced_hashes(link, link.where("run_id % 20 > 0").select(F.col("run_id").alias("id")).distinct())


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1996-01-01')""")
def orphan_anti(spark, folder):
    """Records without any link."""
    used = read_table(spark, folder, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, folder, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 3 = 0""")
def merge_insert_if_absent(spark, folder):
    """A shard's rows whose key is missing are inserted, with the columns both have."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    shard = orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.lit("x").alias("extra"))
    return admin.insert_if_absent(orders.where("o_orderkey % 3 > 0"), shard, ["o_orderkey"])


# --- trees --------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {CURRENT_RUNS}, seeds AS (SELECT id FROM cur WHERE parent_run_id IS NULL ORDER BY id LIMIT 3), d AS (SELECT id, [id] AS path FROM seeds UNION ALL SELECT cur.id, list_append(path, cur.id) FROM cur JOIN d ON cur.parent_run_id = d.id WHERE NOT list_contains(path, cur.id))
  SELECT id, min(len(path) - 1)::INT AS depth FROM d GROUP BY 1""")
def descendant_runs(spark, folder):
    """All runs below three roots."""
    known = current_runs(spark, folder)
    return lineage.descendant_runs(known, known.where("parent_run_id IS NULL").orderBy("id").limit(3).select("id"))


@query(f"""WITH RECURSIVE {CURRENT_RUNS}, d AS (SELECT id, 0 AS depth FROM cur WHERE parent_run_id IS NULL UNION ALL SELECT cur.id, depth + 1 FROM cur JOIN d ON cur.parent_run_id = d.id)
  SELECT id, min(depth)::INT AS depth FROM d GROUP BY 1""")
def descendant_runs_all(spark, folder):
    """All runs below any root."""
    known = current_runs(spark, folder)
    return lineage.descendant_runs(known, known.where("parent_run_id IS NULL").select("id"))


@query(f"""WITH RECURSIVE {CURRENT_ARTIFACTS}, {LINKS}, s AS (SELECT id FROM art WHERE run_id IS NOT NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 5),
  t AS (SELECT id AS root, id AS artifact_id, run_id, 0 AS depth, [id] AS path FROM art WHERE id IN (SELECT id FROM s)
    UNION ALL SELECT t.root, l.artifact_id, a.run_id, t.depth + 1, list_append(t.path, l.artifact_id) FROM t JOIN (SELECT DISTINCT run_id, artifact_id FROM lnk WHERE direction = 'input') l ON l.run_id = t.run_id LEFT JOIN art a ON a.id = l.artifact_id
    WHERE t.depth < 3 AND NOT list_contains(t.path, l.artifact_id))
  SELECT root, artifact_id, run_id, depth FROM t""")
def lineage_depth(spark, folder):
    """The inputs of five artifacts, three levels deep, a row per path."""
    known = current_artifacts(spark, folder)
    start = known.where("run_id IS NOT NULL").orderBy(*recency.by_creation()).limit(5).select(F.col("id").alias("artifact_id"))
    return lineage.lineage(known, links(spark, folder), start, max_depth=3).select("root", "artifact_id", "run_id", "depth")


@query(f"""WITH RECURSIVE {CURRENT_ARTIFACTS}, {LINKS}, s AS (SELECT id FROM art WHERE run_id IS NOT NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 5), i AS (SELECT DISTINCT run_id, artifact_id FROM lnk WHERE direction = 'input'),
  t AS (SELECT id AS root, id AS artifact_id, run_id FROM art WHERE id IN (SELECT id FROM s) UNION SELECT t.root, i.artifact_id, a.run_id FROM t JOIN i ON i.run_id = t.run_id LEFT JOIN art a ON a.id = i.artifact_id)
  SELECT root, artifact_id, run_id FROM t""")
def lineage_reach(spark, folder):
    """Everything that went into five artifacts, at any depth, each artifact once."""
    known = stage(current_artifacts(spark, folder).select("id", "run_id", "created_at"), "known")
    start = known.where("run_id IS NOT NULL").orderBy(*recency.by_creation()).limit(5).select(F.col("id").alias("artifact_id"))
    return lineage.lineage_nodes(known, links(spark, folder), start).select("root", "artifact_id", "run_id")


@query(f"""WITH {CURRENT_ARTIFACTS}, {LINKS}, i AS (SELECT DISTINCT run_id, artifact_id FROM lnk WHERE direction = 'input')
  SELECT id AS root, id AS artifact_id, run_id, 0 AS depth FROM art WHERE run_id IS NOT NULL UNION ALL SELECT a.id, i.artifact_id, b.run_id, 1 FROM art a JOIN i ON i.run_id = a.run_id LEFT JOIN art b ON b.id = i.artifact_id WHERE i.artifact_id IS NOT NULL AND i.artifact_id <> a.id""")
def lineage_inputs(spark, folder):
    """What went directly into each artifact that a run made."""
    known = current_artifacts(spark, folder)
    start = known.where("run_id IS NOT NULL").select(F.col("id").alias("artifact_id"))
    return lineage.lineage_nodes(known, links(spark, folder).where("artifact_id IS NOT NULL"), start, max_depth=1)


# --- identities ---------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, sha256('code:' || o_orderstatus || '|conf:' || o_orderpriority || '|in:' || o_custkey) AS signature FROM orders""")
def signature_hash(spark, folder):
    """The cache key of a run from its components."""
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", hashing.run_signature("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("signature"))


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS}, {LINKS}, s AS (SELECT l.run_id, concat_ws('|', 'driver:' || a.driver, CASE WHEN a.run_id IS NULL THEN 'container_uri:' || a.container_uri ELSE 'key:' || a.key END, 'table_path:' || nullif(a.table_path, ''), 'array_path:' || nullif(a.array_path, ''),
    CASE WHEN a.run_id IS NULL THEN 'file:' || a.hash ELSE coalesce('sig:' || nullif(p.signature, ''), 'run:' || a.run_id) END, CASE WHEN a.run_id IS NOT NULL THEN 'hash:' || nullif(a.hash, '') END) AS sig
    FROM lnk l JOIN art a ON a.id = l.artifact_id LEFT JOIN cur p ON p.id = a.run_id WHERE l.direction = 'input')
  SELECT run_id, sha256(string_agg(sig, '|' ORDER BY sig)) AS input_hash FROM s GROUP BY 1""")
def input_merkle_hash(spark, folder):
    """One hash over all inputs of each run."""
    a = current_artifacts(spark, folder).withColumnRenamed("run_id", "producer")
    producers = current_runs(spark, folder).select(F.col("id").alias("producer"), F.col("signature").alias("producer_signature"))
    inputs = stage(links(spark, folder).where("direction = 'input'").withColumnRenamed("run_id", "consumer"), "inputs")
    # A few shared inputs are used by many runs: they are joined apart.
    shared = heavy_keys(inputs.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")), "artifact_id", "n")
    made = a.withColumnRenamed("id", "artifact_id").withColumn("known", F.lit(True))
    used = join_unique(inputs, made, "artifact_id", shared).where("known").join(producers, "producer", "left").withColumnRenamed("producer", "run_id")
    return hashing.merkle_hash(used.select("consumer", hashing.input_signature().alias("sig")), "consumer", "sig").withColumnRenamed("consumer", "run_id")


# --- sheets, arrays, feeds ----------------------------------------------------------------------------------------


@query("""UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME segment VALUE value""")
def coefficients_unpivot(spark, folder):
    """Columns to long rows."""
    return coefficients.unpivot(read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "segment", "value")


@query("""SELECT 'template' AS source_type, p_brand AS coefficient_name, segment, NULL::VARCHAR AS dims_json, value, false AS constrained, value::DOUBLE AS value_num FROM
  (UNPIVOT (SELECT p_brand, min(p_size)::VARCHAR AS smallest, max(p_size)::VARCHAR AS largest FROM part GROUP BY 1) ON smallest, largest INTO NAME segment VALUE value)""")
def coefficient_template_rows(spark, folder):
    """A template sheet to one row per coefficient and segment."""
    sheet = read_table(spark, folder, "part").groupBy(F.col("p_brand").alias("coefficient_name")).agg(F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"))
    return coefficients.coefficient_rows(sheet)


@query("""WITH v AS (SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS F, min(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS O FROM orders GROUP BY 1)
  SELECT F, O, list_sort(list(o_custkey))::VARCHAR AS runs, count(*) AS n_runs FROM v WHERE F IS NOT NULL AND O IS NOT NULL GROUP BY 1, 2""")
def coefficient_combinations(spark, folder):
    """The combinations of values that occur, with the runs of each."""
    orders = read_table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderpriority").alias("value"))
    out = coefficients.combinations(orders, "o_custkey", "o_orderstatus", "value", ["F", "O"])
    return out.withColumn("runs", F.concat(F.lit("["), F.array_join(F.transform("runs", lambda r: r.cast("string")), ", "), F.lit("]")))


@query("""SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity, l.o_custkey AS run_id FROM lineitem JOIN orders l ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 3""")
def config_query_join(spark, folder):
    """Rows of a content-addressed table with the runs that use them."""
    cache = read_table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("content_hash")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    used = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("content_hash"), F.col("o_custkey").alias("run_id"))
    return coefficients.query_by_config(cache, used, columns=["content_hash", "quantity"]).withColumnRenamed("content_hash", "l_orderkey")


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey)::VARCHAR AS parts FROM lineitem GROUP BY 1""")
def array_ordered_list(spark, folder):
    """Values as a list in the order of an index."""
    out = arrays.ordered_lists(read_table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "parts")
    return out.withColumn("parts", F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p.cast("string")), ", "), F.lit("]")))


@query("""SELECT label::VARCHAR AS run_id, 'd' || (i % 3) AS dimension, max(len(embedding) + vec_id % 10 * i)::BIGINT AS size FROM embeddings, (SELECT unnest([0, 1, 2]) AS i) GROUP BY 1, 2""")
def dimension_sizes(spark, folder):
    """The largest size of each dimension over all variables."""
    rows = read_table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.array(*(F.lit(f"d{i}") for i in range(3))).alias("dims"), F.array(*((F.size("embedding") + F.col("vec_id") % 10 * i).cast("bigint") for i in range(3))).alias("shape"))
    return arrays.dimension_sizes(rows)


@query("""SELECT p_type AS matrix_name, coalesce(min(CASE WHEN p_brand = 'Brand#11' THEN p_size || 'x' || (p_size + 1) END), 'N/A') AS "Brand#11", coalesce(min(CASE WHEN p_brand = 'Brand#12' THEN p_size || 'x' || (p_size + 1) END), 'N/A') AS "Brand#12"
  FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY 1""")
def matrix_compare_pivot(spark, folder):
    """Shapes of matrices side by side, N/A where one is missing."""
    rows = read_table(spark, folder, "part").select(F.col("p_type").alias("matrix_name"), F.col("p_brand").alias("run_id"), F.col("p_size").alias("n_rows"), (F.col("p_size") + 1).alias("n_cols"))
    return arrays.compare_matrices(rows, ["Brand#11", "Brand#12"])


@query("""SELECT p_brand AS run_id, arg_min(p_size, (p_name, p_partkey)) AS n_zones FROM part GROUP BY 1""")
def zone_counts(spark, folder):
    """The size of the first matrix of each run."""
    rows = read_table(spark, folder, "part").select(F.col("p_brand").alias("run_id"), F.struct("p_name", "p_partkey").alias("matrix_name"), F.col("p_size").alias("n_rows"))
    return arrays.zone_counts(rows)


@query("""SELECT c_nationkey, min(c_acctbal) AS min_x, min(c_custkey)::DOUBLE AS min_y, max(c_acctbal) AS max_x, max(c_custkey)::DOUBLE AS max_y, count(*) AS n_features FROM customer GROUP BY 1""")
def spatial_bounds(spark, folder):
    """Bounds and number of point features."""
    return arrays.bounds(read_table(spark, folder, "customer").withColumn("y", F.col("c_custkey").cast("double")), ["c_nationkey"], "c_acctbal", "y")


_DAY = "'1995-03-15'"


@query(f"""WITH s AS (SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) = dayofweek(DATE {_DAY}) AND o_orderdate <= DATE {_DAY} UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0)
  SELECT o_orderkey AS service_id FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0)""")
def active_services(spark, folder):
    """Services of a day by weekday, dates and exceptions; removals win."""
    orders = read_table(spark, folder, "orders")
    weekday = [((F.weekday("o_orderdate") == i).cast("int")).alias(d) for i, d in enumerate(gtfs.WEEKDAYS)]
    calendar = orders.select(F.col("o_orderkey").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("start_date"), F.lit("never").alias("end_date"), *weekday)
    added = orders.where("o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("service_id"), F.lit("19950315").alias("date"), F.lit(1).alias("exception_type"))
    removed = orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("service_id"), F.lit("19950315").alias("date"), F.lit(2).alias("exception_type"))
    return gtfs.active_services(calendar, added.unionByName(removed), date(1995, 3, 15))


@query(f"""WITH s AS (SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) = dayofweek(DATE {_DAY}) AND o_orderdate <= DATE {_DAY}), st AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM s))
  SELECT p_partkey AS stop_id, p_name AS stop_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM st)""")
def service_slice(spark, folder):
    """The stops that the trips of a day touch."""
    orders, lines = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    weekday = [((F.weekday("o_orderdate") == i).cast("int")).alias(d) for i, d in enumerate(gtfs.WEEKDAYS)]
    tables = {
        "calendar": orders.select(F.col("o_orderkey").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("start_date"), F.lit(None).cast("string").alias("end_date"), *weekday),
        "trips": orders.select(F.col("o_orderkey").alias("service_id"), F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id")),
        "stop_times": lines.select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id")),
        "stops": read_table(spark, folder, "part").select(F.col("p_partkey").alias("stop_id"), F.col("p_name").alias("stop_name")),
    }
    return gtfs.service_slice(tables, date(1995, 3, 15))["stops"]


# --- schemas ------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT schema_id, list_sort(list(DISTINCT lower(trim(name)))) AS names FROM artifact_schema_field GROUP BY 1), o AS (SELECT names AS own FROM f ORDER BY len(names), schema_id LIMIT 1)
  SELECT schema_id, CASE WHEN list_has_all(own, names) AND list_has_all(names, own) THEN 'equal' WHEN list_has_all(own, names) THEN 'subset' ELSE 'superset' END AS relation FROM f, o WHERE list_has_all(own, names) OR list_has_all(names, own)""")
def schema_compatible(spark, folder):
    """Schemas whose fields hold or are held by those of one schema."""
    fields = read_table(spark, folder, "artifact_schema_field").withColumn("name", F.lower(F.trim("name")))
    one = fields.groupBy("schema_id").agg(F.countDistinct("name").alias("n")).orderBy("n", "schema_id").head()
    return schemas.compatible(fields, one[0] if one else "")


@query(f"""SELECT artifact_id, schema_id FROM (SELECT *, {uuid_sql('artifact_id')} AS aid FROM artifact_schema_observation) AS t(id, raw, schema_id, run_id, source, sample_rows, observed_at, artifact_id)
  QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY CASE source WHEN 'user_provided' THEN 0 WHEN 'duckdb' THEN 1 WHEN 'file' THEN 2 ELSE 3 END, observed_at DESC NULLS LAST, id DESC) = 1""")
def chosen_observations(spark, folder):
    """The observation that tells each artifact's schema, by source and time."""
    seen = read_table(spark, folder, "artifact_schema_observation").withColumn("artifact_id", ids.artifact_id("artifact_id"))
    return schemas.chosen_observations(seen, preferred="duckdb").select("artifact_id", "schema_id")


@query("""SELECT name, n, n - c AS n_null, lo AS min, hi AS max FROM (SELECT 'age' AS name, count(*) AS n, count(age) AS c, min(age)::VARCHAR AS lo, max(age)::VARCHAR AS hi FROM person UNION ALL SELECT 'mode', count(*), count(mode), min(mode), max(mode) FROM person UNION ALL SELECT 'home_zone', count(*), count(home_zone), min(home_zone), max(home_zone) FROM person)""")
def field_stats(spark, folder):
    """Statistics of columns from one scan."""
    return schemas.field_stats(read_table(spark, folder, "person"), ["age", "mode", "home_zone"]).drop("approx_unique")


@query("""SELECT schema_id, name, CASE WHEN count(ordinal_position) OVER w = 0 THEN row_number() OVER (PARTITION BY schema_id ORDER BY name) ELSE ordinal_position END::INT AS ordinal_position FROM (SELECT DISTINCT schema_id, name, ordinal_position FROM artifact_schema_field) WINDOW w AS (PARTITION BY schema_id)""")
def fill_ordinals(spark, folder):
    """Positions by name for schemas that have none."""
    return schemas.fill_ordinals(read_table(spark, folder, "artifact_schema_field").select("schema_id", "name", "ordinal_position").distinct())


# --- reports and what users write over views ----------------------------------------------------------------------


@query(f"""WITH {CURRENT_RUNS} SELECT parent_run_id AS scenario, count(*) AS n_runs, min(created_at) AS first_run, max(created_at) AS last_run FROM cur WHERE parent_run_id IS NOT NULL GROUP BY 1 ORDER BY n_runs DESC, scenario LIMIT 20""")
def scenario_overview(spark, folder):
    """The scenarios with the most runs."""
    known = current_runs(spark, folder).where("parent_run_id IS NOT NULL")
    grouped = known.groupBy(F.col("parent_run_id").alias("scenario")).agg(F.count(F.lit(1)).alias("n_runs"), F.min("created_at").alias("first_run"), F.max("created_at").alias("last_run"))
    return grouped.orderBy(F.col("n_runs").desc(), "scenario").limit(20)


@query(f"""WITH {CURRENT_RUNS} SELECT model_name, count(*) AS n, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed, min(created_at) AS first_run, max(created_at) AS last_run FROM cur GROUP BY 1""")
def summary_report(spark, folder):
    """Runs of each model by outcome, with their time span."""
    of = lambda s: F.count_if(F.col("status") == s)
    return current_runs(spark, folder).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), of("completed").alias("n_completed"), of("failed").alias("n_failed"), F.min("created_at").alias("first_run"), F.max("created_at").alias("last_run"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def status_crosstab(spark, folder):
    """A cross table of counts, zero where nothing falls."""
    return read_table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""WITH u AS (SELECT user_id, event_type, max(value) AS top, min(value) AS low, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2)
  SELECT event_type, round(avg(top - low), 6) AS avg_spread, round(avg((last_value = top)::INT), 6) AS share_ends_at_top, count(*) AS n FROM u GROUP BY 1""")
def sweep_rollup_argmax(spark, folder):
    """Extremes and value at the last time of each run, then means over the sweep."""
    u = read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
    return u.groupBy("event_type").agg(F.round(F.avg(F.col("top") - F.col("low")), 6).alias("avg_spread"), F.round(F.avg((F.col("last_value") == F.col("top")).cast("int")), 6).alias("share_ends_at_top"), F.count(F.lit(1)).alias("n"))


@query("""SELECT a.l_returnflag AS category, round(avg(b.l_extendedprice - a.l_extendedprice), 4) AS avg_delta, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber GROUP BY 1""")
def join_runs_avg_delta(spark, folder):
    """Two runs joined on their key, mean change by category."""
    lines = read_table(spark, folder, "lineitem")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_returnflag").alias("category"), F.col("l_extendedprice").alias("a"))
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("b"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("category").agg(F.round(F.avg(F.col("b") - F.col("a")), 4).alias("avg_delta"), F.count(F.lit(1)).alias("n"))


@query("""SELECT mode, count(*) AS n, round(avg(age), 6) AS avg_age, max(income) AS top_income FROM person WHERE age >= 18 AND NOT isnan(coalesce(income, 0)) GROUP BY 1""")
def typed_analysis(spark, folder):
    """Filter, group and aggregate over typed rows."""
    p = read_table(spark, folder, "person").where("age >= 18 AND NOT isnan(coalesce(income, 0))")
    return p.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 6).alias("avg_age"), F.max("income").alias("top_income"))


@query("""SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderpriority)::INT AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def ordered_categories(spark, folder):
    """Categories in a given order, the rest behind."""
    from pyspark.sql.window import Window

    rank = F.when(F.col("o_orderpriority") == "5-LOW", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    grouped = read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("place", F.row_number().over(Window.orderBy(rank, "o_orderpriority")))


@query("""SELECT n.l_orderkey, n.l_linenumber, round(0.75 * n.l_quantity + 0.25 * coalesce(p.l_quantity, n.l_quantity), 6) AS blended FROM lineitem n LEFT JOIN lineitem p ON p.l_orderkey = n.l_orderkey AND p.l_linenumber + 1 = n.l_linenumber""")
def blend_with_previous(spark, folder):
    """Values blended with those of the iteration before, where there is one."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    before = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_quantity").alias("before"))
    blended = F.round(0.75 * F.col("l_quantity") + 0.25 * F.coalesce("before", "l_quantity"), 6)
    return lines.join(before, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", blended.alias("blended"))


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, folder):
    """Events per hour: the batch form of the streaming windows."""
    events = read_table(spark, folder, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES, SQL = query.queries, query.sql
