"""Further queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F


from loomspan.operators import arrays, artifacts, drift, facets, nested, runs
from loomspan.operators.runset import RunSet
from loomspan.plans import admin
from loomspan.queries.core import ARTIFACT_KV, RUN_KV, artifact_kv, current_artifacts, current_runs, links, run_kv

from loomspan.queries.registry import CURRENT_ARTIFACTS, CURRENT_RUNS, LINKS, Registry, trim_sql
from loomspan.session import read_table
from loomspan.sources import sinks

query = Registry()


@query(f"""WITH {RUN_KV}, one AS (SELECT min(run_id) AS run_id FROM kv WHERE key = 'matrix.cell_1') SELECT run_id, key, value_type, value_num FROM kv WHERE run_id IN (SELECT run_id FROM one) AND starts_with(key, 'matrix.')""")
def run_kv_prefix(spark, folder):
    """One run's settings below a key prefix."""
    kv = run_kv(spark, folder)
    one = kv.where("key = 'matrix.cell_1'").agg(F.min("run_id").alias("run_id"))
    return facets.values_of(kv, one, prefix="matrix.").select("run_id", "key", "value_type", "value_num")


@query(f"""WITH {CURRENT_RUNS}, {RUN_KV} SELECT run_id, key, namespace, value_type FROM kv WHERE key IN ('random_seed', 'chunk_size') AND run_id IN (SELECT id FROM cur WHERE status = 'failed')""")
def run_kv_for_runs(spark, folder):
    """Two settings of many runs at once."""
    wanted = current_runs(spark, folder).where("status = 'failed'").select(F.col("id").alias("run_id"))
    return facets.values_of(run_kv(spark, folder), wanted, keys=["random_seed", "chunk_size"]).select("run_id", "key", "namespace", "value_type")


@query(f"""WITH {RUN_KV} SELECT run_id, value_str AS value FROM kv WHERE key = 'output.format' AND namespace = 'urbansim' AND value_type = 'str' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, facet_id DESC) = 1""")
def facet_value_per_run(spark, folder):
    """One facet of each run, its newest value."""
    return facets.value_per_run(run_kv(spark, folder).where("value_type = 'str'"), "output.format", "urbansim")


@query(f"""WITH {CURRENT_RUNS}, {RUN_KV} SELECT id FROM cur WHERE status = 'completed' AND id IN (SELECT run_id FROM kv WHERE key = 'output.compress' AND value_type = 'bool' AND value_bool)""")
def runs_with_facet_value(spark, folder):
    """Completed runs with a facet of a value."""
    return facets.runs_with_value(current_runs(spark, folder), run_kv(spark, folder), (F.col("key") == "output.compress") & (F.col("value_type") == "bool") & F.col("value_bool")).select("id")


@query(f"""WITH {CURRENT_RUNS} SELECT id FROM cur WHERE model_name = 'beam' AND status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 20""")
def recent_completed_runs(spark, folder):
    """The newest completed runs of a model."""
    return runs.recent_completed(current_runs(spark, folder), "beam").select("id")


@query(f"""WITH {CURRENT_RUNS}, s AS (SELECT signature FROM cur WHERE signature IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id FROM cur WHERE signature IN (SELECT signature FROM s)""")
def runs_by_signature(spark, folder):
    """The runs of the signature that occurs most."""
    known = current_runs(spark, folder)
    one = known.where("signature IS NOT NULL").groupBy("signature").count().orderBy(F.col("count").desc(), "signature").limit(1)
    return known.join(F.broadcast(one.select("signature")), "signature", "left_semi").select("id")


@query(f"""WITH {CURRENT_RUNS}, s AS (SELECT DISTINCT {trim_sql("(payload->>'$.run.id')")} AS id FROM (SELECT * FROM run_snapshot WHERE json_valid(payload)) WHERE json_type(payload, '$.run.id') = 'VARCHAR'), t AS (SELECT id FROM s WHERE id IS NOT NULL)
  SELECT (SELECT count(*) FROM t) AS json_snapshot_count, (SELECT count(*) FROM cur) AS run_count, NOT EXISTS (SELECT id FROM cur EXCEPT SELECT id FROM t) AND NOT EXISTS (SELECT id FROM t EXCEPT SELECT id FROM cur) AS json_db_parity""")
def snapshot_parity(spark, folder):
    """Whether the snapshots hold the same runs as the catalog."""
    from loomspan.queries.problems import _snapshot_copy

    snapshot_ids = _snapshot_copy(spark, folder).df.select(F.col("run_id").alias("id")).where("id IS NOT NULL").distinct()
    known = current_runs(spark, folder).select("id")
    both = known.withColumn("a", F.lit(1)).join(snapshot_ids.withColumn("b", F.lit(1)), "id", "full_outer")
    return both.agg(F.count("b").alias("json_snapshot_count"), F.count("a").alias("run_count"), (F.count("b") + F.count("a") == 2 * F.count(F.lit(1))).alias("json_db_parity"))


@query(f"""WITH {CURRENT_ARTIFACTS}, one AS (SELECT hash, driver, min(id) AS first_id FROM art WHERE hash IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, 3 LIMIT 1) SELECT art.id, art.key FROM art JOIN one ON art.hash = one.hash AND art.driver IS NOT DISTINCT FROM one.driver WHERE art.id <> one.first_id""")
def same_content_artifacts(spark, folder):
    """The other artifacts with the content of one."""
    known = current_artifacts(spark, folder)
    one = artifacts.contents(known).orderBy(F.col("n_artifacts").desc(), "first_id").head()
    return artifacts.same_content(known, one.first_id if one else "").select("id", "key")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT id, coalesce(content_id, CASE WHEN hash IS NOT NULL THEN sha256(concat_ws('|', hash, coalesce(driver, ''))) END) AS content_id FROM art""")
def content_id_backfill(spark, folder):
    """Content ids where they are missing."""
    return artifacts.fill_content_ids(current_artifacts(spark, folder)).select("id", "content_id")


@query(f"""WITH {ARTIFACT_KV} SELECT artifact_id, max(CASE WHEN key_path = 'year' THEN value_num END) AS year, max(CASE WHEN key_path = 'artifact_family' THEN value_str END) AS family FROM akv WHERE key_path IN ('year', 'artifact_family') GROUP BY 1""")
def artifact_facets_wide(spark, folder):
    """Facets of artifacts as columns."""
    return facets.pivot_facets(artifact_kv(spark, folder), ["year", "artifact_family"], entity="artifact_id", key="key_path", value_columns={"artifact_family": "value_str"}, labels={"artifact_family": "family"})


@query("""SELECT DISTINCT field_name, kind FROM (SELECT lower(trim(name, ' ' || chr(9) || chr(10) || chr(13))) AS field_name, list(DISTINCT CASE WHEN lower(logical_type) IN ('int', 'int64', 'bigint', 'long', 'integer') THEN 'integer' WHEN lower(logical_type) IN ('float', 'double', 'float64') THEN 'float'
    WHEN lower(logical_type) IN ('str', 'string', 'varchar', 'text') THEN 'string' WHEN lower(logical_type) IN ('bool', 'boolean') THEN 'boolean' WHEN lower(logical_type) IN ('timestamp', 'datetime') THEN 'timestamp' ELSE lower(logical_type) END) AS kinds FROM artifact_schema_field GROUP BY 1),
  LATERAL (SELECT CASE WHEN len(kinds) = 1 THEN kinds[1] WHEN len(list_filter(kinds, lambda k: k NOT IN ('integer', 'float'))) = 0 THEN 'float' WHEN len(list_filter(kinds, lambda k: k NOT IN ('date', 'timestamp'))) = 0 THEN 'timestamp' ELSE 'string' END AS kind)""")
def promoted_field_types(spark, folder):
    """The least type that holds a field in all schemas."""
    one = drift.header_schemas(read_table(spark, folder, "artifact_schema_field")).withColumn("k", F.lit("all"))
    return drift.union_schemas(one.select("k", "schema_id"), one.drop("k"), "k").select("field_name", "kind")


@query(f"""WITH {CURRENT_RUNS}, n AS (SELECT model_name, year, count(*) AS n FROM cur GROUP BY 1, 2) SELECT model_name, sum(CASE WHEN year = 2030 THEN n ELSE 0 END)::BIGINT AS "2030", sum(CASE WHEN year = 2040 THEN n ELSE 0 END)::BIGINT AS "2040" FROM n GROUP BY 1""")
def model_year_crosstab(spark, folder):
    """Runs by model and year."""
    return current_runs(spark, folder).groupBy("model_name").pivot("year", [2030, 2040]).count().na.fill(0)


@query(f"""WITH {CURRENT_RUNS} SELECT id, year, iteration FROM cur WHERE model_name = 'beam' AND iteration IS NULL""")
def runset_filter_null(spark, folder):
    """Runs of a set whose iteration is missing."""
    return RunSet(current_runs(spark, folder)).filter(model_name="beam", iteration=None).runs.select("id", "year", "iteration")


@query(f"""WITH {LINKS}, one AS (SELECT run_id FROM lnk WHERE direction = 'output' GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1) SELECT DISTINCT i.run_id FROM lnk o JOIN lnk i ON i.artifact_id = o.artifact_id AND i.direction = 'input' WHERE o.direction = 'output' AND o.run_id IN (SELECT run_id FROM one)""")
def connected_runs(spark, folder):
    """The runs that read what one run wrote."""
    from loomspan.operators.lineage import connected_runs as connected

    known = links(spark, folder)
    one = known.where("direction = 'output'").groupBy("run_id").count().orderBy(F.col("count").desc(), "run_id").head()
    return connected(known, one.run_id if one else "")


@query("""SELECT user_id AS run_id, list(event_id ORDER BY ts, event_id)::VARCHAR AS members FROM events GROUP BY 1""")
def ordered_members(spark, folder):
    """Members of each group in order of time."""
    events = read_table(spark, folder, "events")
    out = arrays.ordered_lists(events.select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), "event_id"), ["run_id"], "at", "event_id", "members")
    return out.withColumn("members", F.concat(F.lit("["), F.array_join(F.transform("members", lambda m: m.cast("string")), ", "), F.lit("]")))


@query("""SELECT l_returnflag AS run_id, l_linestatus AS matrix_name, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 100""")
def matrices_by_size(spark, folder):
    """Matrices of at least a size."""
    rows = read_table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("run_id"), F.col("l_linestatus").alias("matrix_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return arrays.matrices(rows, min_rows=100)


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS} SELECT art.id AS artifact_id, art.key AS artifact_key, cur.year, cur.iteration FROM art JOIN cur ON cur.id = art.run_id WHERE cur.year = 2030 AND art.array_path IS NOT NULL""")
def array_metadata_of_runs(spark, folder):
    """Array artifacts with the year and iteration of their run."""
    known = current_artifacts(spark, folder)
    rows = known.where("array_path IS NOT NULL").select(F.col("id").alias("artifact_id"))
    return arrays.of_runs(rows, known, current_runs(spark, folder), year=2030).select("artifact_id", "artifact_key", "year", "iteration")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'""")
def run_rows_by_selection(spark, folder):
    """The rows of a data table that belong to selected runs."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("prov_run_id"))
    chosen = spark.createDataFrame([("F",), ("O",)], "id string")
    return admin.of_runs(orders, chosen).drop("prov_run_id")


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS}, {LINKS}, n AS (SELECT lnk.run_id, direction, coalesce(key, artifact_id) AS name FROM lnk LEFT JOIN art ON art.id = lnk.artifact_id),
  g AS (SELECT run_id, count(*) FILTER (direction = 'input') AS n_inputs, count(*) FILTER (direction = 'output') AS n_outputs, min(name) FILTER (direction = 'input') AS first_input FROM n GROUP BY 1)
  SELECT cur.id AS run_id, CASE status WHEN 'failed' THEN 'FAIL' WHEN 'completed' THEN 'COMPLETE' ELSE 'START' END AS event_type, model_name AS job, coalesce(n_inputs, 0) AS n_inputs, coalesce(n_outputs, 0) AS n_outputs, first_input FROM cur LEFT JOIN g ON g.run_id = cur.id""")
def run_events(spark, folder):
    """Lineage events of all runs, read back from their JSON."""
    known = links(spark, folder)
    events = sinks.run_events(current_runs(spark, folder), known, current_artifacts(spark, folder).select("id", "key"))
    of = lambda path: F.get_json_object("event", path)
    size = lambda path: F.coalesce(F.json_array_length(of(path)), F.lit(0)).cast("long")
    return events.select(of("$.run.runId").alias("run_id"), of("$.eventType").alias("event_type"), of("$.job.name").alias("job"), size("$.inputs").alias("n_inputs"), size("$.outputs").alias("n_outputs"), of("$.inputs[0].name").alias("first_input"))


@query()
def meta_variants_of_steps(spark, folder):
    """Structural variants of steps, from the catalog's current rows."""
    docs = current_runs(spark, folder).select(F.col("id").alias("doc_id"), F.col("meta").alias("doc"))
    return nested.variants(nested.listed_objects(docs, ["steps"]))


QUERIES, SQL = query.queries, query.sql
