"""Queries that run the engine's stores, readers, writers and tracked runs over the test tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import hashing, ids
from loomspan.operators import artifacts, coefficients, facets, gtfs, lineage, runs, runset, schemas, views
from loomspan.operators.runset import RunSet
from loomspan.plans import admin
from loomspan.plans import views as plans
from loomspan.plans.catalog import Catalog
from loomspan.queries.core import ARTIFACT_KV, RUN_KV, artifact_kv, current_artifacts, current_runs, links, run_kv
from loomspan.queries.registry import CURRENT_ARTIFACTS, CURRENT_RUNS, LINKS, Registry, uuid_sql
from loomspan.runtime import recovery
from loomspan.runtime.tracker import Tracker
from loomspan.session import read_table, shared_dir
from loomspan.sources import drivers, manifests, sinks

query = Registry()


def work_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, deleted with the staged tables."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/work-{uuid.uuid4().hex}"


def filled_catalog(spark: SparkSession, folder: str, tables: Sequence[str] = ("run", "artifact", "run_artifact_link")) -> Catalog:
    """A catalog with the current rows of the test tables."""
    read = {
        "run": current_runs,
        "artifact": current_artifacts,
        "run_artifact_link": links,
        "run_config_kv": run_kv,
        "artifact_kv": artifact_kv,
        "artifact_schema_field": lambda s, f: read_table(s, f, "artifact_schema_field"),
        "artifact_schema_observation": lambda s, f: read_table(s, f, "artifact_schema_observation").withColumn("artifact_id", ids.artifact_id("artifact_id")).distinct(),
    }
    out = Catalog(spark, f"{work_folder(spark)}/catalog")
    for table in tables:
        out.append(table, read[table](spark, folder))
    return out


def table_counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(counts.items()), "table_name string, n long")


# --- the catalog --------------------------------------------------------------------------------------------------


@query(f"""WITH {CURRENT_RUNS} SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, count(*) AS n FROM cur GROUP BY 1, 2""")
def catalog_upsert(spark, folder):
    """Runs replaced by key: those that were running have failed."""
    c = filled_catalog(spark, folder, ["run"])
    c.upsert("run", c.read("run").where("status = 'running'").withColumn("status", F.lit("failed")))
    return c.read("run").groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUN_KV} SELECT namespace, value_type, count(*) AS n FROM kv GROUP BY 1, 2""")
def catalog_append(spark, folder):
    """Settings added in two parts, read as one table."""
    c, kv = filled_catalog(spark, folder, []), run_kv(spark, folder)
    odd = F.pmod(F.xxhash64("run_id"), F.lit(2)) == 1
    for part in (kv.where(odd), kv.where(~odd | odd.isNull())):
        c.append("run_config_kv", part)
    return c.read("run_config_kv").groupBy("namespace", "value_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CURRENT_RUNS} SELECT count(*) AS runs_before, (SELECT count(*) FROM cur WHERE status = 'completed') AS runs_after, (SELECT count(*) FROM cur WHERE status = 'completed') AS runs_in_copy FROM cur""")
def catalog_versions(spark, folder):
    """A reader of an older version keeps its rows; a snapshot and a compaction hold the current ones."""
    c = filled_catalog(spark, folder, ["run"])
    before = c.read("run")
    c.replace("run", before.where("status = 'completed'"))
    copy = f"{work_folder(spark)}/copy"
    c.snapshot(copy, {"note": "test"})
    c.compact("run")
    return spark.createDataFrame([(before.count(), c.read("run").count(), Catalog(spark, copy).read("run").count())], "runs_before long, runs_after long, runs_in_copy long")


_SELECTED = f"""{CURRENT_RUNS}, {CURRENT_ARTIFACTS}, {LINKS}, seeds AS (SELECT id FROM cur WHERE model_name = 'urbansim' AND status = 'failed'),
  sel AS (SELECT id FROM seeds UNION SELECT c.id FROM cur c JOIN sel ON c.parent_run_id = sel.id)"""
_GONE = "gone AS (SELECT artifact_id FROM lnk GROUP BY 1 HAVING bool_and(coalesce(run_id IN (SELECT id FROM sel), false)))"


def _seeds(c: Catalog) -> list[str]:
    return [r.id for r in c.read("run").where("model_name = 'urbansim' AND status = 'failed'").select("id").collect()]


@query(f"""WITH RECURSIVE {_SELECTED}, {_GONE} SELECT 'run' AS table_name, (SELECT count(*) FROM sel) AS n UNION ALL SELECT 'run_artifact_link', (SELECT count(*) FROM lnk WHERE run_id IN (SELECT id FROM sel)) UNION ALL SELECT 'artifact', (SELECT count(*) FROM art WHERE id IN (SELECT artifact_id FROM gone))""")
def purge_plan(spark, folder):
    """What a purge of some runs and all below them would delete."""
    c = filled_catalog(spark, folder)
    rows = admin.plan_purge(c, _seeds(c)).rows
    return table_counts(spark, {t: rows[t] for t in ("run", "run_artifact_link", "artifact")})


@query(f"""WITH RECURSIVE {_SELECTED}, {_GONE} SELECT 'run' AS table_name, (SELECT count(*) FROM cur WHERE id NOT IN (SELECT id FROM sel)) AS n UNION ALL SELECT 'run_artifact_link', (SELECT count(*) FROM lnk WHERE run_id IS NULL OR run_id NOT IN (SELECT id FROM sel)) UNION ALL SELECT 'artifact', (SELECT count(*) FROM art WHERE id NOT IN (SELECT artifact_id FROM gone WHERE artifact_id IS NOT NULL))""")
def purge_rest(spark, folder):
    """What is left after that purge."""
    c = filled_catalog(spark, folder)
    admin.purge(c, _seeds(c))
    return table_counts(spark, {t: c.read(t).count() for t in ("run", "run_artifact_link", "artifact")})


_EXPORTED = "ex AS (SELECT artifact_id AS id FROM lnk WHERE run_id IN (SELECT id FROM sel) UNION SELECT id FROM art WHERE run_id IN (SELECT id FROM sel))"


@query(f"""WITH RECURSIVE {_SELECTED}, {_EXPORTED} SELECT 'run' AS table_name, (SELECT count(*) FROM sel) AS n UNION ALL SELECT 'run_artifact_link', (SELECT count(*) FROM lnk WHERE run_id IN (SELECT id FROM sel)) UNION ALL SELECT 'artifact', (SELECT count(*) FROM art WHERE id IN (SELECT id FROM ex))""")
def export_subtree(spark, folder):
    """The rows of a catalog of its own with some runs and all below them."""
    c = filled_catalog(spark, folder)
    shard = admin.export(c, _seeds(c), f"{work_folder(spark)}/shard")
    return table_counts(spark, {t: shard.read(t).count() for t in ("run", "run_artifact_link", "artifact")})


@query(f"""WITH RECURSIVE {_SELECTED}, {_EXPORTED} SELECT 'conflicts_detected' AS table_name, (SELECT count(*) FROM seeds) AS n UNION ALL SELECT 'run', (SELECT count(*) FROM sel WHERE id NOT IN (SELECT id FROM seeds)) UNION ALL SELECT 'artifact', (SELECT count(*) FROM art WHERE id IN (SELECT id FROM ex))
  UNION ALL SELECT 'run_artifact_link', (SELECT count(*) FROM lnk WHERE run_id IN (SELECT id FROM sel))""")
def merge_shard(spark, folder):
    """An exported shard merged into a catalog that has some of its runs."""
    c = filled_catalog(spark, folder)
    seeds = _seeds(c)
    shard = admin.export(c, seeds, f"{work_folder(spark)}/shard")
    fresh = Catalog(spark, f"{work_folder(spark)}/fresh")
    fresh.append("run", c.read("run").where(F.col("id").isin(seeds)))
    done = admin.merge(fresh, shard, conflict="skip")
    return table_counts(spark, {t: done.get(t, 0) for t in ("conflicts_detected", "run", "artifact", "run_artifact_link")})


@query(f"""WITH {CURRENT_RUNS}, one AS (SELECT min(id) AS id FROM cur WHERE status = 'running') SELECT cur.id, CASE WHEN cur.id = one.id THEN 'failed' ELSE status END AS status FROM cur, one""")
def status_fixed(spark, folder):
    """One run that never ended set to failed."""
    c = filled_catalog(spark, folder, ["run"])
    one = c.read("run").where("status = 'running'").agg(F.min("id")).head()[0]
    if one is not None:
        admin.fix_status(c, one, "failed", reason="killed")
    return c.read("run").select("id", "status")


# --- lookups ------------------------------------------------------------------------------------------------------


@query(f"""WITH {CURRENT_ARTIFACTS}, k AS (SELECT key FROM art WHERE key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, key FROM art WHERE key IN (SELECT key FROM k) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1""")
def artifact_by_key(spark, folder):
    """The newest artifact of the key that occurs most."""
    known = current_artifacts(spark, folder)
    one = known.where("key IS NOT NULL").groupBy("key").count().orderBy(F.col("count").desc(), "key").head()
    return artifacts.get_artifact(known, one.key if one else "").select("id", "key")


@query(f"""WITH {CURRENT_ARTIFACTS}, h AS (SELECT hash FROM art WHERE hash IS NOT NULL AND run_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, hash FROM art WHERE run_id IS NOT NULL AND hash IN (SELECT hash FROM h) ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1""")
def artifact_by_hash(spark, folder):
    """The newest artifact of the content that occurs most."""
    known = current_artifacts(spark, folder)
    one = known.where("hash IS NOT NULL AND run_id IS NOT NULL").groupBy("hash").count().orderBy(F.col("count").desc(), "hash").head()
    return artifacts.latest_by_hash(known, one.hash if one else "").select("id", "hash")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT hash, id FROM art WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY created_at DESC NULLS LAST, id DESC) = 1""")
def newest_of_each_content(spark, folder):
    """The newest artifact of each content."""
    return artifacts.newest_per_hash(current_artifacts(spark, folder)).select("hash", "id")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT id, container_uri FROM art WHERE NOT coalesce(CASE WHEN json_valid(meta) THEN meta->>'$.is_ingested' END = 'true', false)
  AND (container_uri IS NULL OR container_uri NOT IN (SELECT container_uri FROM art WHERE driver = 'csv' AND container_uri IS NOT NULL))""")
def missing_artifact_files(spark, folder):
    """Artifacts whose file is not in a listing, here of the CSV files."""
    known = current_artifacts(spark, folder)
    listing = known.where("driver = 'csv' AND container_uri IS NOT NULL").select(F.col("container_uri").alias("path"))
    return artifacts.missing_files(known, listing).select("id", "container_uri")


@query(f"""WITH {ARTIFACT_KV}, one AS (SELECT artifact_id FROM akv WHERE artifact_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT artifact_id, key_path, namespace, value_type FROM akv WHERE artifact_id IN (SELECT artifact_id FROM one)""")
def artifact_facet_rows(spark, folder):
    """All facet rows of the artifact that has most."""
    kv = artifact_kv(spark, folder)
    one = kv.where("artifact_id IS NOT NULL").groupBy("artifact_id").count().orderBy(F.col("count").desc(), "artifact_id").limit(1)
    return facets.values_of(kv, one, entity="artifact_id", key="key_path").select("artifact_id", "key_path", "namespace", "value_type")


_CHOICE = "CASE source WHEN 'user_provided' THEN 0 WHEN 'file' THEN 1 WHEN 'duckdb' THEN 2 ELSE 3 END, observed_at DESC NULLS LAST, o.id DESC"


def _by_content(column: str):
    sql = f"""WITH {CURRENT_ARTIFACTS}, o AS (SELECT DISTINCT * REPLACE ({uuid_sql('artifact_id')} AS artifact_id) FROM artifact_schema_observation)
      SELECT art.{column}, schema_id FROM o JOIN art ON art.id = o.artifact_id WHERE art.{column} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY art.{column} ORDER BY {_CHOICE}) = 1"""

    def observed(spark, folder):
        seen = read_table(spark, folder, "artifact_schema_observation").withColumn("artifact_id", ids.artifact_id("artifact_id")).distinct()
        return schemas.observations_by(seen, current_artifacts(spark, folder), column).select(column, "schema_id")

    observed.__name__, observed.__doc__ = f"schema_by_{column}", f"The schema observed for each {column} of artifacts."
    return query(sql)(observed)


schema_by_hash, schema_by_content_id = _by_content("hash"), _by_content("content_id")


@query("""WITH f AS (SELECT schema_id, list(DISTINCT name) AS names FROM artifact_schema_field GROUP BY 1), one AS (SELECT names FROM f ORDER BY len(names) DESC, schema_id LIMIT 1)
  SELECT schema_id FROM f, one WHERE list_has_all(one.names, f.names) OR list_has_all(f.names, one.names)""")
def schemas_of_model(spark, folder):
    """Stored schemas that fit a model's fields, here those of the widest schema."""
    fields = read_table(spark, folder, "artifact_schema_field")
    one = fields.groupBy("schema_id").agg(F.collect_set("name").alias("names")).orderBy(F.size("names").desc(), "schema_id").head()
    return schemas.schemas_like(fields, one.names if one else [])


@query("""SELECT schema_id, 'people' AS from_table, name AS from_field, 'zone' AS to_table, 'id' AS to_field FROM (SELECT DISTINCT schema_id, name FROM artifact_schema_field WHERE ordinal_position = 1)""")
def schema_link_view(spark, folder):
    """Foreign keys of schemas under their table's name; here each first field points to a zone."""
    fields = read_table(spark, folder, "artifact_schema_field")
    relations = fields.where("ordinal_position = 1").select("schema_id", F.col("name").alias("field_name"), F.lit("zone").alias("target_table"), F.lit("id").alias("target_field")).distinct()
    known = fields.select(F.col("schema_id").alias("id"), F.lit('{"table_name": "people"}').alias("profile")).distinct()
    return schemas.schema_links(relations, known)


@query(f"""WITH {CURRENT_RUNS}, {CURRENT_ARTIFACTS}, {ARTIFACT_KV}, o AS (SELECT DISTINCT {uuid_sql('artifact_id')} AS artifact_id, schema_id FROM artifact_schema_observation), s AS (SELECT schema_id FROM o JOIN art ON art.id = o.artifact_id WHERE driver IN ('parquet', 'csv') AND run_id IN (SELECT id FROM cur) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
  SELECT art.id, art.key, art.driver FROM art JOIN cur ON cur.id = art.run_id WHERE driver IN ('parquet', 'csv') AND art.id IN (SELECT artifact_id FROM o WHERE schema_id IN (SELECT schema_id FROM s))
  AND art.id IN (SELECT artifact_id FROM akv WHERE key_path = 'is_final' AND value_type = 'bool')""")
def grouped_view_members(spark, folder):
    """The artifacts of a grouped view: under one of twenty schemas and with a facet."""
    c = filled_catalog(spark, folder, ["run", "artifact", "artifact_kv", "artifact_schema_observation"])
    seen = c.read("artifact_schema_observation").select("artifact_id", "schema_id").distinct()
    made = c.read("artifact").where("driver IN ('parquet', 'csv')").join(c.read("run").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    top = seen.join(made.select(F.col("id").alias("artifact_id")), "artifact_id").groupBy("schema_id").count().orderBy(F.col("count").desc(), "schema_id").limit(20)
    wanted = [r.schema_id for r in top.collect()]
    true, false = (plans.select_artifacts(c, wanted, predicates=[f"is_final={v}"]).select("id", "key", "driver") for v in ("true", "false"))
    return true.unionByName(false).distinct()


@query(f"""WITH {CURRENT_RUNS} SELECT id, model_name, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) - 1 AS place FROM cur QUALIFY place IN (0, 7)""")
def run_at_place(spark, folder):
    """Single runs of a set by their place."""
    known = RunSet(current_runs(spark, folder))
    found = []
    for at in (0, 7):
        try:
            found.append((known[at]["id"], known[at]["model_name"], at))
        except IndexError:
            pass
    return spark.createDataFrame(found, "id string, model_name string, place long")


@query(f"""WITH {CURRENT_RUNS}, k AS (SELECT model_name, year, count(*) AS n FROM cur GROUP BY 1, 2 HAVING count(*) = 1) SELECT cur.id, cur.model_name, cur.year FROM cur JOIN k ON k.model_name = cur.model_name AND k.year = cur.year ORDER BY cur.model_name, cur.year LIMIT 1""")
def run_that_is_alone(spark, folder):
    """Exactly one run of a model and year."""
    known = current_runs(spark, folder)
    one = known.where("model_name IS NOT NULL AND year IS NOT NULL").groupBy("model_name", "year").count().where("count = 1").orderBy("model_name", "year").head()
    if one is None:
        return known.select("id", "model_name", "year").limit(0)
    return runs.find_run(known, model_name=one.model_name, year=one.year).select("id", "model_name", "year")


@query(f"""WITH {RUN_KV} SELECT DISTINCT namespace, key FROM kv WHERE run_id IS NOT NULL""")
def setting_inventory(spark, folder):
    """The settings that occur in any run, of a set split in two."""
    kv = run_kv(spark, folder).where("run_id IS NOT NULL").select("run_id", "namespace", "key")
    odd = F.pmod(F.xxhash64("run_id"), F.lit(2)) == 1
    return kv.where(odd).select("namespace", "key").unionByName(kv.where(~odd).select("namespace", "key")).distinct()


@query(f"""WITH {CURRENT_RUNS}, n AS (SELECT year, count(*) FILTER (model_name = 'beam') AS a, count(*) FILTER (model_name = 'urbansim') AS b FROM cur WHERE year IS NOT NULL GROUP BY 1)
  SELECT year, a::DOUBLE AS "left", b::DOUBLE AS "right", (b - a)::DOUBLE AS delta, round(b / a, 4) AS ratio FROM n WHERE a > 0 AND b > 0""")
def metric_comparison(spark, folder):
    """A metric of two sides with difference and ratio."""
    counts = lambda model: current_runs(spark, folder).where((F.col("model_name") == model) & F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return runset.compare_metrics(counts("beam"), counts("urbansim"), ["year"], decimals=4)


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS id FROM orders GROUP BY 1, 2), p AS (SELECT f.o_custkey AS customer, f.id AS l, x.id AS r FROM o f JOIN o x USING (o_custkey) WHERE f.o_orderstatus = 'F' AND x.o_orderstatus = 'O'),
  q AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT '{"customer":' || customer || '}' AS align_key, round(coalesce(b.q, 0) - coalesce(a.q, 0), 4) AS delta FROM p LEFT JOIN q a ON a.k = l LEFT JOIN q b ON b.k = r WHERE a.q IS NOT NULL OR b.q IS NOT NULL""")
def pairwise_function(spark, folder):
    """A user's function over the rows of each pair of aligned runs."""
    one = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")).agg(F.max("o_orderkey").cast("string").alias("id"))
    pair = RunSet(one.where("status = 'F'")).align(RunSet(one.where("status = 'O'")), ["customer"])
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("run"), F.col("l_quantity").cast("double").alias("q"))

    def delta(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"delta": [round(float(b["q"].sum() - a["q"].sum()), 4)]})

    return pair.apply(lines, lines, "run", delta, "delta double").select("align_key", "delta")


@query("""SELECT v, row_number() OVER (ORDER BY r, v) AS place FROM (VALUES (0, NULL), (1, 'true'), (2, '7'), (4, 'a')) AS t(r, v)""")
def mixed_sort_order(spark, folder):
    """Values of mixed types in one order: null, boolean, number, text."""
    from pyspark.sql.window import Window

    kinds = {"string": None, "boolean": "true", "bigint": "7", "varchar": "a"}
    rows = [spark.range(1).select(F.lit(v).cast("string").alias("v"), runset.sort_rank(F.lit(v), "string" if k == "varchar" else k).alias("r")) for k, v in kinds.items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return both.select("v", F.row_number().over(Window.orderBy("r", "v")).cast("long").alias("place"))


# --- readers, writers, ingest -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice FROM orders""")
def parquet_scan(spark, folder):
    """Two columns of a Parquet file by its driver."""
    return drivers.load(spark, f"{folder}/orders.parquet", columns=["o_orderkey", "o_totalprice"])


@query("""SELECT n_nationkey, n_name FROM nation""")
def csv_scan(spark, folder):
    """A CSV file with its own separator, written and read back."""
    at = f"{work_folder(spark)}/nation.csv"
    read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(at, header=True, sep=";")
    out = drivers.load(spark, at, sep=";", columns=["n_nationkey", "n_name"])
    return out.select(F.col("n_nationkey").cast(read_table(spark, folder, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")


@query("""SELECT c_custkey, c_name FROM customer""")
def json_scan(spark, folder):
    """JSON lines written and read back."""
    at, table = f"{work_folder(spark)}/customer.jsonl", read_table(spark, folder, "customer").select("c_custkey", "c_name")
    table.write.json(at)
    return drivers.load(spark, at, lines=True, schema="c_custkey long, c_name string").select(F.col("c_custkey").cast(table.schema["c_custkey"].dataType).alias("c_custkey"), "c_name")


@query("""SELECT n_nationkey AS stop_sequence, CASE WHEN n_regionkey > 0 THEN n_name END AS stop_id, n_regionkey / 2 AS shape_dist_traveled FROM nation""")
def feed_member_types(spark, folder):
    """Texts of a transit table typed by its columns: whole numbers, numbers, empty texts null."""
    n = read_table(spark, folder, "nation")
    text = n.select(F.concat("n_nationkey", F.lit(".0")).alias("stop_sequence"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).otherwise("").alias("stop_id"), (F.col("n_regionkey") / 2).cast("string").alias("shape_dist_traveled"))
    return gtfs.typed_member(text, "stop_times")


@query("""SELECT o_orderstatus AS prov_run_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def cold_view_of_files(spark, folder):
    """A view over raw files, one per run."""
    at, orders = work_folder(spark), read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").parquet(at)
    sources = [views.Source(f"{at}/o_orderstatus={s}", "parquet", run_id=s) for s in ("F", "O", "P")]
    out = views.hybrid(spark, None, sources, missing="skip_silent", columns={"o_orderkey": "bigint", "o_totalprice": "double"})
    return out.groupBy("prov_run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT 'run_' || o_orderstatus AS prov_run_id, count(*) AS n, count(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS n_priority FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def ingested_rows(spark, folder):
    """Rows of two runs ingested into one table whose schema grows; content that is there is not ingested again."""
    c, orders = filled_catalog(spark, folder, []), read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    for s, columns in (("F", ["o_orderkey"]), ("O", ["o_orderkey", "o_orderpriority"]), ("F", ["o_orderkey"])):
        sinks.ingest(c, "orders", orders.where(F.col("o_orderstatus") == s).select(*columns), f"run_{s}", f"art_{s}", content_hash=s)
    return c.read("orders").groupBy("prov_run_id").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("n_priority"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 25""")
def rebuilt_from_ingested(spark, folder):
    """An artifact's file rebuilt from its ingested rows, and read where the file is gone."""
    c, part = filled_catalog(spark, folder, []), read_table(spark, folder, "part").where("p_size > 25").select("p_partkey", "p_name")
    sinks.ingest(c, "part", part, "r1", "a1")
    sinks.ingest(c, "part", part.limit(3), "r2", "a2")
    at = f"{work_folder(spark)}/part.parquet"
    sinks.materialize(c.read("part"), "a1", at)
    gone = drivers.load_artifact(spark, f"{at}.gone", "parquet", c.read("part"), "a1")
    return drivers.load(spark, at).join(gone.select("p_partkey"), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query(f"""WITH {CURRENT_ARTIFACTS} SELECT id, replace(container_uri, 'outputs://', '/data/out/') AS path, container_uri AS back FROM art WHERE container_uri IS NOT NULL AND starts_with(container_uri, 'outputs://')""")
def mounted_paths(spark, folder):
    """Addresses resolved through a mount, and paths brought back to the longest mount."""
    known = current_artifacts(spark, folder).where("startswith(container_uri, 'outputs://')")
    path = manifests.resolve(F.col("container_uri"), {"outputs": "/data/out"})
    return known.select("id", path.alias("path"), manifests.virtualize(path, {"data": "/data", "outputs": "/data/out"}).alias("back"))


@query(f"""WITH {CURRENT_ARTIFACTS}, f AS (SELECT DISTINCT replace(container_uri, 'outputs://', '') AS rel FROM art WHERE starts_with(container_uri, 'outputs://'))
  SELECT rel, split_part(rel, '/', 1) AS model, regexp_extract(rel, '^[^/]*/[^/]*/([^/]+?)\\.parquet$', 1) AS name FROM f WHERE regexp_full_match(rel, '[^/]+/[^/]+/[^/]+\\.parquet') AND NOT starts_with(rel, 'beam/')""")
def output_set_members(spark, folder):
    """The members of an output set by patterns, with the values in their names."""
    known = current_artifacts(spark, folder).where("startswith(container_uri, 'outputs://')")
    files = known.select(F.expr("substring(container_uri, 11)").alias("rel")).distinct()
    return manifests.output_set(files, ["**/*.parquet"], ["beam/**/*"], "{model}/*/{name}.parquet").select("rel", "model", "name")


@query("""SELECT p_type AS key, p_partkey::BIGINT AS row_index, p_retailprice AS value FROM part""")
def probability_cells(spark, folder):
    """The numeric cells of a sheet as rows."""
    sheet = read_table(spark, folder, "part").groupBy("p_partkey", "p_name").pivot("p_type", _types(spark, folder)).agg(F.first("p_retailprice"))
    rows = coefficients.probability_entries(sheet.withColumnRenamed("p_partkey", "row_index"))
    return rows.select("key", F.col("row_index").cast("long").alias("row_index"), "value")


def _types(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r[0] for r in read_table(spark, folder, "part").select("p_type").distinct().collect())


# --- identities and types -----------------------------------------------------------------------------------------


@query("""SELECT 'canonical' AS kind, sha256('{"a":[1,2.5,null],"b":{"x":true,"y":"\\u00e9"}}') AS hash UNION ALL SELECT 'config', sha256('{"a": [1, 2.5, null], "b": {"x": true}}')
  UNION ALL SELECT 'run_config', sha256('{"__run_fields__": {"iteration": 0, "model": "beam", "year": 2030}, "a": 1}')""")
def configuration_hashes(spark, folder):
    """Hashes of canonical JSON, of a configuration without excluded members, and of a run's configuration."""
    tree = {"b": {"y": "é", "x": True}, "a": (1, 2.5, None)}
    rows = [("canonical", hashing.facet_id(tree)), ("config", hashing.config_hash(tree, exclude=["y"])), ("run_config", hashing.run_config_hash({"a": 1}, "beam", 2030, 0))]
    return spark.createDataFrame(rows, "kind string, hash string")


@query("""SELECT * FROM (VALUES ('int', 'bigint', true), ('bigint', 'int', false), ('int', 'double', true), ('double', 'int', false), ('boolean', 'int', true), ('string', 'int', false), ('int', 'string', true), ('date', 'timestamp_ntz', true)) AS t(source, target, fits)""")
def type_fits(spark, folder):
    """Which types can be merged into which without loss."""
    of = lambda ddl: T.StructType.fromDDL(f"c {ddl}")[0].dataType
    pairs = [("int", "bigint"), ("bigint", "int"), ("int", "double"), ("double", "int"), ("boolean", "int"), ("string", "int"), ("int", "string"), ("date", "timestamp_ntz")]
    return spark.createDataFrame([(a, b, schemas.can_merge(of(a), of(b))) for a, b in pairs], "source string, target string, fits boolean")


@query("""SELECT * FROM (VALUES ('a', 'run_scoped'), ('b', 'run_link'), ('c', 'unscoped_cache')) AS t(name, mode)""")
def table_modes(spark, folder):
    """How rows of data tables belong to runs."""
    return spark.createDataFrame([(n, admin.table_mode(c)) for n, c in (("a", ["x", "prov_run_id", "run_id"]), ("b", ["run_id"]), ("c", ["content_hash"]))], "name string, mode string")


@query("""SELECT * FROM (VALUES (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) AS t(ordinal_position, name)""")
def file_profile(spark, folder):
    """The fields of a file's schema profile, stored with the observation and taken again for the same content."""
    c, df = filled_catalog(spark, folder, []), read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    first = schemas.observe(c, {"id": "a1", "key": "nation", "hash": "h"}, df)
    fields = c.read("artifact_schema_field").where(F.col("schema_id") == first)
    return fields.select("ordinal_position", "name")


@query("""SELECT 'x' AS line_1, 'y' AS line_2, 2 AS depth""")
def lineage_text(spark, folder):
    """Lineage as an indented text."""
    rows = [{"path": ["x"], "depth": 0, "artifact_id": "x", "run_id": None}, {"path": ["x", "y"], "depth": 1, "artifact_id": "y", "run_id": None}]
    lines = lineage.format_tree(rows).split("\n")
    return spark.createDataFrame([(lines[0], lines[1].strip(), len(lines[1]) - len(lines[1].lstrip()))], "line_1 string, line_2 string, depth int")


# --- tracked runs -------------------------------------------------------------------------------------------------


def totals(config, orders):
    """A step: order totals of one status."""
    return orders.where(F.col("o_orderstatus") == config["status"]).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def richest(config, totals):
    """A step: the customers above a limit."""
    return totals.where(F.col("total") > config["limit"])


@query("""WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT 'rich' AS step, false AS cache_hit, (SELECT count(*) FROM t WHERE total > 100000) AS n UNION ALL SELECT 'totals', false, count(*) FROM t UNION ALL SELECT 'totals_again', true, count(*) FROM t
  UNION ALL SELECT 'totals_other', false, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O')""")
def tracked_steps(spark, folder):
    """Two steps of a scenario, one of them again from the cache, and one with another configuration."""
    tracker = Tracker(spark, f"{work_folder(spark)}/tracked", fast_hash=True)
    given = {"inputs": {"orders": f"{folder}/orders.parquet"}, "outputs": ["totals"]}
    with tracker.scenario("query") as s:
        first = s.run(totals, config={"status": "F"}, **given)
        rich = s.run(richest, config={"limit": 100_000}, inputs=["totals"], outputs=["rich"])
        again = s.run(totals, config={"status": "F"}, **given)
        other = s.run(totals, config={"status": "O"}, **given)
    done = {"totals": (first, "totals"), "rich": (rich, "rich"), "totals_again": (again, "totals"), "totals_other": (other, "totals")}
    return spark.createDataFrame([(k, r.cache_hit, drivers.load(spark, r.outputs[out]).count()) for k, (r, out) in done.items()], "step string, cache_hit boolean, n long")


@query("""SELECT * FROM (VALUES ('first', 'copied', 'verified'), ('again', 'preserved', 'verified'), ('from archive', 'archived', 'verified'), ('from rows', 'rebuilt', 'verified'), ('gone', 'missing', 'unreadable')) AS t(step, how, identity)""")
def recovered_outputs(spark, folder):
    """The output of a run brought to new places: from its place, kept, from an archive, from ingested rows, not at all."""
    root = work_folder(spark)
    tracker = Tracker(spark, f"{root}/tracked")
    done = tracker.run(lambda config: read_table(spark, folder, "region").select("r_regionkey", "r_name").coalesce(1), "make", outputs=["regions"])
    made = recovery.outputs_of(tracker.catalog, done.run_id)[0]
    rows = []

    def note(step: str, to: str, **options) -> None:
        how = recovery.hydrate(tracker.catalog, done.run_id, f"{root}/{to}", **options)["regions"]
        whole = recovery.check_identity(made, f"{root}/{to}/regions.parquet", spark=spark).status
        rows.append((step, how, "verified" if how == "rebuilt" and whole == "mismatched" else whole))

    note("first", "h1")
    note("again", "h1")
    recovery.archive(tracker.catalog, done.run_id, f"{root}/archive")
    recovery.files.remove(spark, made["container_uri"])
    note("from archive", "h2", archives=[f"{root}/archive"])
    sinks.ingest(tracker.catalog, "regions", read_table(spark, folder, "region").select("r_regionkey", "r_name"), done.run_id, made["id"])
    note("from rows", "h3")
    tracker.catalog.drop("regions")
    note("gone", "h4")
    return spark.createDataFrame(rows, "step string, how string, identity string")


QUERIES, SQL = query.queries, query.sql
