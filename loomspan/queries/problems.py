"""The queries of the general data problems (p1 to p7) over the catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import ids
from loomspan.functions.types import number_text
from loomspan.operators import drift, eav, hierarchy, nested, orphans, profile
from loomspan.operators.copydiff import Copy, diff_copies
from loomspan.queries.problem_sql import SQL as SQL
from loomspan.session import prepare, read_table, shared_dir, stage

RUN_TEXT = ["status", "model_name", "description", "stage", "phase", "config_hash", "git_hash", "input_hash", "signature"]
RUN_NUMBERS = ["year", "iteration"]
RUN_TIMES = ["started_at", "ended_at"]
RUN_FIELDS = ["parent_run_id", *RUN_TEXT, *RUN_NUMBERS, *RUN_TIMES, "tags"]


def _run_copy(spark: SparkSession, folder: str) -> Copy:
    run = read_table(spark, folder, "run")
    return Copy(
        run.select(
            ids.run_id("id").alias("run_id"),
            ids.run_id("parent_run_id").alias("parent_run_id"),
            *RUN_TEXT,
            *(number_text(F.col(c).cast("string")).alias(c) for c in RUN_NUMBERS),
            *(F.unix_micros(F.col(c).cast("timestamp")).cast("string").alias(c) for c in RUN_TIMES),
            F.to_json(F.struct(F.array_sort(F.array_distinct("tags")).alias("t"))).alias("tags"),
            "updated_at",
            "loaded_at",
        ),
        ["updated_at", "loaded_at"],
    )


def _snapshot_copy(spark: SparkSession, folder: str) -> Copy:
    # In brackets, so that text after the document makes the whole invalid.
    whole = read_table(spark, folder, "run_snapshot").select(F.try_parse_json(F.concat(F.lit("["), "payload", F.lit("]"))).alias("doc"), "written_at", "file_name")
    run = whole.where(F.expr("try_variant_get(doc, '$[1]', 'variant') IS NULL")).select(F.expr("try_variant_get(doc, '$[0].run', 'variant')").alias("v"), "written_at", "file_name")

    def text(name: str):
        return F.try_variant_get("v", f"$.{name}", "string")

    def instant(name: str):
        value = ids.strip(text(name))
        zoned = value.rlike(r"([zZ]|[+\-]\d{2}(:?\d{2})?)$") & value.rlike(r"\d:\d")
        moment = F.when(zoned, value.try_cast("timestamp")).otherwise(F.concat(value, F.lit("Z")).try_cast("timestamp"))
        return F.coalesce(F.unix_micros(moment).cast("string"), F.concat(F.lit("text:"), value))

    is_text = F.schema_of_variant(F.try_variant_get("v", "$.id", "variant")) == "STRING"
    tags = F.try_variant_get("v", "$.tags", "array<string>")
    return Copy(
        run.where(is_text).select(
            ids.run_id(text("id")).alias("run_id"),
            ids.run_id(text("parent_run_id")).alias("parent_run_id"),
            *(text(c).alias(c) for c in RUN_TEXT),
            *(number_text(ids.strip(text(c))).alias(c) for c in RUN_NUMBERS),
            *(instant(c).alias(c) for c in RUN_TIMES),
            F.coalesce(F.to_json(F.struct(F.array_sort(F.array_distinct(tags)).alias("t"))), text("tags")).alias("tags"),
            "written_at",
            "file_name",
        ),
        ["written_at", "file_name"],
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs missing in the catalog or the snapshots, and the fields of the others that differ."""
    prepare(spark)
    return diff_copies(_run_copy(spark, folder), _snapshot_copy(spark, folder), "run_id", RUN_FIELDS, missing_left="missing_in_run", missing_right="missing_in_snapshot")


def p1_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many runs each kind of difference touches."""
    return p1_found(spark, folder).groupBy("difference").agg(F.count(F.lit(1)).alias("n_runs"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    run, artifact, link, purge = (read_table(spark, folder, t) for t in ("run", "artifact", "run_artifact_link", "purge_log"))
    run_id, artifact_id = ids.run_id, ids.artifact_id
    refs = [
        orphans.pointers(run, "run", "parent_run_id", run_id("id"), run_id("parent_run_id"), "run"),
        orphans.pointers(artifact, "artifact", "run_id", artifact_id("id"), run_id("run_id"), "run"),
        orphans.pointers(link, "run_artifact_link", "run_id", artifact_id("artifact_id"), run_id("run_id"), "run"),
        orphans.pointers(link, "run_artifact_link", "artifact_id", run_id("run_id"), artifact_id("artifact_id"), "artifact"),
    ]
    rows = orphans.records(run, run_id("id"), "run").unionByName(orphans.records(artifact, artifact_id("id"), "artifact"))
    purged = purge.select(F.lower(ids.strip("entity")).alias("entity"), "entity_id", F.col("purged_at").alias("loaded_at"))
    purges = orphans.records(purged.where("entity = 'run'"), run_id("entity_id"), "run").unionByName(orphans.records(purged.where("entity = 'artifact'"), artifact_id("entity_id"), "artifact"))
    return orphans.orphan_references(orphans.union_all(refs), rows, purges)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pointer to a run or artifact that is missing, deleted or late, with its table and month."""
    found = _orphans(spark, folder)
    return found.select("table_name", "ref_field", "holder_id", F.expr("substring(target, instr(target, ':') + 1)").alias("target_id"), "kind", "period")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, case and month."""
    return orphans.orphan_counts(_orphans(spark, folder))


def _tree_paths(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    run = read_table(spark, folder, "run").select(ids.run_id("id").alias("id"), ids.run_id("parent_run_id").alias("parent"), F.struct("updated_at", "loaded_at").alias("v"))
    artifact = read_table(spark, folder, "artifact").select(ids.artifact_id("id").alias("id"), ids.artifact_id("parent_artifact_id").alias("parent"), F.struct("created_at", "loaded_at").alias("v"))
    edges = []
    for tree, df in (("run", run), ("artifact", artifact)):
        current = df.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("parent"), "v").alias("c"))
        edges.append(current.select(F.concat(F.lit(f"{tree}:"), "id").alias("node"), F.concat(F.lit(f"{tree}:"), F.col("c.parent")).alias("parent")))
    return hierarchy.ancestor_paths(edges[0].unionByName(edges[1]))


def _tree(col: str):
    return F.substring_index(col, ":", 1).alias("tree")


def _id(col: str):
    return F.expr(f"substring({col}, instr({col}, ':') + 1)")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each run or artifact with each of its ancestors and the fewest steps up to it."""
    found = hierarchy.ancestors(_tree_paths(spark, folder))
    return found.select(_tree("node"), _id("node").alias("node_id"), _id("ancestor").alias("ancestor_id"), "steps")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path from the root, depth and root of each run and artifact; on and below a cycle there is no root."""
    paths = _tree_paths(spark, folder)
    from_root = F.concat_ws("/", F.transform(F.reverse("path"), lambda x: F.regexp_replace(x, "^[a-z]+:", "")), _id("node"))
    root = F.when(~F.col("cyclic"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("node")))
    return paths.select(
        _tree("node"), _id("node").alias("node_id"), from_root.alias("path"), F.size("path").alias("depth"), F.regexp_replace(root, "^[a-z]+:", "").alias("root_id"), "cyclic"
    )


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """How many runs or artifacts lie below each one that has any, and how deep they reach."""
    return hierarchy.descendants(_tree_paths(spark, folder)).select(_tree("node"), _id("node").alias("node_id"), "n_descendants", "max_steps")


def _kv(spark: SparkSession, folder: str, entity: str, decimals: int | None = None) -> DataFrame:
    prepare(spark)
    if entity == "run":
        return eav.current_values(read_table(spark, folder, "run_config_kv"), ids.run_id("run_id"), F.col("key"), decimals=decimals)
    return eav.current_values(read_table(spark, folder, "artifact_kv"), ids.artifact_id("artifact_id"), F.col("key_path"), decimals=decimals)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the wide tables of runs and artifacts that aren't null, numbers with at most four decimals."""
    parts = [eav.melt(*eav.stitch(_kv(spark, folder, entity, decimals=4))).withColumn("entity", F.lit(entity)) for entity in ("run", "artifact")]
    return orphans.union_all(parts).select("entity", "entity_id", "namespace", "attr", F.col("value").alias("value_text"))


def p4_run_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run and namespace, one typed column per configuration key."""
    return eav.stitch(_kv(spark, folder, "run"))[0]


def p4_artifact_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per artifact and namespace, one typed column per facet key."""
    return eav.stitch(_kv(spark, folder, "artifact"))[0]


LOAD = ["scenario_id", "loaded_at"]


def _person(spark: SparkSession, folder: str) -> tuple[DataFrame, list[profile.Check]]:
    prepare(spark)
    return read_table(spark, folder, "person"), profile.declared(read_table(spark, folder, "field_profile").collect())


def _states(spark: SparkSession, person: DataFrame, checks: list[profile.Check]) -> DataFrame:
    """The merged states of all loads, from a store of states by file that the query fills."""
    store = profile.StateStore(f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}/states-{uuid.uuid4().hex}", LOAD, checks)
    store.update(person)
    return store.read(spark)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of the declared profile in each load of persons, and changes against the scenario's load before."""
    person, checks = _person(spark, folder)
    found = profile.findings(_states(spark, person, checks), *LOAD, checks)
    twice = profile.duplicate_loads(person, LOAD, checks)
    if twice is not None:
        found = found.unionByName(twice.withColumn("finding", F.lit("duplicate")))
    return found.select("scenario_id", F.date_format("loaded_at", "yyyy-MM-dd").alias("load_date"), "column_name", "finding").distinct()


def p5_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Null share and mean of each column and load, to six decimals."""
    person, checks = _person(spark, folder)
    found = profile.metrics(_states(spark, person, checks), LOAD, checks).where("metric <> 'distinct'")
    return found.withColumn("value", F.round("value", 6))


def p5_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated distinct values of each column and load, from sketches."""
    person, checks = _person(spark, folder)
    return profile.metrics(_states(spark, person, checks), LOAD, checks).where("metric = 'distinct'")


def p5_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Null shares and means of a load outside the control limits of the scenario's earlier loads."""
    person, checks = _person(spark, folder)
    rows = profile.metrics(_states(spark, person, checks), LOAD, checks).where("metric <> 'distinct'").withColumn("value", F.round("value", 6))
    return profile.control_limits(rows, *LOAD).select(*LOAD, "column_name", "metric", "value", F.round("center", 6).alias("center"), F.round("deviation", 6).alias("deviation"), "loads")


# The lists of run.meta whose objects become rows.
META_LISTS = ["feeds", "services", "exceptions", "input_artifact_changes", "field_changes", "steps"]


def _meta_objects(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    run = read_table(spark, folder, "run").select(ids.run_id("id").alias("doc_id"), "meta", "updated_at", "loaded_at").where("doc_id IS NOT NULL")
    current = run.groupBy("doc_id").agg(F.max_by(F.struct("meta"), F.struct("updated_at", "loaded_at")).alias("m")).select("doc_id", F.col("m.meta").alias("doc"))
    return nested.listed_objects(current, META_LISTS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each object of the listed lists in the current meta of a run, and the listed object around it."""
    return _meta_objects(spark, folder).select(F.col("doc_id").alias("run_id"), "path", "parent_path")


def p6_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The structural variants of the listed objects and how often each occurs."""
    return nested.variants(_meta_objects(spark, folder))


def _meta_table(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        objects = stage(_meta_objects(spark, folder), "objects")
        return nested.typed_table(objects, name, nested.member_kinds(objects, name, META_LISTS))

    query.__name__, query.__doc__ = f"p6_{name}", f"The typed table of the objects in lists named {name}."
    return query


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    observed = read_table(spark, folder, "artifact_schema_observation").select(ids.artifact_id("artifact_id").alias("artifact_id"), ids.strip("schema_id").alias("schema_id"), "observed_at").where("artifact_id IS NOT NULL")
    first = observed.groupBy("artifact_id").agg(F.min("observed_at").alias("first_at"), F.min_by("schema_id", F.struct("observed_at", "schema_id")).alias("schema_id"))
    artifact = read_table(spark, folder, "artifact").select(ids.artifact_id("id").alias("artifact_id"), F.col("key").alias("artifact_key"), "loaded_at").where("artifact_id IS NOT NULL")
    keys = artifact.groupBy("artifact_id").agg(F.max_by("artifact_key", F.struct("loaded_at", "artifact_key")).alias("artifact_key"))
    schemas = drift.header_schemas(read_table(spark, folder, "artifact_schema_field").withColumn("schema_id", ids.strip("schema_id")))
    return first.join(keys, "artifact_id"), schemas


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of schema between neighbouring files of one artifact key."""
    files, schemas = _files(spark, folder)
    return drift.drift_log(files, schemas, "artifact_key", "artifact_id", "first_at")


def p7_union_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The union schema of each artifact key."""
    return drift.union_schemas(*_files(spark, folder), "artifact_key")


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all files of each artifact key as one table: renamed fields are one column, in its promoted type."""
    files, schemas = _files(spark, folder)
    files = stage(files, "files")
    log = drift.drift_log(files, schemas, "artifact_key", "artifact_id", "first_at")
    columns = stage(drift.column_names(files, schemas, log, "artifact_key", "artifact_id", "first_at"), "columns")
    records = read_table(spark, folder, "dataset_record").select(ids.artifact_id("artifact_id").alias("artifact_id"), "row_no", "record").join(files.select("artifact_id", "artifact_key"), "artifact_id")
    union = drift.union_schemas(files, schemas, "artifact_key", columns, "artifact_id")
    return drift.unified_values(drift.renamed_members(records, columns, "artifact_key", "artifact_id"), union, "artifact_key", "artifact_id")


def p7_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of files that go into a column of a later name."""
    files, schemas = _files(spark, folder)
    files = stage(files, "files")
    log = drift.drift_log(files, schemas, "artifact_key", "artifact_id", "first_at")
    return drift.column_names(files, schemas, log, "artifact_key", "artifact_id", "first_at")


META_TABLES = {f.__name__: f for f in map(_meta_table, META_LISTS)}
QUERIES = {
    f.__name__: f
    for f in (
        *(p1_found, p1_summary, p2_found, p2_counts, p3_found, p3_paths, p3_descendants, p4_found, p4_run_wide, p4_artifact_wide),
        *(p5_found, p5_metrics, p5_distinct, p5_anomalies, p6_found, p6_variants, p7_found, p7_union_schema, p7_columns, p7_unified),
    )
} | META_TABLES
