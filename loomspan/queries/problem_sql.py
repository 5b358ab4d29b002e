"""DuckDB SQL of the problem queries that SQL can express."""

from __future__ import annotations

from loomspan.queries.registry import CURRENT_ARTIFACTS, CURRENT_RUNS, trim_sql, uuid_sql

_FIELDS = ["parent_run_id", "status", "model_name", "description", "year", "iteration", "stage", "phase", "tags", "config_hash", "git_hash", "input_hash", "signature", "started_at", "ended_at"]


def _snapshot_field(name: str) -> str:
    text = f"payload->>'$.run.{name}'"
    if name in ("year", "iteration"):
        return f"({text})::DOUBLE"
    if name in ("started_at", "ended_at"):
        return f"epoch_us((CASE WHEN regexp_matches({text}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {text} ELSE ({text}) || 'Z' END)::TIMESTAMPTZ)"
    if name == "tags":
        return "list_sort(list_distinct(from_json(payload->'$.run.tags', '[\"VARCHAR\"]')))"
    return trim_sql(f"({text})") if name == "parent_run_id" else text


def _catalog_field(name: str) -> str:
    return {"year": "year::DOUBLE", "iteration": "iteration::DOUBLE", "started_at": "epoch_us(started_at)", "ended_at": "epoch_us(ended_at)", "tags": "list_sort(list_distinct(tags))"}.get(name, name)


P1 = f"""WITH {CURRENT_RUNS}, a AS (SELECT id, {', '.join(f'{_catalog_field(f)} AS {f}' for f in _FIELDS)} FROM cur),
  s AS (SELECT *, {trim_sql("(payload->>'$.run.id')")} AS rid FROM (SELECT * FROM run_snapshot WHERE json_valid(payload)) WHERE json_type(payload, '$.run.id') = 'VARCHAR'),
  l AS (SELECT * FROM s WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY written_at DESC) = 1),
  b AS (SELECT rid AS id, {', '.join(f'{_snapshot_field(f)} AS {f}' for f in _FIELDS)} FROM l)
  SELECT id AS run_id, 'missing_in_snapshot' AS difference FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'missing_in_run' FROM b WHERE id NOT IN (SELECT id FROM a)
  {' '.join(f"UNION ALL SELECT a.id, '{f}' FROM a JOIN b ON a.id = b.id WHERE a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS)}"""

_ORPHANS = f"""refs AS (SELECT table_name, ref_field, holder_id, kind_of, target_id, min(since) AS since FROM (
    SELECT 'run' AS table_name, 'parent_run_id' AS ref_field, {trim_sql('id')} AS holder_id, 'run' AS kind_of, {trim_sql('parent_run_id')} AS target_id, loaded_at AS since FROM run
    UNION ALL SELECT 'artifact', 'run_id', {uuid_sql('id')}, 'run', {trim_sql('run_id')}, loaded_at FROM artifact
    UNION ALL SELECT 'run_artifact_link', 'run_id', {uuid_sql('artifact_id')}, 'run', {trim_sql('run_id')}, loaded_at FROM run_artifact_link
    UNION ALL SELECT 'run_artifact_link', 'artifact_id', {trim_sql('run_id')}, 'artifact', {uuid_sql('artifact_id')}, loaded_at FROM run_artifact_link)
    WHERE target_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
  there AS (SELECT kind_of, id, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM (SELECT 'run' AS kind_of, {trim_sql('id')} AS id, loaded_at FROM run UNION ALL SELECT 'artifact', {uuid_sql('id')}, loaded_at FROM artifact) GROUP BY 1, 2),
  gone AS (SELECT entity, CASE WHEN entity = 'run' THEN {trim_sql('entity_id')} ELSE {uuid_sql('entity_id')} END AS id, max(purged_at) AS purged_at FROM purge_log GROUP BY 1, 2),
  found AS (SELECT table_name, ref_field, holder_id, target_id, CASE WHEN purged_at IS NOT NULL AND (last_at IS NULL OR purged_at > last_at) THEN 'deleted' WHEN t.id IS NULL THEN 'missing' WHEN first_at > since THEN 'late' END AS kind, strftime(since, '%Y-%m') AS period
    FROM refs LEFT JOIN there t ON t.kind_of = refs.kind_of AND t.id = target_id LEFT JOIN gone g ON g.entity = refs.kind_of AND g.id = target_id)"""

P2 = f"WITH {_ORPHANS} SELECT * FROM found WHERE kind IS NOT NULL"
P2_COUNTS = f"WITH {_ORPHANS} SELECT table_name, ref_field, kind, period, count(*) AS n_references, count(DISTINCT target_id) AS n_targets FROM found WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4"

_TREES = f"""{CURRENT_RUNS}, {CURRENT_ARTIFACTS}, e AS (SELECT 'run' AS tree, id, parent_run_id AS parent FROM cur WHERE parent_run_id IN (SELECT id FROM cur) UNION ALL SELECT 'artifact', id, parent_artifact_id FROM art WHERE parent_artifact_id IN (SELECT id FROM art)),
  up AS (SELECT tree, id AS node_id, parent AS ancestor_id, [parent] AS path FROM e UNION ALL SELECT up.tree, node_id, e.parent, list_append(path, e.parent) FROM up JOIN e ON e.tree = up.tree AND e.id = ancestor_id WHERE NOT list_contains(path, e.parent))"""
P3 = f"WITH RECURSIVE {_TREES} SELECT tree, node_id, ancestor_id, len(path)::INT AS steps FROM up"
P3_DESCENDANTS = f"WITH RECURSIVE {_TREES} SELECT tree, ancestor_id AS node_id, count(*) AS n_descendants, max(len(path))::INT AS max_steps FROM up GROUP BY 1, 2"

_KINDS = """CASE WHEN t IN ('int', 'int64', 'bigint', 'long', 'integer') THEN 'integer' WHEN t IN ('float', 'double', 'float64') THEN 'float' WHEN t IN ('str', 'string', 'varchar', 'text') THEN 'string' WHEN t IN ('bool', 'boolean') THEN 'boolean' END"""
_NUMBER = r"""CASE WHEN regexp_full_match(raw, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN raw::DOUBLE END"""
_PLAIN = r"""CASE WHEN num IS NOT NULL THEN (CASE WHEN round(num, 4) = 0 THEN '0' ELSE regexp_replace(printf('%.4f', num), '\.?0+$', '') END) END"""

P4 = f"""WITH rows AS (SELECT 'run' AS entity, {trim_sql('run_id')} AS entity_id, coalesce(namespace, '') AS namespace, key AS k, value_type, value_str, value_num, value_bool, value_json, created_at FROM run_config_kv
    UNION ALL SELECT 'artifact', {uuid_sql('artifact_id')}, coalesce(namespace, ''), key_path, value_type, value_str, value_num, value_bool, value_json, created_at FROM artifact_kv),
  last AS (SELECT *, lower({trim_sql('k')}) AS attr FROM rows WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, entity_id, namespace, lower({trim_sql('k')}) ORDER BY created_at DESC) = 1),
  read AS (SELECT *, lower({trim_sql('value_type')}) AS t, regexp_replace(coalesce(value_str, CASE WHEN isnan(value_num) THEN 'nan' ELSE value_num::VARCHAR END, value_bool::VARCHAR, CASE WHEN json_valid(value_json) AND json_type(value_json) NOT IN ('ARRAY', 'OBJECT') THEN value_json->>'$' END), '^\\s+|\\s+$', '', 'g') AS raw FROM last WHERE attr <> ''),
  typed AS (SELECT *, {_KINDS} AS kind, {_NUMBER} AS num FROM read),
  texts AS (SELECT *, CASE kind WHEN 'string' THEN raw WHEN 'float' THEN {_PLAIN} WHEN 'integer' THEN CASE WHEN num = floor(num) THEN {_PLAIN} END
    WHEN 'boolean' THEN CASE WHEN lower(raw) IN ('true', 'yes', '1') OR value_str IS NULL AND num = 1 THEN 'true' WHEN lower(raw) IN ('false', 'no', '0') OR value_str IS NULL AND num = 0 THEN 'false' END END AS value_text FROM typed)
  SELECT entity, entity_id, namespace, attr, value_text FROM texts WHERE value_text IS NOT NULL"""

# The declared profile is a fixed table, so its checks are written out column by column.
_ENUMS = {"mode": ["walk", "bike", "car", "transit", "ride_hail"], "city": ["Brackwater", "Eastmere", "Fenholm", "Gullhaven", "Lindrow", "Ostwick", "Saltby", "Tarnfield"]}
_RANGES = {"age": (0, 110), "income": (0, 500000), "trips": (0, 40)}
_PATTERNS = {"home_zone": "Z[0-9]{4}", "survey_date": "20[0-9]{2}-[0-9]{2}-[0-9]{2}"}
_REQUIRED = ["person_id", "age", "mode", "home_zone", "trips"]
_COLUMNS = ["person_id", "age", "income", "mode", "city", "home_zone", "survey_date", "trips"]


def _p5() -> str:
    aggs = [f"count(*) - count({c}) AS {c}_nulls" for c in _COLUMNS]
    aggs += [f"count(*) FILTER ({c} < {a} OR {c} > {b}) AS {c}_range, count(*) FILTER ({c} BETWEEN {a} AND {b}) AS {c}_in, sum({c}) FILTER ({c} BETWEEN {a} AND {b}) AS {c}_sum" for c, (a, b) in _RANGES.items()]
    aggs += [f"count(*) FILTER ({c} NOT IN ({', '.join(map(repr, v))})) AS {c}_enum, " + ", ".join(f"count(*) FILTER ({c} = {e!r}) AS {c}_e{i}" for i, e in enumerate(v)) for c, v in _ENUMS.items()]
    aggs += [f"count(*) FILTER (NOT regexp_full_match({c}, '{p}')) AS {c}_pattern" for c, p in _PATTERNS.items()]
    aggs.append("count(person_id) - count(DISTINCT person_id) AS person_id_double")
    kept = [f"{c}_nulls" for c in _COLUMNS] + [f"{c}_{x}" for c in _RANGES for x in ("in", "sum")] + [f"{c}_e{i}" for c, v in _ENUMS.items() for i in range(len(v))]
    lags = ", ".join(f"lag({c}) OVER w AS b_{c}" for c in ["n", *kept])
    moved = lambda c, tenths: f"abs({c} * b_n - b_{c} * n) * 10 > n * b_n * {tenths}"
    cases = [(c, "null", f"{c}_nulls > 0") for c in _REQUIRED] + [(c, "range", f"{c}_range > 0") for c in _RANGES] + [(c, "enum", f"{c}_enum > 0") for c in _ENUMS] + [(c, "pattern", f"{c}_pattern > 0") for c in _PATTERNS]
    cases.append(("person_id", "duplicate", "person_id_double > 0"))
    for c in _COLUMNS:
        shift = [moved(f"{c}_nulls", 1)] + [moved(f"{c}_e{i}", 2) for i in range(len(_ENUMS.get(c, ())))]
        if c in _RANGES:
            shift.append(f"abs({c}_sum / {c}_in - b_{c}_sum / b_{c}_in) > 0.25 * abs(b_{c}_sum / b_{c}_in)")
        cases.append((c, "shift", " OR ".join(f"coalesce({s}, false)" for s in shift)))
    union = " UNION ALL ".join(f"SELECT scenario_id, strftime(loaded_at, '%Y-%m-%d') AS load_date, '{c}' AS column_name, '{what}' AS finding FROM both_loads WHERE {when}" for c, what, when in cases)
    return f"""WITH p AS (SELECT * REPLACE (CASE WHEN isnan(income) THEN NULL ELSE income END AS income) FROM person), loads AS (SELECT scenario_id, loaded_at, count(*) AS n, {', '.join(aggs)} FROM p GROUP BY 1, 2),
  both_loads AS (SELECT *, {lags} FROM loads WINDOW w AS (PARTITION BY scenario_id ORDER BY loaded_at)) SELECT DISTINCT * FROM ({union})"""


P5 = _p5()

_METRICS = "p AS (SELECT * REPLACE (CASE WHEN isnan(income) THEN NULL ELSE income END AS income) FROM person), m AS (" + " UNION ALL ".join(
    [f"SELECT scenario_id, loaded_at, '{c}' AS column_name, 'null_share' AS metric, round((count(*) - count({c})) / count(*), 6) AS value FROM p GROUP BY 1, 2" for c in _COLUMNS]
    + [f"SELECT scenario_id, loaded_at, '{c}', 'mean', round(sum({c}::DOUBLE) FILTER ({c} BETWEEN {a} AND {b}) / nullif(count(*) FILTER ({c} BETWEEN {a} AND {b}), 0), 6) FROM p GROUP BY 1, 2" for c, (a, b) in _RANGES.items()]
) + ")"
P5_METRICS = f"WITH {_METRICS} SELECT * FROM m"
P5_ANOMALIES = f"""WITH {_METRICS}, k AS (SELECT *, avg(value) OVER w AS center, stddev_samp(value) OVER w AS deviation, count(value) OVER w AS loads FROM m
    WINDOW w AS (PARTITION BY scenario_id, column_name, metric ORDER BY loaded_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT scenario_id, loaded_at, column_name, metric, value, round(center, 6) AS center, round(deviation, 6) AS deviation, loads FROM k WHERE loads >= 3 AND abs(value - center) > greatest(3 * deviation, 1e-9 * greatest(1, abs(center)))"""

_SPELLED = "CASE WHEN t IN ('int', 'int64', 'bigint', 'long', 'integer') THEN 'integer' WHEN t IN ('float', 'double', 'float64') THEN 'float' WHEN t IN ('str', 'string', 'varchar', 'text') THEN 'string' WHEN t IN ('bool', 'boolean') THEN 'boolean' WHEN t IN ('timestamp', 'datetime') THEN 'timestamp' ELSE t END"
P7 = f"""WITH {CURRENT_ARTIFACTS}, o AS (SELECT {uuid_sql('artifact_id')} AS artifact_id, min(observed_at) AS since, arg_min(schema_id, observed_at) AS schema_id FROM artifact_schema_observation GROUP BY 1),
  f AS (SELECT DISTINCT schema_id, lower({trim_sql('name')}) AS name, {_SPELLED} AS kind, ordinal_position AS pos FROM (SELECT *, lower({trim_sql('logical_type')}) AS t FROM artifact_schema_field)),
  files AS (SELECT art.key AS artifact_key, o.artifact_id, schema_id, lag(schema_id) OVER (PARTITION BY art.key ORDER BY since, o.artifact_id) AS was FROM o JOIN art ON art.id = o.artifact_id WHERE art.key IS NOT NULL),
  p AS (SELECT * FROM files WHERE was IS NOT NULL),
  fresh AS (SELECT p.artifact_key, p.artifact_id, f.* FROM p JOIN f ON f.schema_id = p.schema_id WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.schema_id = p.was AND g.name = f.name)),
  gone AS (SELECT p.artifact_key, p.artifact_id, f.* FROM p JOIN f ON f.schema_id = p.was WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.schema_id = p.schema_id AND g.name = f.name)),
  ren AS (SELECT fresh.artifact_key, fresh.artifact_id, fresh.name, gone.name AS old FROM fresh JOIN gone ON gone.artifact_id = fresh.artifact_id AND gone.kind = fresh.kind AND gone.pos = fresh.pos)
  SELECT artifact_key, artifact_id, 'renamed' AS change, name AS field_name, old AS old_name FROM ren
  UNION ALL SELECT artifact_key, artifact_id, 'added', name, '' FROM fresh WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.artifact_id = fresh.artifact_id AND r.name = fresh.name)
  UNION ALL SELECT artifact_key, artifact_id, 'removed', name, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.artifact_id = gone.artifact_id AND r.old = gone.name)
  UNION ALL SELECT p.artifact_key, p.artifact_id, 'retyped', f.name, '' FROM p JOIN f ON f.schema_id = p.schema_id JOIN f g ON g.schema_id = p.was AND g.name = f.name WHERE g.kind <> f.kind"""


P3_PATHS = f"""WITH RECURSIVE {_TREES}, longest AS (SELECT tree, node_id, arg_max(path, len(path)) AS path FROM up GROUP BY 1, 2),
  n AS (SELECT ids.tree, ids.id AS node_id, coalesce(longest.path, []) AS path FROM (SELECT 'run' AS tree, id FROM cur UNION ALL SELECT 'artifact', id FROM art) ids LEFT JOIN longest ON longest.tree = ids.tree AND longest.node_id = ids.id),
  c AS (SELECT n.*, EXISTS (SELECT 1 FROM e WHERE e.tree = n.tree AND e.id = coalesce(n.path[-1], n.node_id)) AS cyclic FROM (SELECT tree, node_id, path FROM n) n)
  SELECT tree, node_id, array_to_string(list_append(list_reverse(path), node_id), '/') AS path, len(path)::INT AS depth, CASE WHEN NOT cyclic THEN coalesce(path[-1], node_id) END AS root_id, cyclic FROM c"""
P7_UNION = f"""WITH {CURRENT_ARTIFACTS}, o AS (SELECT {uuid_sql('artifact_id')} AS artifact_id, arg_min(schema_id, observed_at) AS schema_id FROM artifact_schema_observation GROUP BY 1),
  f AS (SELECT DISTINCT schema_id, lower({trim_sql('name')}) AS name, {_SPELLED} AS kind FROM (SELECT *, lower({trim_sql('logical_type')}) AS t FROM artifact_schema_field)),
  u AS (SELECT DISTINCT art.key AS artifact_key, o.schema_id FROM o JOIN art ON art.id = o.artifact_id WHERE art.key IS NOT NULL),
  g AS (SELECT artifact_key, name AS field_name, list(DISTINCT kind) AS kinds, count(*) AS n_schemas FROM u JOIN f USING (schema_id) GROUP BY 1, 2)
  SELECT artifact_key, field_name, CASE WHEN len(kinds) = 1 THEN kinds[1] WHEN len(list_filter(kinds, lambda k: k NOT IN ('integer', 'float'))) = 0 THEN 'float' WHEN len(list_filter(kinds, lambda k: k NOT IN ('date', 'timestamp'))) = 0 THEN 'timestamp' ELSE 'string' END AS kind, n_schemas FROM g"""


def _open(v: str, times: int = 3) -> str:
    """The JSON in a text that holds an object or a further text, up to three encodings deep."""
    for _ in range(times):
        v = f"coalesce(CASE WHEN json_type({v}) = 'VARCHAR' AND json_type(try_cast({v}->>'$' AS JSON)) IN ('OBJECT', 'VARCHAR') THEN try_cast({v}->>'$' AS JSON) END, {v})"
    return v


_LISTS = "('feeds', 'services', 'exceptions', 'input_artifact_changes', 'field_changes', 'steps')"
P6 = f"""WITH RECURSIVE {CURRENT_RUNS}, walk AS (SELECT id AS run_id, '' AS path, '' AS around, {_open('v')} AS v, false AS of_list, false AS listed FROM (SELECT id, try_cast(meta AS JSON) AS v FROM cur) WHERE v IS NOT NULL
    UNION ALL SELECT run_id, CASE WHEN json_type(v) = 'ARRAY' THEN path || '[' || m.k || ']' ELSE path || CASE WHEN path = '' THEN '' ELSE '.' END || m.k || CASE WHEN m.k IN {_LISTS} AND json_type(c) = 'OBJECT' THEN '[0]' ELSE '' END END,
      CASE WHEN listed THEN path ELSE around END, c, json_type(v) = 'OBJECT' AND m.k IN {_LISTS} AND json_type(c) = 'ARRAY', json_type(c) = 'OBJECT' AND (json_type(v) = 'ARRAY' AND of_list OR json_type(v) = 'OBJECT' AND m.k IN {_LISTS})
    FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'k': k, 'raw': json_extract(v, '$."' || k || '"')}}) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {{'k': i::VARCHAR, 'raw': json_extract(v, '$[' || i || ']')}}) END) AS m FROM walk),
      LATERAL (SELECT {_open('m.raw')} AS c) WHERE json_type(c) IN ('OBJECT', 'ARRAY'))
  SELECT run_id, path, around AS parent_path FROM walk WHERE listed"""

P1_SUMMARY = f"SELECT difference, count(*) AS n_runs FROM ({P1}) GROUP BY 1"

SQL = {"p1_found": P1, "p1_summary": P1_SUMMARY, "p2_found": P2, "p2_counts": P2_COUNTS, "p3_found": P3, "p3_descendants": P3_DESCENDANTS, "p3_paths": P3_PATHS, "p4_found": P4, "p5_found": P5, "p5_metrics": P5_METRICS, "p5_anomalies": P5_ANOMALIES, "p6_found": P6, "p7_found": P7, "p7_union_schema": P7_UNION}
