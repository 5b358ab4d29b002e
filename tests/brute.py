"""Plain Python answers to the problem queries, from lists of row dictionaries; for small inputs only."""

import json
import math
import re
from collections import defaultdict
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

RUN_FIELDS = ["parent_run_id", "status", "model_name", "description", "year", "iteration", "stage", "phase", "tags", "config_hash", "git_hash", "input_hash", "signature", "started_at", "ended_at"]


def run_id(x):
    return (x.strip() or None) if x is not None else None


def artifact_id(x):
    x = run_id(x)
    if x is None:
        return None
    bare = re.sub(r"[{}-]", "", x.lower())
    return "-".join((bare[:8], bare[8:12], bare[12:16], bare[16:20], bare[20:])) if re.fullmatch("[0-9a-f]{32}", bare) else x.lower()


def latest(rows, key, order):
    out = {}
    for r in rows:
        k = key(r)
        if k is not None and (k not in out or order(r) >= order(out[k])):
            out[k] = r
    return out


def p1(run, run_snapshot):
    def number(x):
        return None if x is None else Decimal(str(x).strip())

    def instant(x):
        if x is None:
            return None
        t = x if isinstance(x, datetime) else datetime.fromisoformat(x.strip())
        return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)

    def canon(r):
        out = {f: r.get(f) for f in RUN_FIELDS}
        out |= {f: number(out[f]) for f in ("year", "iteration")} | {f: instant(out[f]) for f in ("started_at", "ended_at")}
        return out | {"parent_run_id": run_id(out["parent_run_id"]), "tags": None if out["tags"] is None else frozenset(out["tags"])}

    snaps = []
    for r in run_snapshot:
        try:
            doc = json.loads(r["payload"])
        except (TypeError, ValueError):
            continue
        inner = doc.get("run") if isinstance(doc, dict) else None
        if isinstance(inner, dict) and isinstance(inner.get("id"), str) and inner["id"].strip():
            snaps.append(inner | {"_w": r["written_at"]})
    a = latest(run, lambda r: run_id(r["id"]), lambda r: r["updated_at"])
    b = latest(snaps, lambda r: run_id(r["id"]), lambda r: r["_w"])
    out = {(k, "missing_in_snapshot") for k in a.keys() - b.keys()} | {(k, "missing_in_run") for k in b.keys() - a.keys()}
    for k in a.keys() & b.keys():
        x, y = canon(a[k]), canon(b[k])
        out |= {(k, f) for f in RUN_FIELDS if x[f] != y[f]}
    return out


def p2(run, artifact, run_artifact_link, purge_log):
    refs = {}

    def add(t, f, holder, target, kind, at):
        if target is not None:
            k = (t, f, holder, target, kind)
            refs[k] = min(refs.get(k, at), at)

    for r in run:
        add("run", "parent_run_id", run_id(r["id"]), run_id(r["parent_run_id"]), "run", r["loaded_at"])
    for r in artifact:
        add("artifact", "run_id", artifact_id(r["id"]), run_id(r["run_id"]), "run", r["loaded_at"])
    for r in run_artifact_link:
        add("run_artifact_link", "run_id", artifact_id(r["artifact_id"]), run_id(r["run_id"]), "run", r["loaded_at"])
        add("run_artifact_link", "artifact_id", run_id(r["run_id"]), artifact_id(r["artifact_id"]), "artifact", r["loaded_at"])
    seen, purged = defaultdict(list), defaultdict(list)
    for kind, rows, f in (("run", run, run_id), ("artifact", artifact, artifact_id)):
        for r in rows:
            seen[kind, f(r["id"])].append(r["loaded_at"])
    for r in purge_log:
        purged[r["entity"], (run_id if r["entity"] == "run" else artifact_id)(r["entity_id"])].append(r["purged_at"])
    out = set()
    for (t, f, holder, target, kind), at in refs.items():
        rows, gone = seen.get((kind, target)), purged.get((kind, target))
        case = None
        if gone and (not rows or max(gone) > max(rows)):
            case = "deleted"
        elif not rows:
            case = "missing"
        elif min(rows) > at:
            case = "late"
        if case:
            out.add((t, f, holder, target, case, at.strftime("%Y-%m")))
    return out


def ancestors(parent):
    """(node, ancestor, steps) of a dictionary node -> parent."""
    out = set()
    for n in parent:
        seen, at = {}, parent[n]
        while at in parent and at not in seen:
            seen[at] = len(seen) + 1
            at = parent[at]
        out |= {(n, a, d) for a, d in seen.items()}
    return out


def p3(run, artifact):
    runs = latest(run, lambda r: run_id(r["id"]), lambda r: r["updated_at"])
    arts = latest(artifact, lambda r: artifact_id(r["id"]), lambda r: r["loaded_at"])
    return {("run", *x) for x in ancestors({k: run_id(r["parent_run_id"]) for k, r in runs.items()})} | {("artifact", *x) for x in ancestors({k: artifact_id(r["parent_artifact_id"]) for k, r in arts.items()})}


# The spellings of the value types.
TYPES = {
    **dict.fromkeys(("int", "int64", "bigint", "long", "integer"), "integer"),
    **dict.fromkeys(("float", "double", "float64"), "float"),
    **dict.fromkeys(("str", "string", "varchar", "text"), "string"),
    **dict.fromkeys(("bool", "boolean"), "boolean"),
    **dict.fromkeys(("timestamp", "datetime"), "timestamp"),
    "date": "date",
}


def kv_text(r):
    kind = TYPES.get((r["value_type"] or "").strip().lower())
    raw = next((r[c] for c in ("value_str", "value_num", "value_bool") if r[c] is not None), None)
    if raw is None and r["value_json"] is not None:
        try:
            raw = json.loads(r["value_json"])
        except ValueError:
            return None
    if raw is None or kind is None or isinstance(raw, (dict, list)):
        return None
    if kind == "boolean":
        text = {True: "true", False: "false"}.get(raw) if isinstance(raw, bool) else str(raw).strip().lower()
        return {"true": "true", "yes": "true", "1": "true", "1.0": "true", "false": "false", "no": "false", "0": "false", "0.0": "false"}.get(text)
    if kind == "string":
        return raw.strip() if isinstance(raw, str) else str(raw)
    try:
        d = Decimal(str(raw).strip())
    except InvalidOperation:
        return None
    if not d.is_finite() or isinstance(raw, bool) or kind == "integer" and d != d.to_integral_value():
        return None
    text = f"{d.quantize(Decimal('0.0001')):f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def p4(run_config_kv, artifact_kv):
    out = set()
    for entity, rows, key, attr in (("run", run_config_kv, lambda r: run_id(r["run_id"]), "key"), ("artifact", artifact_kv, lambda r: artifact_id(r["artifact_id"]), "key_path")):
        cur = latest(rows, lambda r: (key(r), r["namespace"] or "", r[attr].strip().lower()) if key(r) and r[attr] else None, lambda r: r["created_at"])
        out |= {(entity, *k, t) for k, r in cur.items() if (t := kv_text(r)) is not None}
    return out


def p5(person, field_profile):
    loads = defaultdict(list)
    for r in person:
        loads[r["scenario_id"], r["loaded_at"]].append({k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()})
    out, before = set(), {}
    for (scn, at), rows in sorted(loads.items()):
        n = len(rows)
        now = {}
        for f in field_profile:
            c, stats = f["name"], json.loads(f["stats"] or "{}")
            values = [r[c] for r in rows]
            there = [v for v in values if v is not None]
            tell = lambda what, c=c: out.add((scn, at.strftime("%Y-%m-%d"), c, what))
            if not f["nullable"] and len(there) < n:
                tell("null")
            ranged = "min" in stats and "max" in stats
            if any("min" in stats and v < stats["min"] or "max" in stats and v > stats["max"] for v in there):
                tell("range")
            enum = list(f["enum_values"]) if f["is_enum"] else []
            if enum and any(v not in enum for v in there):
                tell("enum")
            if "pattern" in stats and any(not re.fullmatch(stats["pattern"], v) for v in there):
                tell("pattern")
            if stats.get("unique") and len(set(there)) < len(there):
                tell("duplicate")
            inside = [v for v in there if ranged and stats["min"] <= v <= stats["max"]]
            now[c] = (n, n - len(there), {e: there.count(e) for e in enum}, sum(inside) / len(inside) if inside else None)
            if scn in before:
                n0, null0, enum0, mean0 = before[scn][c]
                if 10 * abs(now[c][1] * n0 - null0 * n) > n * n0 or any(5 * abs(now[c][2][e] * n0 - enum0[e] * n) > n * n0 for e in enum):
                    tell("shift")
                if mean0 is not None and now[c][3] is not None and abs(now[c][3] - mean0) > 0.25 * abs(mean0):
                    tell("shift")
        before[scn] = now
    return out


LISTS = {"feeds", "services", "exceptions", "input_artifact_changes", "field_changes", "steps"}


def _object(x):
    """x, or the object whose JSON the text x holds, at any number of encodings."""
    y = x
    while isinstance(y, str):
        try:
            y = json.loads(y)
        except ValueError:
            return x
    return y if isinstance(y, dict) else x


def p6(run):
    out = set()
    for k, r in latest(run, lambda r: run_id(r["id"]), lambda r: r["updated_at"]).items():
        try:
            doc = json.loads(r["meta"])
        except (TypeError, ValueError):
            continue

        def walk(x, path, parent, k=k):
            x = _object(x)
            if isinstance(x, dict):
                for name, v in x.items():
                    at = f"{path}.{name}" if path else name
                    v = _object(v)
                    if name in LISTS and isinstance(v, dict):
                        v = [v]
                    if name in LISTS and isinstance(v, list):
                        for i, e in enumerate(v):
                            e = _object(e)
                            if isinstance(e, dict):
                                out.add((k, f"{at}[{i}]", parent))
                                walk(e, f"{at}[{i}]", f"{at}[{i}]")
                            else:
                                walk(e, f"{at}[{i}]", parent)
                    else:
                        walk(v, at, parent)
            elif isinstance(x, list):
                for i, e in enumerate(x):
                    walk(e, f"{path}[{i}]", parent)

        walk(doc, "", "")
    return out


def p7(artifact, artifact_schema_observation, artifact_schema_field):
    keys = {artifact_id(r["id"]): r["key"] for r in artifact}
    fields = defaultdict(dict)
    for r in artifact_schema_field:
        kind = (r["logical_type"] or "").strip().lower()
        fields[r["schema_id"]][r["name"].strip().lower()] = (TYPES.get(kind, kind), r["ordinal_position"])
    first = {}
    for r in artifact_schema_observation:
        a = artifact_id(r["artifact_id"])
        if a not in first or r["observed_at"] < first[a][0]:
            first[a] = (r["observed_at"], r["schema_id"])
    files = defaultdict(list)
    for a, (at, schema) in first.items():
        if a in keys and keys[a] is not None:
            files[keys[a]].append((at, a, schema))
    out = set()
    for key, own in files.items():
        own.sort()
        for (_, _, old), (_, a, new) in zip(own, own[1:]):
            x, y = fields[old], fields[new]
            gone, fresh = sorted(x.keys() - y.keys()), sorted(y.keys() - x.keys())
            for name in fresh:
                match = [g for g in gone if y[name][1] is not None and x[g] == y[name]]
                if match:
                    gone.remove(match[0])
                    out.add((key, a, "renamed", name, match[0]))
                else:
                    out.add((key, a, "added", name, ""))
            out |= {(key, a, "removed", name, "") for name in gone}
            out |= {(key, a, "retyped", name, "") for name in x.keys() & y.keys() if x[name][0] != y[name][0]}
    return out
