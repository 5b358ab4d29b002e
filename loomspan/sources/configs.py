"""Configuration files with includes, and their settings as typed rows."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CONFIG_ROW = "content_hash string, key string, value_type string, value_str string, value_num double, value_bool boolean"


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` overlaid by ``over``, member by member."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _scalar(text: str) -> Any:
    text = text.strip().rstrip(",").strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    named = {"true": True, "false": False, "null": None}
    if text.lower() in named:
        return named[text.lower()]
    for read in (int, float):
        try:
            return read(text)
        except ValueError:
            pass
    return text


def read_conf(path: str, _seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A block configuration (``a.b = 1``, ``a { b = 1 }``, ``include "file"``); later settings override earlier ones.

    Includes are taken relative to the file; one that includes itself again is an error.
    """
    at = Path(path).resolve()
    if str(at) in _seen:
        raise ValueError(f"include cycle: {' -> '.join([*_seen, str(at)])}")
    out: dict[str, Any] = {}
    stack: list[list[str]] = []
    for line in at.read_text(encoding="utf-8").splitlines():
        text = re.sub(r"\s*(?:#|//).*$", "", line).strip()
        if not text:
            continue
        include = re.fullmatch(r"include\s+(?:file\()?[\"']([^\"']+)[\"']\)?", text)
        if include:
            out = merged(out, read_conf(str(at.parent / include[1]), (*_seen, str(at))))
        elif text in ("}", "},"):
            stack.pop()
        elif text.endswith("{"):
            stack.append([p.strip().strip('"') for p in text[:-1].rstrip(" =:").split(".")])
        else:
            key, _, value = re.split(r"(\s*[=:]\s*)", text, maxsplit=1)
            tree: Any = _scalar(value)
            for part in reversed([p for names in stack for p in names] + [p.strip().strip('"') for p in key.split(".")]):
                tree = {part: tree}
            out = merged(out, tree)
    return out


def read_yaml(path: str, folders: tuple[str, ...] = (), _seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A YAML file with ``include_settings`` or ``inherit_settings`` resolved in its folder, then in ``folders``."""
    import yaml

    at = Path(path).resolve()
    if str(at) in _seen:
        raise ValueError(f"include cycle at {at}")
    own = yaml.safe_load(at.read_text(encoding="utf-8")) or {}
    base: dict[str, Any] = {}
    named = own.pop("include_settings", None) or (own.pop("inherit_settings", None) if isinstance(own.get("inherit_settings"), (str, list)) else None)
    for name in [named] if isinstance(named, str) else named or []:
        found = next((p for p in (at.parent / name, *(Path(f) / name for f in folders)) if p.exists()), None)
        if found is None:
            raise FileNotFoundError(name)
        base = merged(base, read_yaml(str(found), folders, (*_seen, str(at))))
    return merged(base, own)


def setting_rows(tree: Mapping[str, Any]) -> list[tuple]:
    """(key, value_type, value_str, value_num, value_bool) of every leaf; dots in names are not escaped, all numbers are ``num``."""
    rows: list[tuple] = []
    stack = [("", tree)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, Mapping):
            stack += reversed([(f"{path}.{k}" if path else str(k), x) for k, x in v.items()])
        elif v is None:
            rows.append((path, "null", None, None, None))
        elif isinstance(v, bool):
            rows.append((path, "bool", None, None, v))
        elif isinstance(v, (int, float)):
            rows.append((path, "num", None, float(v), None))
        elif isinstance(v, list):
            rows.append((path, "json", json.dumps(v), None, None))
        else:
            rows.append((path, "str", str(v), None, None))
    return rows


def setting_frame(spark: SparkSession, trees: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """The rows of several configurations by the hash of each."""
    return spark.createDataFrame([(h, *r) for h, t in trees.items() for r in setting_rows(t)], CONFIG_ROW)


def aliased(value: Any, roots: Mapping[str, str]) -> Any:
    """Settings with paths under one of ``roots`` (alias to folder) written as ``alias://rest``, the longest folder first."""
    if isinstance(value, Mapping):
        return {k: aliased(v, roots) for k, v in value.items()}
    if isinstance(value, list):
        return [aliased(v, roots) for v in value]
    if isinstance(value, str):
        for alias, root in sorted(roots.items(), key=lambda r: -len(r[1])):
            if value.startswith(root.rstrip("/") + "/"):
                return f"{alias}://{value[len(root.rstrip('/')) + 1 :]}"
    return value
