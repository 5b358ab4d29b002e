"""Facet predicates such as ``year>=2030`` or ``simulate.mode=fast``, parsed and turned into columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """``kind`` is bool, null, num or str. What stands before the first dot of the key is always the namespace."""

    key: str
    op: str
    kind: str
    value: Any
    namespace: str | None = None


def literal(text: str) -> tuple[str, Any]:
    """The kind and value of a literal: true, false, null, a number, or else text."""
    text = text.strip()
    low = text.lower()
    known = {"true": ("bool", True), "false": ("bool", False), "null": ("null", None)}
    if low in known:
        return known[low]
    for read in (int,) if "." not in text and "e" not in low else (float,):
        try:
            return "num", read(text)
        except ValueError:
            pass
    return "str", text


def parse(expression: str) -> Predicate:
    """A predicate of the form key=value, key>=value or key<=value; the first two-sign operator in the text counts."""
    for op in (">=", "<=", "="):
        key, found, value = expression.strip().partition(op)
        if found and key:
            break
    else:
        raise ValueError(f"no predicate: {expression!r}; expected key=value, key>=value or key<=value")
    key, value = key.strip(), value.strip()
    if not key or not value:
        raise ValueError(f"a predicate needs a key and a value: {expression!r}")
    kind, read = literal(value)
    if op != "=" and kind != "num":
        raise ValueError(f"{op} needs a number: {expression!r}")
    space, dot, rest = key.partition(".")
    return Predicate(rest, op, kind, read, space) if dot and space and rest else Predicate(key, op, kind, read)


def kv_condition(p: Predicate, key: str = "key_path", namespace: str | None = None) -> Column:
    """The condition that a row of typed values meets ``p``; numbers match integer and float rows alike."""
    hit = F.col(key) == p.key
    space = p.namespace or namespace
    if space is not None:
        hit &= F.col("namespace") == space
    if p.kind == "null":
        return hit & (F.col("value_type") == "null")
    if p.kind == "bool":
        return hit & (F.col("value_type") == "bool") & (F.col("value_bool") == p.value)
    if p.kind == "str":
        return hit & (F.col("value_type") == "str") & (F.col("value_str") == p.value)
    number = F.col("value_num")
    compare = {"=": number == float(p.value), ">=": number >= float(p.value), "<=": number <= float(p.value)}[p.op]
    return hit & F.col("value_type").isin("int", "float") & compare


def scope_condition(scope: str | None, *columns: str) -> Column:
    """One of the columns is the scope itself or starts with it and two underscores; a blank scope holds everything."""
    if scope is None or not scope.strip():
        return F.lit(True)
    scope = scope.strip()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce((F.col(c) == scope) | F.col(c).startswith(f"{scope}__"), F.lit(False))
    return hit


def loose_match(actual: Column, expected: Any) -> Column:
    """Equal as whole numbers where both are such, else as text without case and surrounding blanks; None matches all."""
    if expected is None:
        return F.lit(True)
    text = F.lower(F.trim(actual.cast("string")))
    wanted = str(expected).strip().lower()
    same = text == wanted
    if wanted.lstrip("+-").isdigit():
        same = F.coalesce(text.try_cast("bigint") == int(wanted), same)
    return F.coalesce(same, F.lit(False))
