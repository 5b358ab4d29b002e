"""Deeply nested JSON records to related flat tables, by structural variants.

One pass parses each document and visits it bottom-up like a tree automaton: a scalar's state is its type, an
object's state the sorted pairs of member name and state, a list's the set of its elements' states; a listed object
inside another is only its list's symbol, so states stay finite at any depth. The state of a listed object is its
structural variant. All variants share the supertype row (document, path, parent path, list, position, variant); each
list's variants are routed to one typed subtype table that keeps the path as key and the link to its parent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.types import SPARK_TYPES, promote

OBJECTS = "doc_id string, list_name string, position int, path string, parent_path string, variant string, members map<string,string>"
_ARROW = pa.schema(
    [("doc_id", pa.string()), ("list_name", pa.string()), ("position", pa.int32()), ("path", pa.string()), ("parent_path", pa.string()), ("variant", pa.string()), ("members", pa.map_(pa.string(), pa.string()))]
)


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _load(text: str):
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _opened(value):
    """The object whose JSON a text holds, at any number of encodings; anything else as it is."""
    inner = value
    while isinstance(inner, str) and inner.lstrip()[:1] in ("{", '"'):
        try:
            inner = _load(inner)
        except ValueError:
            return value
    return inner if isinstance(inner, dict) else value


def _scalar_state(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(1 << 63) <= value < 1 << 63 else "number"
    return "float" if isinstance(value, float) else "string"


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


class _Walk:
    """One document's listed objects. The stack is explicit: depth is bounded only by the parser."""

    def __init__(self, lists: frozenset[str]):
        self.lists, self.rows = lists, []

    def document(self, doc) -> list[tuple]:
        stack = [(_opened(doc), "", "")]
        while stack:
            value, path, parent = stack.pop()
            if isinstance(value, dict):
                for name, member in value.items():
                    self._member(stack, name, _opened(member), f"{path}.{name}" if path else name, parent)
            elif isinstance(value, list):
                stack += [(_opened(x), f"{path}[{i}]", parent) for i, x in enumerate(value)]
        return self.rows

    def _member(self, stack: list, name: str, value, path: str, parent: str) -> None:
        if name not in self.lists or not isinstance(value, (dict, list)):
            if isinstance(value, (dict, list)):
                stack.append((value, path, parent))
            return
        for i, item in enumerate(value if isinstance(value, list) else [value]):
            at, item = f"{path}[{i}]", _opened(item)
            if isinstance(item, dict):
                states, members = [], []
                for k, v in sorted(item.items()):
                    v = _opened(v)
                    states.append(f"{k}:{self._state(v, k)}")
                    if k not in self.lists:
                        members.append((k, _text(v)))
                self.rows.append((name, i, at, parent, "{" + ",".join(states) + "}", members))
                stack.append((item, at, at))
            elif isinstance(item, list):
                stack.append((item, at, parent))

    def _state(self, value, name: str) -> str:
        """State of a member. Listed lists are symbols of their own; unlisted ones are folded from the leaves up."""
        if name in self.lists and isinstance(value, (dict, list)):
            return f"[{name}]"
        out: dict[int, str] = {}
        stack = [(value, False)]
        while stack:
            v, ready = stack.pop()
            if not isinstance(v, (dict, list)):
                out[id(v)] = _scalar_state(v)
            elif not ready:
                stack.append((v, True))
                stack += [(x, False) for x in (v.values() if isinstance(v, dict) else v)]
            elif isinstance(v, dict):
                out[id(v)] = "{" + ",".join(f"{k}:" + (f"[{k}]" if k in self.lists else out[id(x)]) for k, x in sorted(v.items())) + "}"
            else:
                out[id(v)] = "[" + "|".join(sorted({out[id(x)] for x in v})) + "]"
        return out[id(value)]


def listed_objects(docs: DataFrame, lists: list[str]) -> DataFrame:
    """The supertype table of ``docs`` (doc_id, doc): one row per object that is an element of one of ``lists``, at any depth.

    Paths join member names by '.', positions are '[i]'; parent_path is the nearest listed object around, '' if none. A
    lone object counts as a list of one, null and scalar elements keep their position and give no row. A text that
    holds the JSON of an object stands for it. Documents that are null, blank or no valid JSON (NaN is none) give
    nothing, nor do those nested beyond the parser's depth. ``members`` holds the members that are no listed lists, as
    text, nested values as JSON.
    """
    names = frozenset(lists)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    doc = _load(text)
                except ValueError:
                    continue
                for row in _Walk(names).document(doc):
                    for column, value in zip(columns, (doc_id, *row)):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
                    columns = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return docs.select("doc_id", "doc").mapInArrow(rows, OBJECTS)


def variants(objects: DataFrame) -> DataFrame:
    """(list_name, variant, n_objects): the structural variants that occur."""
    return objects.groupBy("list_name", "variant").agg(F.count(F.lit(1)).alias("n_objects"))


def _members(state: str) -> list[tuple[str, str]]:
    """(member, state) of a variant's text, split outside nested states."""
    out, depth, start, body = [], 0, 0, state[1:-1]
    for i, c in enumerate(body + ","):
        depth += (c in "{[") - (c in "}]")
        if c == "," and depth == 0 and i > start:
            name, _, kind = body[start:i].partition(":")
            out.append((name, kind))
        if c == "," and depth == 0:
            start = i + 1
    return out


def _kinds(state: str, lists: list[str]) -> set[tuple[str, str]]:
    return {(name, "string" if kind[0] in "{[" else kind) for name, kind in _members(state) if name not in lists}


def member_kinds(objects: DataFrame, list_name: str, lists: list[str]) -> dict[str, set[str]]:
    """The kinds of each member over all variants of one list. Only the distinct pairs, the table's columns, come to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({pair for state in batch.column(0).to_pylist() for pair in _kinds(state, lists)})
            yield pa.RecordBatch.from_pydict({"member": pa.array([m for m, _ in pairs], pa.string()), "kind": pa.array([k for _, k in pairs], pa.string())})

    states = objects.where(F.col("list_name") == list_name).select("variant").distinct()
    kinds: dict[str, set[str]] = {}
    for r in states.mapInArrow(rows, "member string, kind string").distinct().collect():
        kinds.setdefault(r.member, set()).add(r.kind)
    return kinds


def typed_table(objects: DataFrame, list_name: str, kinds: dict[str, set[str]]) -> DataFrame:
    """The typed table of one list: doc_id, path, parent_path, position, variant and a column ``m_<member>`` per member.

    A column's type is the least one that holds all ``kinds`` of the member; nested members are JSON text, and so are
    the integers of a member with some beyond 64 bits. A value that
    can't be read in its column's type is null.
    """
    columns = [F.col("members")[n].try_cast(SPARK_TYPES[promote(k)]).alias(f"m_{n}") for n, k in sorted(kinds.items())]
    return objects.where(F.col("list_name") == list_name).select("doc_id", "path", "parent_path", "position", "variant", *columns)


def subtype_table(objects: DataFrame, list_name: str, states: list[str], lists: list[str]) -> DataFrame:
    """:func:`typed_table` by the kinds of ``states``, the list's variants."""
    kinds: dict[str, set[str]] = {}
    for name, kind in set().union(*(_kinds(s, lists) for s in states)):
        kinds.setdefault(name, set()).add(kind)
    return typed_table(objects, list_name, kinds)
