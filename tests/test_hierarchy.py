import random

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.operators.hierarchy import _contract, ancestor_paths, ancestors, descendants


def solve(spark, parent, **options):
    edges = spark.createDataFrame(list(parent.items()) or [(None, None)], "node string, parent string")
    return ancestor_paths(edges, **options)


def shapes():
    rng = random.Random(5)
    chain = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(300)}
    star = {"hub": None, **{f"s{i}": "hub" for i in range(200)}, **{f"t{i}": f"s{i}" for i in range(100)}}
    ring = {f"r{i}": f"r{(i + 1) % 37}" for i in range(37)} | {f"q{i}": f"q{i - 1}" if i else "r5" for i in range(20)}
    wild = {f"n{i}": rng.choice([None, "gone", f"n{rng.randrange(400)}"]) for i in range(400)}
    return {"chain": chain, "star": star, "ring": ring, "wild": wild, "self": {"a": "a", "b": "a"}, "one": {"a": None}, "empty": {}}


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("base", [3, 5000])
def test_paths_of_shapes(spark, name, base):
    parent = shapes()[name]
    got = {tuple(r) for r in ancestors(solve(spark, parent, base_rows=base, min_heavy=20)).collect()}
    assert got == brute.ancestors(parent)


def test_cyclic_nodes_are_told(spark):
    found = {r.node: (r.cyclic, list(r.path)) for r in solve(spark, {"a": "b", "b": "a", "c": "b", "d": None, "e": "d"}, base_rows=1).collect()}
    assert found == {"a": (True, ["b", "a"]), "b": (True, ["a", "b"]), "c": (True, ["b", "a"]), "d": (False, []), "e": (False, ["d"])}


def test_descendants(spark):
    paths = solve(spark, {"a": None, "b": "a", "c": "b", "d": "a"})
    assert {tuple(r) for r in descendants(paths).collect()} == {("a", 3, 2), ("b", 1, 1)}


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1, 12), min_size=1, max_size=12))
def test_one_bucket_is_solved_whole(links):
    parent = {str(i): None if p < 0 else str(p) for i, p in enumerate(links)}
    nodes = list(parent)
    exits, segs, cyclic = [parent[n] for n in nodes], [[parent[n]] if parent[n] else [] for n in nodes], [False] * len(nodes)
    _contract(nodes, exits, segs, cyclic)
    got = set()
    for n, e, s in zip(nodes, exits, segs):
        path = list(dict.fromkeys(s if e is None else s[:-1]))
        got |= {(n, a, i) for i, a in enumerate(path, 1)}
    assert got == brute.ancestors(parent)
