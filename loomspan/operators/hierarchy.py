"""Full ancestor paths of parent-child rows of unknown depth, by contraction of partition-local chains.

One level of contraction places every node in a bucket, follows parents as long as they lie in the same bucket, and
keeps for each node the fragment path walked and the exit: the first node outside. Only exits are nodes of the quotient
forest, which the same step then contracts again. A node is placed by its own hash or, by a coin that differs at each
level, by that of its parent, so every level joins about a quarter of the links left, whatever the shape: chains too
shrink geometrically. A quotient of at most ``base_rows`` nodes is solved in one task. Coming back, each level appends
the path of the exit to the fragment path. A cycle ends up inside one bucket at some level and is closed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_keys, is_heavy, join_unique
from loomspan.session import shuffle_partitions, stage

_SCHEMA = "node string, exit string, seg array<string>, cyclic boolean"
_ARROW = pa.schema([("node", pa.string()), ("exit", pa.string()), ("seg", pa.list_(pa.string())), ("cyclic", pa.bool_())])
BASE_ROWS = 5_000
BUCKET_ROWS = 50_000


def _contract(nodes: list[str], exits: list[str | None], segs: list[list[str]], cyclic: list[bool]) -> None:
    """Follow the chains within one bucket, in place; a chain that comes back to itself has no exit."""
    local = {n: i for i, n in enumerate(nodes)}
    state = bytearray(len(nodes))
    for start in range(len(nodes)):
        path, at = [], start
        while at is not None and not state[at]:
            state[at] = 1
            path.append(at)
            at = local.get(exits[at])
        if at is not None and state[at] == 1:
            ring = path[path.index(at) :]
            del path[len(path) - len(ring) :]
            own = [segs[i] for i in ring]
            for k, i in enumerate(ring):
                segs[i] = [x for s in own[k:] + own[:k] for x in s]
                exits[i], cyclic[i], state[i] = None, True, 2
        for i in reversed(path):
            to = local.get(exits[i])
            if to is not None:
                segs[i], exits[i], cyclic[i] = segs[i] + segs[to], exits[to], cyclic[to]
            state[i] = 2


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    nodes, exits, segs, cyclic = (table[c].to_pylist() for c in ("node", "exit", "seg", "cyclic"))
    _contract(nodes, exits, segs, cyclic)
    for at in range(0, len(nodes), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 5000], f.type) for x, f in zip((nodes, exits, segs, cyclic), _ARROW)], schema=_ARROW)


def _placed(level: int, buckets: int, heavy: list) -> Column:
    coin = F.xxhash64(F.lit(level), "node").bitwiseAND(F.lit(1)) == 0
    with_parent = coin & F.col("exit").isNotNull() & ~is_heavy("exit", heavy)
    return F.pmod(F.xxhash64(F.when(with_parent, F.col("exit")).otherwise(F.col("node"))), F.lit(buckets))


def ancestor_paths(edges: DataFrame, base_rows: int = BASE_ROWS, min_heavy: int = 2) -> DataFrame:
    """(node, path, cyclic) for ``edges`` (node, parent), one row per node; path lists the ancestors, nearest first.

    A parent that is no node ends the path and isn't listed. On and below a cycle the path ends before it would repeat;
    a member of a cycle ends with itself. ``cyclic`` tells these nodes. Null nodes are left out.
    """
    spark = edges.sparkSession
    nodes = edges.where("node IS NOT NULL").select("node", F.col("parent").alias("exit"), F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("seg"), F.lit(False).alias("cyclic"))
    level, quotient, levels = 0, stage(nodes, "nodes"), []
    while True:
        n = quotient.count()
        last = n <= base_rows
        heavy = [] if last else heavy_keys(quotient.groupBy("exit").agg(F.count(F.lit(1)).alias("n")), "exit", "n", min_rows=min_heavy)
        buckets = 1 if last else max(shuffle_partitions(spark), n // BUCKET_ROWS + 1)
        done = quotient.withColumn("_place", _placed(level, buckets, heavy)).groupBy("_place").applyInArrow(_each_bucket, _SCHEMA)
        levels.append(done if last else stage(done, f"level{level}"))
        if last:
            break
        exits = levels[-1].where("exit IS NOT NULL").select(F.col("exit").alias("node")).distinct()
        quotient = stage(levels[-1].join(exits, "node", "left_semi"), f"quotient{level}")
        level += 1
    # A chain into a cycle of its bucket lists the entry twice; an exit that has no row is not listed.
    ended = F.when(F.col("exit").isNull(), F.array_distinct("seg")).otherwise(F.slice("seg", 1, F.size("seg") - 1))
    solved = levels.pop().select("node", ended.alias("path"), "cyclic")
    while levels:
        done = levels.pop()
        heavy = heavy_keys(done.groupBy("exit").agg(F.count(F.lit(1)).alias("n")), "exit", "n", min_rows=min_heavy)
        if heavy:
            solved = stage(solved, "solved")
        rest = solved.select(F.col("node").alias("exit"), F.col("path").alias("rest"), F.col("cyclic").alias("closed"))
        full = F.when(F.col("rest").isNull(), ended).otherwise(F.array_distinct(F.concat("seg", "rest")))
        solved = join_unique(done, rest, "exit", heavy).select("node", full.alias("path"), (F.col("cyclic") | F.coalesce("closed", F.lit(False))).alias("cyclic"))
    return solved




def ancestors(paths: DataFrame) -> DataFrame:
    """(node, ancestor, steps): one row for each node and each of its ancestors."""
    return paths.select("node", F.posexplode("path").alias("pos", "ancestor")).select("node", "ancestor", (F.col("pos") + 1).alias("steps"))


def descendants(paths: DataFrame) -> DataFrame:
    """(node, n_descendants, max_steps): over all nodes below each node, the members of its cycle included."""
    return ancestors(paths).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("steps").alias("max_steps"))
