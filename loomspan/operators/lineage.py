"""Lineage of artifacts and subtrees of runs, by joins of a frontier or, of any depth, by searches inside buckets of runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.skew import heavy_keys, join_unique, union_all
from loomspan.session import stage

#: Of more roots the lineage is sought level by level.
FEW_ROOTS = 20
#: Links in a bucket times roots: about what the task of a bucket holds.
BUCKET_ROWS = 2_000_000
_FOUND = "bucket int, root string, node string, depth int, settled boolean"
_ARROW = pa.schema([("bucket", pa.int32()), ("root", pa.string()), ("node", pa.string()), ("depth", pa.int32()), ("settled", pa.bool_())])


def lineage(artifacts: DataFrame, links: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, artifact_id, run_id, depth, path): the artifacts that went into ``start`` (artifact_id), level by level.

    An artifact leads to the run that made it and on to that run's inputs. A path never comes back to one of its own
    artifacts; an artifact reached on several paths is listed on each. Depth counts artifacts, the start is 0. Without
    ``max_depth`` the loop ends when no path goes on.
    """
    made = artifacts.select(F.col("id").alias("artifact_id"), "run_id")
    inputs = links.where("direction = 'input'").select("run_id", F.col("artifact_id").alias("next")).distinct()
    level = start.select("artifact_id").distinct().join(made, "artifact_id").select(F.col("artifact_id").alias("root"), "artifact_id", "run_id", F.lit(0).alias("depth"), F.array("artifact_id").alias("path"))
    levels = [stage(level, "lineage")]
    while max_depth is None or len(levels) <= max_depth:
        onward = levels[-1].join(inputs, "run_id").where(~F.array_contains("path", F.col("next")))
        step = onward.select("root", F.col("next").alias("artifact_id"), F.col("depth") + 1, F.concat("path", F.array("next"))).toDF("root", "artifact_id", "depth", "path")
        step = stage(step.join(made, "artifact_id", "left").select("root", "artifact_id", "run_id", "depth", "path"), "lineage")
        if step.isEmpty():
            break
        levels.append(step)
    return union_all(levels)


def _settle(edges: pa.Table, rows: pa.Table) -> pa.Table:
    """Search one bucket from the rows that came to it: what is newly reached or nearer than before, and rows for other buckets."""
    own = (edges if len(edges) else rows)["bucket"][0].as_py()
    names = pa.chunked_array([*edges["run_id"].chunks, *edges["producer"].chunks, *rows["node"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code, names = names.indices.to_numpy(), names.dictionary
    tails, heads, nodes = np.split(code, [len(edges), 2 * len(edges)])
    order = np.argsort(tails, kind="stable")
    first = np.searchsorted(tails[order], np.arange(len(names) + 1)).tolist()
    heads, places = heads[order].tolist(), edges["place"].to_numpy()[order].tolist()
    by_root: dict[str, list] = {}
    for root, *row in zip(rows["root"].to_pylist(), rows["depth"].to_pylist(), nodes.tolist(), rows["settled"].to_pylist()):
        by_root.setdefault(root, []).append(row)
    found = []
    for root, known in by_root.items():
        least: list = [float("inf")] * len(names)
        for depth, node, settled in known:
            if settled:
                least[node] = min(least[node], depth)
        came = sorted((depth, node) for depth, node, settled in known if not settled)
        at, depth, level, reached, sent = 0, 0, [], [], {}
        while level or at < len(came):
            depth = depth if level else came[at][0]
            while at < len(came) and came[at][0] <= depth:
                level.append(came[at][1])
                at += 1
            onward = []
            for node in level:
                if least[node] <= depth:
                    continue
                least[node] = depth
                reached.append(node)
                for i in range(first[node], first[node + 1]):
                    if places[i] == own:
                        onward.append(heads[i])
                    else:
                        sent.setdefault((places[i], heads[i]), depth + 1)
            level, depth = onward, depth + 1
        bucket = [own] * len(reached) + [place for place, _ in sent]
        node = names.take(pa.array(reached + [head for _, head in sent], pa.int32()))
        away = [least[n] for n in reached] + list(sent.values())
        settled = [True] * len(reached) + [False] * len(sent)
        found.append(pa.table([pa.array(bucket, pa.int32()), pa.array([root] * len(bucket), pa.string()), node, pa.array(away, pa.int32()), pa.array(settled, pa.bool_())], schema=_ARROW))
    return pa.concat_tables(found) if found else _ARROW.empty_table()


def _nodes_by_buckets(artifacts: DataFrame, links: DataFrame, start: DataFrame, bucket_links: int) -> DataFrame:
    """The rows of :func:`lineage_nodes` at any depth, from ``start`` (root, artifact_id, run_id, depth).

    The runs lie in buckets by the time of what they made, so most links stay inside a bucket. Each round searches all
    buckets that were reached anew, each to its end in one task, and hands on what leads to other buckets: the rounds
    follow the buckets, not the depth, and are never more than the levels. Links of one run may lie in several buckets.
    """
    inputs = stage(links.where("direction = 'input' AND run_id IS NOT NULL").select("run_id", "artifact_id").distinct(), "inputs")
    made = artifacts.select(F.col("id").alias("artifact_id"), F.col("run_id").alias("producer"))
    # A few shared inputs are used by many runs: they are joined apart.
    shared = heavy_keys(inputs.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")), "artifact_id", "n")
    uses = stage(join_unique(inputs, made, "artifact_id", shared), "uses")
    buckets = uses.count() // bucket_links + 1
    seeds = start.where("run_id IS NOT NULL").select("root", F.col("run_id").alias("node"), "depth")
    if buckets == 1:
        edges = uses.where("producer IS NOT NULL").select(F.lit(0).alias("bucket"), "run_id", "producer", F.lit(0).alias("place"))
        came = seeds.withColumn("bucket", F.lit(0))
    else:
        time = F.min("created_at") if "created_at" in artifacts.columns else F.lit(None).cast("timestamp")
        times = artifacts.where("run_id IS NOT NULL").groupBy("run_id").agg(time.alias("time"))
        # A run that made nothing is never reached. Links without a producer are kept until all runs with inputs have their place.
        placed = uses.join(times, "run_id").repartitionByRange(buckets, "time", "run_id", "artifact_id")
        placed = stage(placed.select(F.spark_partition_id().alias("bucket"), "run_id", "producer"), "placed")
        places = stage(placed.select(F.col("run_id").alias("node"), F.col("bucket").alias("place")).distinct(), "places")
        edges = placed.join(places.withColumnRenamed("node", "producer"), "producer").select("bucket", "run_id", "producer", "place")
        edges = stage(edges.repartitionByRange(buckets, "bucket"), "edges")
        came = seeds.join(places, "node").withColumnRenamed("place", "bucket")
    rounds, reached_in = [stage(came.select("bucket", "root", "node", "depth", F.lit(False).alias("settled")), "reached")], {}
    while pending := [r[0] for r in rounds[-1].where("NOT settled").select("bucket").distinct().collect()]:
        for bucket in pending:
            reached_in.setdefault(bucket, set()).add(len(rounds) - 1)
        known = union_all([rounds[i] for i in sorted(set().union(*(reached_in[b] for b in pending)))]).where(F.col("bucket").isin(pending))
        found = edges.where(F.col("bucket").isin(pending)).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_settle, _FOUND)
        for bucket in pending:
            reached_in[bucket].add(len(rounds))
        rounds.append(stage(found, "reached"))
    runs = union_all([seeds, *(r.where("settled").select("root", "node", "depth") for r in rounds[1:])]).groupBy("root", F.col("node").alias("run_id")).agg(F.min("depth").alias("depth"))
    used = runs.join(uses, "run_id").select("root", "artifact_id", F.col("producer").alias("run_id"), (F.col("depth") + 1).alias("depth"))
    return start.unionByName(used).groupBy("root", "artifact_id", "run_id").agg(F.min("depth").alias("depth"))


def lineage_nodes(artifacts: DataFrame, links: DataFrame, start: DataFrame, max_depth: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(root, artifact_id, run_id, depth): the artifacts that went into ``start`` (artifact_id), each once per root at its least depth.

    Unlike :func:`lineage` its size is bounded by roots times artifacts, however many paths join them; cycles end.
    Without ``max_depth`` and of at most FEW_ROOTS roots the number of jobs doesn't follow the depth.
    """
    made = artifacts.select(F.col("id").alias("artifact_id"), "run_id")
    level = start.select("artifact_id").distinct().join(made, "artifact_id").select(F.col("artifact_id").alias("root"), "artifact_id", "run_id", F.lit(0).alias("depth"))
    levels = [stage(level, "lineage")]
    if max_depth is None and (roots := levels[0].count()) <= FEW_ROOTS:
        return _nodes_by_buckets(artifacts, links, levels[0], max(1, bucket_rows // max(1, roots)))
    inputs = links.where("direction = 'input'").select("run_id", F.col("artifact_id").alias("next")).distinct()
    while max_depth is None or len(levels) <= max_depth:
        step = levels[-1].join(inputs, "run_id").select("root", F.col("next").alias("artifact_id"), (F.col("depth") + 1).alias("depth")).distinct()
        step = step.join(union_all(levels).select("root", "artifact_id"), ["root", "artifact_id"], "left_anti")
        step = stage(step.join(made, "artifact_id", "left").select("root", "artifact_id", "run_id", "depth"), "lineage")
        if step.isEmpty():
            break
        levels.append(step)
    return union_all(levels)


def descendant_runs(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, depth): the seeds (id) and all runs below them, each once at its least depth; cycles end."""
    edges = runs.where("parent_run_id IS NOT NULL").select("id", "parent_run_id")
    frontier = stage(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "descendants")
    seen = frontier
    while not frontier.isEmpty():
        below = edges.join(frontier.withColumnRenamed("id", "parent_run_id"), "parent_run_id").select("id", (F.col("depth") + 1).alias("depth")).distinct()
        frontier = stage(below.join(seen, "id", "left_anti"), "descendants")
        seen = seen.unionByName(frontier)
    return seen


def format_tree(paths: list, labels: dict | None = None, indent: int = 2) -> str:
    """Collected rows of :func:`lineage` as an indented tree, in the order of their paths."""
    label = (labels or {}).get
    rows = sorted(paths, key=lambda r: list(r["path"]))
    return "\n".join(f"{' ' * indent * r['depth']}{label(r['artifact_id'], r['artifact_id'])}" + (f" <- {r['run_id']}" if r["run_id"] else "") for r in rows)


def connected_runs(links: DataFrame, run_id: str) -> DataFrame:
    """The runs that read what this run wrote."""
    out = links.where((F.col("run_id") == run_id) & (F.col("direction") == "output")).select("artifact_id")
    return links.where("direction = 'input'").join(out, "artifact_id", "left_semi").select("run_id").distinct()


def print_tree(paths: list, labels: dict | None = None, show_run_ids: bool = True) -> str:
    """Write the tree of :func:`format_tree` to the standard output, with or without the runs; returns it."""
    text = format_tree(paths, labels)
    text = text if show_run_ids else "\n".join(line.partition(" <- ")[0] for line in text.split("\n"))
    print(text)
    return text
