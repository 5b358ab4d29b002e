"""Mixing sources to target weights by Pareto order sampling.

The total size is that of all documents whose source has a target (or one that is given). It is shared out by weight; a
source whose share is beyond all its permitted repeats is used up to them, and what it can't give goes to the others by
weight. A source's budget over its size gives the copies of each of its documents: the whole part is certain for all of
them, the rest of the budget goes to one more copy of some. For it each document has an inclusion probability of its
own, in proportion to its size (1 at most). A document's rank is the ratio of its random odds u/(1-u) to its inclusion
odds p/(1-p), and the documents of least rank fill the rest of the budget. The cut is found from a histogram of the
ranks per source, so no source is sorted in one task: only the documents of the one bin that holds the cut are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.ids import strip
from loomspan.session import stage

BINS = 1 << 16


def source_name(col: Column | str) -> Column:
    """Source names compare stripped and in lower case."""
    return F.lower(strip(col))


def _random(key: str, seed: int) -> Column:
    """A number in (0, 1) that only depends on key and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 53))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, weight, max_repeats, tokens, budget, whole, left): one row per source of ``targets``.

    ``targets`` (source, weight, max_repeats) is a fixed small table; weights are scaled to sum 1, rows of one source
    are merged. ``budget`` is what the source gives to ``total`` (default: the tokens of all these sources), ``whole``
    the copies that all its documents have, ``left`` the tokens of the budget beyond them. A source at the limit of its
    repeats is cut to it; what is missing goes to the others in proportion to their weights, so that only a total
    beyond all limits isn't reached. A source without tokens gets nothing.
    """
    named = targets.select(source_name("source").alias("source"), "weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source IS NOT NULL AND weight > 0 AND max_repeats > 0")
    merged = named.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    joined = merged.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    every = Window.partitionBy(F.lit(1))
    most = (F.col("tokens") * F.col("max_repeats")).cast("double")
    known = joined.select("source", F.sum("weight").over(every).alias("_all"), "weight", "max_repeats", "tokens", most.alias("_most"), (F.lit(float(total)) if total is not None else F.sum("tokens").over(every).cast("double")).alias("_total"))
    # In the order of limit to weight, the level of what the sources before leave rises while those before are at their limits, then falls.
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("_most") / F.col("weight"), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = known.withColumn("_level", level)
    budget = F.least(F.max("_level").over(every) * F.col("weight"), F.col("_most"))
    planned = leveled.withColumn("budget", budget).withColumn("whole", F.floor(F.coalesce(F.try_divide("budget", "tokens"), F.lit(0.0)) + 1e-12))
    left = F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0))
    return planned.select("source", (F.col("weight") / F.col("_all")).alias("weight"), "max_repeats", "tokens", "budget", "whole", left.alias("left"))


def _size_bin(tokens: Column) -> Column:
    """Sizes that differ by less than a hundredth share a bin: some thousands of bins for any sizes."""
    return F.floor(F.log2(tokens.cast("double")) * 64)


def inclusion(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, whole, left, rate): ``plans`` with the rate per token at which min(1, rate * tokens) of every document sums to ``left``.

    The rate comes from sums per size bin, taken from the largest size down: those that the rate lifts to 1 are certain.
    """
    bins = sized.groupBy("source", _size_bin(F.col("tokens")).alias("bin")).agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("tt"), F.max("tokens").alias("most"))
    down = Window.partitionBy("source").orderBy(F.desc("bin"))
    larger = F.coalesce(F.sum("t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("tt").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = bins.join(F.broadcast(plans), "source").select("source", "bin", "most", ((F.col("left") - larger) / rest).alias("rate"))
    first = rates.where(F.col("rate") * F.col("most") <= 1).groupBy("source").agg(F.max_by("rate", "bin").alias("rate"))
    return plans.join(first, "source", "left").select("source", "whole", "left", F.coalesce("rate", F.lit(1.0)).alias("rate"))


def mix(documents: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, total: int | None = None, seed: int = 42) -> DataFrame:
    """(key, source, tokens, repeats): the chosen documents and how often each is used.

    Documents without tokens or whose source has no target are not chosen. Repeats of one source's documents differ by
    one at most. The sample is the same for the same seed, in whatever order or partitions the rows come; ties of ranks
    are broken by key. A source's tokens miss its budget by at most half a document.
    """
    sized = stage(documents.select(key, source_name(source).alias("source"), F.col(tokens).alias("tokens")).where("tokens > 0"), "sized")
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plans = stage(plan(sizes, targets, total).select("source", "whole", "left"), "plan")
    rates = stage(inclusion(sized, plans), "rates")
    u = _random(key, seed)
    p = F.least(F.col("rate") * F.col("tokens"), F.lit(1.0))
    odds = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    # The bins divide r/(1+r) evenly: most ranks that are chosen lie below 1/2.
    ranked = sized.join(F.broadcast(rates), "source").withColumn("rank", F.when(p > 0, odds)).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))
    by_bin = ranked.where("rank IS NOT NULL").groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.first("left").alias("left"))
    filled = by_bin.withColumn("through", F.sum("t").over(Window.partitionBy("source").orderBy("bin")))
    cut = stage(filled.where(F.col("through") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("through") - F.col("t")).alias("filled")), "bin").alias("c")).select("source", "c.*").withColumnRenamed("bin", "cut"), "cut")
    placed = ranked.join(F.broadcast(cut), "source", "left")
    below = F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    sure = placed.where(~F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))).withColumn("repeats", F.col("whole") + below.cast("long"))
    order = Window.partitionBy("source").orderBy("rank", key)
    edge = placed.where(F.col("bin") == F.col("cut")).withColumn("sum", F.sum("tokens").over(order))
    edge = edge.withColumn("repeats", F.col("whole") + (F.col("filled") + F.col("sum") - F.col("tokens") / 2 <= F.col("left")).cast("long"))
    columns = [key, "source", "tokens", "repeats"]
    return sure.select(*columns).unionByName(edge.select(*columns)).where("repeats > 0")


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source, target_share, actual_share, size, used_tokens, n_documents, max_used, max_repeats) of each source of ``targets``.

    ``size`` is the tokens of all documents of the source; ``documents`` is read once, and should be a written table.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("max_used"))
    sizes = documents.select(source_name(source).alias("source"), F.col(tokens).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    planned = plan(sizes, targets).select("source", F.col("weight").alias("target_share"), F.col("tokens").alias("size"), "max_repeats")
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    joined = planned.join(used, "source", "left").na.fill(0, ["used_tokens", "n_documents", "max_used"])
    return joined.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", whole), F.lit(0.0))).select("source", "target_share", "actual_share", "size", "used_tokens", "n_documents", "max_used", "max_repeats")
