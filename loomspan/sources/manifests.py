"""Listings of files: directory manifests, output sets with values captured from names, and mounts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, rel, size, modified[, sha256]) of the files under ``root``; contents are only read for the hash."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.escape(root.rstrip("/").replace("file://", "").removeprefix("file:"))
    out = df.select("path", F.regexp_replace("path", f"^(?:file:(?://)?)?{base}/", "").alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if content else []))
    return out


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size, sha256) of a folder in the order of names."""
    return list_files(spark, root, content=True).select("rel", "size", "sha256").orderBy("rel")


def manifest_hash(files: DataFrame) -> DataFrame:
    """One hash of a manifest, whatever the order of its rows."""
    row = F.concat_ws(":", "rel", F.col("size").cast("string"), "sha256")
    return files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(row))), 256).alias("hash"))


def bundle(files: DataFrame, main: str) -> DataFrame:
    """The files that share folder and stem with ``main``: the parts of a shapefile."""
    stem = re.escape(re.sub(r"\.[^./]*$", "", main))
    return files.where(F.col("rel").rlike(rf"^{stem}\.[^/]*$"))


def changed_since(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new, or newer than in an earlier listing."""
    old = before.select("rel", F.col("modified").alias("_was"))
    return files.join(old, "rel", "left").where(F.col("_was").isNull() | (F.col("modified") > F.col("_was"))).drop("_was")


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return f"^{out}$"


def captures(pattern: str) -> tuple[str, dict[str, str]]:
    """A regular expression and the types of a file pattern such as ``skims_{year:int}_{period}.parquet``."""
    kinds: dict[str, str] = {}
    parts = re.split(r"(\{\w+(?::\w+)?\})", pattern)
    out = ""
    for p in parts:
        m = re.fullmatch(r"\{(\w+)(?::(\w+))?\}", p)
        if m:
            if m[1] in kinds:
                raise ValueError(f"{m[1]} is captured twice")
            kinds[m[1]] = {"int": "bigint", "float": "double", "str": "string", None: "string"}[m[2]]
            out += "(-?\\d+)" if m[2] == "int" else "([^/]+?)"
        else:
            out += _glob(p)[1:-1]
    return f"^{out}$", kinds


def output_set(files: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """The members of an output set: included, not excluded, with the values captured from their names as typed columns."""
    hit = lambda globs: F.lit(False) if not globs else F.col("rel").rlike("|".join(_glob(g) for g in globs))
    out = files.where(hit(include) & ~hit(exclude))
    if pattern:
        expression, kinds = captures(pattern)
        out = out.where(F.col("rel").rlike(expression))
        out = out.select("*", *(F.regexp_extract("rel", expression, i).try_cast(t).alias(n) for i, (n, t) in enumerate(kinds.items(), 1)))
    return out.orderBy("rel")


def resolve(uri: Column, mounts: Mapping[str, str]) -> Column:
    """The path of ``mount://rest``; other texts stay."""
    out = uri
    for name, root in mounts.items():
        out = F.when(uri.startswith(f"{name}://"), F.concat(F.lit(root.rstrip("/") + "/"), F.substring(uri, F.lit(len(name) + 4), F.length(uri)))).otherwise(out)
    return out


def virtualize(path: Column, mounts: Mapping[str, str]) -> Column:
    """``mount://rest`` of a path; of several mounts the longest root wins."""
    out = path
    for name, root in sorted(mounts.items(), key=lambda m: len(m[1])):
        prefix = root.rstrip("/") + "/"
        out = F.when(path.startswith(prefix), F.concat(F.lit(f"{name}://"), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))).otherwise(out)
    return out
