"""Files and folders through the file system that Spark uses for their path: local, HDFS or an object store."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Local paths come with one slash or three.
FILE_SCHEME = "^file:/+"


def plain_path(path: str) -> str:
    return re.sub(FILE_SCHEME, "/", path)


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of the last change."""
    fs, at = _at(spark, path)
    return fs.getFileStatus(at).getModificationTime()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small file; False if it is there, or someone else makes it first, and may not be overwritten."""
    fs, at = _at(spark, path)
    if not overwrite and fs.exists(at):
        return False
    try:
        out = fs.create(at, overwrite)
    except Py4JJavaError:
        if not overwrite and fs.exists(at):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def move(spark: SparkSession, source: str, target: str) -> bool:
    fs, at = _at(spark, source)
    return fs.rename(at, _at(spark, target)[1])


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all below it."""
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder, also between file systems."""
    (a, x), (b, y) = _at(spark, source), _at(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark._jsc.hadoopConfiguration())
