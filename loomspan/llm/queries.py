"""The queries of the text problems (p8 to p10) over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import mixing, residue, tokenizer
from loomspan.session import prepare, read_table, stage


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k, without special tokens."""
    prepare(spark)
    return tokenizer.encode(read_table(spark, folder, "documents"), "doc_id", "text")


def p8_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, characters and tokens of each language and source."""
    prepare(spark)
    documents = read_table(spark, folder, "documents").withColumn("source", mixing.source_name("source"))
    counted = tokenizer.count_tokens(documents, "doc_id", "text", ["lang", "source", "n_chars"])
    return counted.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.sum("tokens").alias("n_tokens"))


def _counted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    documents = read_table(spark, folder, "documents")
    return tokenizer.count_tokens(documents, "doc_id", "text", ["source"]), read_table(spark, folder, "mix_target")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents chosen for the mix and how often each is used."""
    counted, targets = _counted(spark, folder)
    return mixing.mix(counted, targets, "doc_id", "source", "tokens")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    counted, targets = _counted(spark, folder)
    counted = stage(counted, "counted")
    return mixing.shares(mixing.mix(counted, targets, "doc_id", "source", "tokens"), counted, targets, "source", "tokens")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold template residue, filler, an error message or a script notice."""
    prepare(spark)
    return residue.find_residue(read_table(spark, folder, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each kind of residue there are, by rule and as near-duplicates."""
    prepare(spark)
    return residue.find_residue(read_table(spark, folder, "documents")).groupBy("kind", "via").agg(F.count(F.lit(1)).alias("n_documents"))


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are no residue."""
    prepare(spark)
    documents = read_table(spark, folder, "documents")
    return residue.without_residue(documents, residue.find_residue(documents))


QUERIES = {f.__name__: f for f in (p8_ids, p8_sizes, p9_mix, p9_shares, p10_found, p10_kinds, p10_clean)}
SQL: dict[str, str] = {}
