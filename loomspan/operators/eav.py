"""Attribute-value rows to wide tables by positional stitching.

The latest row of each (entity, namespace, attribute) gives the value. Entities get dense global ordinals: a local rank
inside hash buckets plus the bucket's offset. A block is a range of ordinals; each block builds every attribute as one
typed column aligned to its ordinals and puts the columns side by side by position, without a join by key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspan.functions.ids import strip
from loomspan.functions.types import NUMERAL, SPARK_TYPES, named_type, plain_double, promote, whole_number
from loomspan.session import shuffle_partitions, stage

MAX_COLUMNS = 20_000
#: Rows of a block, and cells: a block of a table with more columns has fewer rows.
BLOCK, CELLS = 4096, 4_000_000

# The texts of a boolean, in lower case.
TRUE, FALSE = ["true", "yes", "1"], ["false", "no", "0"]


def with_typed_value(rows: DataFrame, decimals: int | None = None) -> DataFrame:
    """``rows`` (kind and the value columns) with ``value``: the value as text, read as ``kind`` says from whichever of the
    value columns is filled; null if it can't be read.

    An integer must be whole and has any number of digits (from a double, 38), a float is the text of its double, or with
    ``decimals`` plain and rounded to them; NaN and infinities are null, a boolean is true/false, yes/no or 1/0; JSON
    texts are unquoted, JSON lists and objects are null. Values of kind json or null, or of unknown kinds, are null.
    Each step is a projection of its own, so that nothing is parsed twice.
    """
    doc = rows.withColumn("_doc", F.try_parse_json("value_json"))
    scalar = F.when(~F.schema_of_variant("_doc").rlike("^(ARRAY|OBJECT)"), F.try_variant_get("_doc", "$", "string"))
    json_text = F.when(F.col("value_json").isNotNull(), scalar)
    raw = doc.withColumn("_raw", strip(F.coalesce(F.col("value_str"), F.col("value_num").cast("string"), F.col("value_bool").cast("string"), json_text)))
    numeral = (F.col("kind").isin("integer", "float") | F.col("value_num").isNotNull()) & F.col("_raw").rlike(NUMERAL)
    read = raw.withColumn("_number", F.when(numeral, F.col("_raw").try_cast("double"))).withColumn("_number", F.when(F.abs("_number") < float("inf"), F.col("_number")))
    kind, number, text = F.col("kind"), F.col("_number"), F.col("_raw")
    was_number = F.col("value_str").isNull() & F.col("value_num").isNotNull()
    low = F.lower(F.when(was_number, plain_double(number)).otherwise(text))
    value = (
        F.when(kind == "integer", whole_number(text, number))
        .when(kind == "float", number.cast("string") if decimals is None else plain_double(number, decimals))
        .when(kind == "string", F.when(was_number, F.coalesce(plain_double(number, decimals), text)).otherwise(text))
        .when(kind == "boolean", F.element_at(F.create_map(*(F.lit(x) for t in TRUE for x in (t, "true")), *(F.lit(x) for t in FALSE for x in (t, "false"))), low))
    )
    return read.withColumn("value", value).drop("_doc", "_raw", "_number")


def current_values(rows: DataFrame, entity: Column, attr: Column, created_at: str = "created_at", decimals: int | None = None) -> DataFrame:
    """(entity_id, namespace, attr, kind, value): the latest row of each; a null or unreadable latest value is null.

    A null namespace is ''. Rows without entity or attribute are left out; rows that tie are copies, or else the
    greatest value is taken. Attributes are trimmed and in lower case. ``decimals`` as in :func:`with_typed_value`.
    """
    named = rows.select(
        entity.alias("entity_id"),
        F.coalesce("namespace", F.lit("")).alias("namespace"),
        F.lower(strip(attr)).alias("attr"),
        named_type("value_type").alias("kind"),
        *(c for c in ("value_str", "value_num", "value_bool", "value_json")),
        F.col(created_at).alias("created_at"),
    ).where("entity_id IS NOT NULL AND attr <> ''")
    read = with_typed_value(named, decimals).select("entity_id", "namespace", "attr", "kind", "value", "created_at")
    latest = F.max_by(F.struct("kind", "value"), F.struct("created_at", "kind", "value"))
    return read.groupBy("entity_id", "namespace", "attr").agg(latest.alias("v")).select("entity_id", "namespace", "attr", "v.*")


def _column_type(longest: dict[str, int]) -> str:
    """The type of a column from its kinds and the length of each kind's longest value."""
    kind, digits = promote(set(longest)), longest.get("integer", 0)
    if kind == "integer":
        return "bigint" if digits <= 18 else "decimal(38,0)" if digits <= 38 else "string"
    return "string" if kind == "float" and digits > 15 else SPARK_TYPES.get(kind, "string")


ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0), "string": pa.string()}


def _typed(texts: pa.Array, ddl: str) -> pa.Array:
    return pc.equal(texts, "true") if ddl == "boolean" else texts.cast(ARROW[ddl])


def stitch(values: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The wide table of :func:`current_values`: entity_id, namespace and a column ``v_<attr>`` per attribute.

    A column's type is the least one that holds all its values: boolean, bigint (decimal beyond 18 digits, string beyond
    38), double or string; numbers in a string column are plain where they can be. An entity whose values are all null
    has a row of nulls. Returns the table and the pairs (attribute, type). More than MAX_COLUMNS attributes raise an error.
    """
    buckets = 4 * shuffle_partitions(values.sparkSession)
    bucketed = values.withColumn("bucket", F.pmod(F.xxhash64("entity_id", "namespace"), F.lit(buckets)).cast("int"))
    local = F.dense_rank().over(Window.partitionBy("bucket").orderBy("entity_id", "namespace"))
    ranked = stage(bucketed.withColumn("rank", local), "eav")
    sizes = {r.bucket: r.n for r in ranked.groupBy("bucket").agg(F.max("rank").alias("n")).collect()}
    offsets = dict(zip(range(buckets), itertools.accumulate([0, *(sizes.get(b, 0) for b in range(buckets - 1))])))
    found = ranked.where("value IS NOT NULL").groupBy("attr", "kind").agg(F.max(F.length("value")).alias("longest")).limit(8 * MAX_COLUMNS).collect()
    by_attr: dict[str, dict[str, int]] = {}
    for r in found:
        by_attr.setdefault(r.attr, {})[r.kind] = r.longest
    if len(by_attr) > MAX_COLUMNS:
        raise ValueError(f"{len(by_attr)} attributes; a wide table has at most {MAX_COLUMNS}")
    columns = [(a, _column_type(by_attr[a])) for a in sorted(by_attr)]
    ordinal = F.element_at(F.array(*(F.lit(offsets[b]).cast("long") for b in range(buckets))), F.col("bucket") + 1) + F.col("rank") - 1
    in_text = (F.col("kind") == "float") & ~F.col("attr").isin([a for a, t in columns if t == "double"])
    plain = F.when(in_text & ~F.col("value").contains("E"), F.regexp_replace("value", r"\.0$", "")).otherwise(F.col("value"))
    placed = ranked.select("entity_id", "namespace", "attr", plain.alias("value"), ordinal.alias("ordinal"))
    placed = placed.withColumn("block", F.floor(F.col("ordinal") / max(1, min(BLOCK, CELLS // max(1, len(columns))))))
    schema = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("namespace", T.StringType()), *(T.StructField(f"v_{a}", T.StructType.fromDDL(f"c {t}")[0].dataType) for a, t in columns)])

    def assemble(table: pa.Table) -> pa.Table:
        ordinals = table["ordinal"].to_numpy()
        first = int(ordinals.min())
        at = ordinals - first
        n = int(at.max()) + 1
        entity, space = np.empty(n, object), np.empty(n, object)
        entity[at] = table["entity_id"].to_pylist()
        space[at] = table["namespace"].to_pylist()
        texts = table["value"].combine_chunks()
        names = table["attr"].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        slots = {a: order[cuts[i] : cuts[i + 1]] for i, a in enumerate(names.dictionary.to_pylist())}
        arrays = [pa.array(entity, pa.string()), pa.array(space, pa.string())]
        for attr, ddl in columns:
            if attr not in slots:
                arrays.append(pa.nulls(n, ARROW[ddl]))
                continue
            source = np.full(n, -1, np.int64)
            source[at[slots[attr]]] = slots[attr]
            arrays.append(_typed(texts.take(pa.array(source, mask=source < 0)), ddl))
        return pa.Table.from_arrays(arrays, names=["entity_id", "namespace", *(f"v_{a}" for a, _ in columns)])

    return placed.groupBy("block").applyInArrow(assemble, schema), columns


def _plain(value: float) -> str:
    """A double in plain notation with at most four decimals."""
    text = repr(value)
    if "e" in text or len(text) - text.find(".") > 5:
        text = format(Decimal(text).quantize(Decimal("0.0001"), ROUND_HALF_UP) if abs(value) < 1e15 else Decimal(text), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def melt(wide: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(entity_id, namespace, attr, value): the values of a wide table that aren't null, as text; numbers with at most four decimals."""
    schema = pa.schema([("entity_id", pa.string()), ("namespace", pa.string()), ("attr", pa.string()), ("value", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (attr, ddl) in enumerate(columns):
                column = batch.column(i + 2)
                if column.null_count == len(column):
                    continue
                part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["entity_id", "namespace", "v"]).filter(column.is_valid())
                text = pa.array([_plain(v) for v in part.column(2).to_pylist()], pa.string()) if ddl == "double" else part.column(2).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([attr] * len(part), pa.string()), text], schema=schema)

    by_position = wide.toDF("entity_id", "namespace", *(f"c{i}" for i in range(len(columns))))  # names with dots can't be passed
    return by_position.mapInArrow(rows, "entity_id string, namespace string, attr string, value string")
