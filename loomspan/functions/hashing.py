"""Identities: canonical JSON, config and run hashes on the driver; signatures and Merkle hashes as columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, is_dataclass
from datetime import date, datetime
from pathlib import PurePath
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the member that mixes run fields into a config before it is hashed.
RUN_FIELDS = "__run_fields__"


def clean(value: Any, exclude: frozenset[str] = frozenset()) -> Any:
    """A structure of plain JSON types: mappings with text keys and without ``exclude``, lists, and scalars.

    NumPy scalars and arrays become Python values, sets become sorted lists, dates ISO text, other objects their text.
    """
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if is_dataclass(value) and not isinstance(value, type):
        return clean(asdict(value), exclude)
    if hasattr(value, "model_dump"):
        return clean(value.model_dump(), exclude)
    if isinstance(value, Mapping):
        return {str(k): clean(v, exclude) for k, v in value.items() if str(k) not in exclude}
    if isinstance(value, (set, frozenset)):
        return sorted((clean(v, exclude) for v in value), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(value, (list, tuple)):
        return [clean(v, exclude) for v in value]
    if isinstance(value, np.ndarray):
        return clean(value.tolist(), exclude)
    if isinstance(value, np.generic):
        return clean(value.item(), exclude)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value.as_posix() if isinstance(value, PurePath) else str(value)


def canonical_json(value: Any) -> str:
    return json.dumps(clean(value), sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def facet_id(facet: Any) -> str:
    return sha256(canonical_json(facet))


def config_hash(config: Mapping, exclude: Iterable[str] = ()) -> str:
    """Hash of a configuration; unlike canonical JSON it keeps the default separators of the JSON writer."""
    return sha256(json.dumps(clean(config, frozenset(exclude)), sort_keys=True, ensure_ascii=True))


def run_config_hash(config: Mapping, model: str, year: Any = None, iteration: Any = None, cache_epoch: int | None = None, cache_version: int | None = None) -> str:
    fields = {"model": model, "year": year, "iteration": iteration}
    fields |= {k: v for k, v in (("cache_epoch", cache_epoch), ("cache_version", cache_version)) if v is not None}
    return config_hash({**config, RUN_FIELDS: fields})


def run_signature(code: Column | str, config: Column | str, inputs: Column | str) -> Column:
    """The cache key of a run from its three component hashes."""
    part = lambda c: F.col(c) if isinstance(c, str) else c
    return F.sha2(F.concat(F.lit("code:"), part(code), F.lit("|conf:"), part(config), F.lit("|in:"), part(inputs)), 256)


def input_signature(artifact: str = "", producer_signature: str = "producer_signature") -> Column:
    """The identity of one input: of its producing run if it has one, else of its file.

    Reads driver, key, container_uri, table_path, array_path, run_id and hash, with the prefix ``artifact``.
    """
    col = lambda c: F.col(f"{artifact}{c}")
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}:"), c))
    paths = [part("table_path", col("table_path")), part("array_path", col("array_path"))]
    producer = F.coalesce(part("sig", F.col(producer_signature)), part("run", col("run_id")))
    made = F.concat_ws("|", part("driver", col("driver")), part("key", col("key")), *paths, producer, part("hash", col("hash")))
    raw = F.concat_ws("|", part("driver", col("driver")), part("container_uri", col("container_uri")), *paths, part("file", col("hash")))
    return F.when(col("run_id").isNotNull(), made).otherwise(raw)


def merkle_hash(inputs: DataFrame, by: str, signature: str, out: str = "input_hash") -> DataFrame:
    """(by, out): one hash over the sorted signatures of each run's inputs; order plays no part."""
    joined = F.concat_ws("|", F.sort_array(F.collect_list(signature)))
    return inputs.groupBy(by).agg(F.when(F.count(signature) == 0, F.sha2(F.lit("empty_inputs"), 256)).otherwise(F.sha2(joined, 256)).alias(out))
