"""Template residue and error-page texts: trusted labels, spread to near-duplicates through SimHash tables.

Every document is read once: its rule label, the exact class of its plain text (digits alike), and the 128-bit SimHash
of its five-word shingles. Classes labelled wholly residue are trusted. Their near-duplicates are sought in SimHash
tables, each keyed by some bits of the hash: the bits grow with the number of trusted classes, so that a class meets
about as many others by chance at any size, and the number of tables follows from the bits and RECALL. Short texts have
too few shingles for a SimHash to be sure, so shared shingles of the texts' prefixes are sought besides; they lose
nothing: in one order of all shingles, two texts of similarity 0.8 share one of the first n - ceil(0.8 n) + 1 of each.
Pairs are verified by the Jaccard similarity of their shingles. What is found takes the label and joins the frontier,
until the connected components of the trusted classes are complete; a document is residue if its class is in one.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import residue_rules as rules
from loomspan.session import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Share of the pairs of similarity 0.8 that meet in a table, if each bit agrees with AGREE: 0.85 for long texts, 0.81 for eight words.
RECALL, AGREE = 0.95, 0.81
#: Bits of a table beyond the logarithm of the frontier, and their bounds.
SPARE_BITS, LEAST_BITS, MOST_BITS = 2, 8, 40
#: Pairs further apart in the 128 bits are no candidates: 24 is the mean distance at AGREE.
MAX_HAMMING = 44
#: The frontier's table rows are broadcast up to so many (about 16 MB), beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000

_NUMBER = re.compile(r"(?:(?<=\W)|^)(?=[a-f]*\d)[0-9a-f]{5,}(?=\W|$)|\d+")
_DIGIT = re.compile(r"\d")
_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("class", pa.binary()), ("n", pa.int32()), ("simhash", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])


def template(words: str) -> str:
    """Plain words with all numbers and hexadecimal ids alike; a text that is the same text over and over, once."""
    found = _DIGIT.search
    return rules.once(" ".join([_NUMBER.sub("0", t) if found(t) else t for t in words.split(" ")]) if found(words) else words)


def _shingles(text: str) -> set[str]:
    tokens = text.split(" ")
    return {" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y)


class _Words(dict):
    """The hash of each word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """How many of the first of n shingles two texts must look at, so that those of similarity SIMILARITY share one."""
    return n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of all texts, in ascending order within each text, and how many each text has.

    A text of fewer than SHINGLE words counts as if filled up with blanks: it has one shingle.
    """
    get, parts, counts = _WORDS.__getitem__, [], []
    for a in range(0, len(texts), 500):
        lists = [t.split(" ") for t in texts[a : a + 500]]
        lists = [w if len(w) >= SHINGLE else w + [""] * (SHINGLE - len(w)) for w in lists]
        sizes = np.array([len(w) for w in lists])
        words = np.fromiter((get(x) for w in lists for x in w), np.uint64, int(sizes.sum()))
        rolled = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - SHINGLE + 1 + j]
        owner = np.repeat(np.arange(len(lists)), sizes)[: len(rolled)]
        whole = np.repeat(np.cumsum(sizes), sizes)[: len(rolled)] - np.arange(len(rolled)) >= SHINGLE
        hashed, owner = _mixed(rolled[whole]), owner[whole]
        order = np.lexsort((hashed, owner))
        hashed, owner = hashed[order], owner[order]
        first = np.ones(len(hashed), bool)
        first[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
        parts.append(hashed[first])
        counts.append(np.bincount(owner[first], minlength=len(lists)))
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _majority(hashed: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text the 64 bits that more than half of its hashes have."""
    out, weights = np.zeros(len(n), np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a in range(0, len(n), 500):
        part = hashed[at[a] : at[a] + int(n[a : a + 500].sum())]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[a : a + 500] - at[a], axis=0, dtype=np.int32)
        out[a : a + 500] = ((2 * ones > n[a : a + 500, None]).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The SimHash (two numbers of 64 bits) of the distinct shingles of each text, their number, and the hashes of the prefix of the shingles."""
    hashed, n = shingle_hashes(texts)
    at = np.concatenate(([0], np.cumsum(n)))[: len(n)].astype(np.int64)
    both = np.stack([_majority(h, at, n) for h in (hashed, _mixed(hashed ^ np.uint64(0xD6E8FEB86659FD93)))], axis=1) if len(n) else np.zeros((0, 2), np.int64)
    return both, n, [hashed[i : i + k].view(np.int64) for i, k in zip(at, prefix_sizes(n))]


def plain_words(text: str | None) -> str:
    return rules.plain(rules.without_code(rules.visible(text))) if text else ""


def read_rules(text: str | None) -> tuple[str | None, str]:
    """The rule label of a text (placeholder, error, notice, filler or None) and its plain words."""
    if not text:
        return None, ""
    prose = rules.without_code(rules.visible(text))
    words = rules.plain(prose)
    return ("placeholder" if rules.has_placeholder(prose) else rules.whole_residue(words)), words


def features(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, label, class, n, simhash, prefix) of every document; without words all but doc_id are null and n is 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_rules(t) for t in batch.column(1).to_pylist()]
            texts = [template(w) for _, w in read]
            hashed, n, prefixes = signatures([t for t in texts if t])
            at = np.cumsum([bool(t) for t in texts]) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([label for label, _ in read], pa.string()),
                    pa.array([xxhash.xxh3_128_digest(t) if t else None for t in texts], pa.binary()),
                    pa.array([int(n[i]) if t else 0 for t, i in zip(texts, at)], pa.int32()),
                    pa.array([hashed[i] if t else None for t, i in zip(texts, at)], pa.list_(pa.int64())),
                    pa.array([prefixes[i] if t else None for t, i in zip(texts, at)], pa.list_(pa.int64())),
                ],
                schema=_FEATURES,
            )

    return documents.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(rows, "doc_id long, label string, class binary, n int, simhash array<long>, prefix array<long>")


def hashes_of(texts: DataFrame) -> DataFrame:
    """(rep, shingles): the hashes of the shingles of ``texts`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, n = shingle_hashes([template(plain_words(t)) for t in batch.column(1).to_pylist()])
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.view(np.int64)))], names=["rep", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(rows, "rep long, shingles array<long>")


def table_sizes(frontier: int) -> tuple[int, int]:
    """(bits, tables) for so many trusted classes: a pair of similarity SIMILARITY meets in one of the tables with RECALL."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, frontier))) + SPARE_BITS))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**bits))


def _masks(tables: int, bits: int) -> list[list[int]]:
    """The bits of the 128 each table looks at, drawn with a fixed seed, as two signed 64-bit masks."""
    rng = random.Random(64)
    masks = [reduce(lambda m, b: m | 1 << b, rng.sample(range(128), bits), 0) for _ in range(tables)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [[signed(m & (1 << 64) - 1), signed(m >> 64)] for m in masks]


def _in_tables(classes: DataFrame, prefix: str, masks: list[list[int]]) -> DataFrame:
    """One row per class and table. The bucket is a hash of the table and its bits; what it confuses the distance tells apart."""
    flat = classes.select(F.col("rep").alias(f"{prefix}_rep"), F.col("n").alias(f"{prefix}_n"), F.col("simhash")[0].alias(f"{prefix}_h0"), F.col("simhash")[1].alias(f"{prefix}_h1"))
    keys = F.array(*(F.xxhash64(F.lit(t), F.col(f"{prefix}_h0").bitwiseAND(F.lit(x)), F.col(f"{prefix}_h1").bitwiseAND(F.lit(y))) for t, (x, y) in enumerate(masks)))
    return flat.select(F.explode(keys).alias("bucket"), "*")


def _in_prefixes(classes: DataFrame, prefix: str) -> DataFrame:
    return classes.select(F.posexplode("prefix").alias(f"{prefix}_at", "bucket"), F.col("rep").alias(f"{prefix}_rep"), F.col("n").alias(f"{prefix}_n"))


def _met(a: DataFrame, b: DataFrame, close: Column) -> DataFrame:
    """(a_rep, b_rep): the pairs of like length that meet and are close. Few rows of ``a`` are broadcast, else both sides are shuffled by bucket."""
    if a.count() <= BROADCAST_ROWS:
        a = F.broadcast(a)
    like = (F.col("b_n") >= F.col("a_n") * SIMILARITY) & (F.col("a_n") >= F.col("b_n") * SIMILARITY)
    return b.join(a, "bucket").where(like & close).select("a_rep", "b_rep")


def by_tables(frontier: DataFrame, others: DataFrame) -> DataFrame:
    """The pairs that meet in a table and are near in all bits, once for each table they meet in."""
    masks = _masks(*table_sizes(frontier.count())[::-1])
    close = F.bit_count(F.col("a_h0").bitwiseXOR(F.col("b_h0"))) + F.bit_count(F.col("a_h1").bitwiseXOR(F.col("b_h1"))) <= MAX_HAMMING
    return _met(_in_tables(frontier, "a", masks), _in_tables(others, "b", masks), close)


def by_prefixes(frontier: DataFrame, others: DataFrame) -> DataFrame:
    """All pairs of at least SIMILARITY, and some others: after the first shingle that both share, enough must be left of either."""
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    close = left + 1e-6 >= (F.col("a_n") + F.col("b_n")) * (SIMILARITY / (1 + SIMILARITY))
    return _met(_in_prefixes(frontier, "a"), _in_prefixes(others, "b"), close)


def near(frontier: DataFrame, others: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, kind): the classes of ``others`` that are near-duplicates of one of ``frontier``, with its label (the least of several)."""
    pairs = stage(by_tables(frontier, others).unionByName(by_prefixes(frontier, others)).distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("a_rep", "b_rep")).alias("doc_id")).distinct()
    hashed = stage(hashes_of(texts.join(wanted, "doc_id", "left_semi")), "shingles")
    both = pairs.join(hashed.select(F.col("rep").alias("a_rep"), F.col("shingles").alias("x")), "a_rep").join(hashed.select(F.col("rep").alias("b_rep"), F.col("shingles").alias("y")), "b_rep")
    shared = F.size(F.array_intersect("x", "y"))
    verified = both.where(shared >= SIMILARITY * (F.size("x") + F.size("y") - shared) - 1e-9).select("a_rep", "b_rep")
    return verified.join(frontier.select(F.col("rep").alias("a_rep"), "kind"), "a_rep").groupBy(F.col("b_rep").alias("rep")).agg(F.min("kind").alias("kind"))


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, via): the documents that are residue; kind is placeholder, error, notice or filler, via is rule or near_duplicate.

    A document with an unfilled placeholder outside code is a case by itself and not spread: filled copies of it are
    real. Null, empty and blank texts, and texts that are only code, are no cases. Texts of fewer than five words have
    one shingle, the whole text, so their near-duplicates are the texts that only differ in numbers, case or blanks.
    """
    read = stage(features(documents, key, text), "features")
    whole = F.when(F.col("label") != "placeholder", F.col("label"))
    classes = read.where("class IS NOT NULL").groupBy("class").agg(
        F.min(whole).alias("kind"), F.max(F.when(F.col("label") == "placeholder", 1).otherwise(0)).alias("filled_in"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("prefix").alias("prefix")
    )
    known = stage(classes, "classes")
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frontier, rest = known.where("kind IS NOT NULL"), known.where("kind IS NULL AND filled_in = 0").drop("kind")
    found = [frontier.select("class", "kind", F.lit("rule").alias("via"))]
    while True:
        new = stage(rest.join(near(frontier, rest, texts), "rep"), "near")
        if new.isEmpty():
            break
        found.append(new.select("class", "kind", F.lit("near_duplicate").alias("via")))
        frontier, rest = new, rest.join(new, "rep", "left_anti")
    components = reduce(DataFrame.unionByName, found)
    alone = read.where("label = 'placeholder'").select("doc_id", F.col("label").alias("kind"), F.lit("rule").alias("via"))
    return read.where("label IS NULL OR label <> 'placeholder'").select("doc_id", "class").join(components, "class").select("doc_id", "kind", "via").unionByName(alone)


def without_residue(documents: DataFrame, residue: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that are left when residue is excluded, with all their columns."""
    return documents.join(residue.select(F.col("doc_id").alias(key)), key, "left_anti")
