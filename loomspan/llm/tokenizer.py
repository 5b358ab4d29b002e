"""Byte-level BPE over whole corpora by a pair occurrence index.

Texts are split into pieces by the tokenizer's pattern. The distinct new pieces of a batch are laid out in one array of
symbols; the index maps the rank of each adjacent pair to all its positions in that array. The active ranks are taken
in ascending order from a heap: all positions of the pair are merged from left to right and the lists of the two
neighbouring pairs are updated. A merged symbol only forms pairs of higher rank, so each rank is taken once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: The piece cache of a Python worker is emptied at so many pieces; only speed depends on it.
CACHE_PIECES = 500_000
#: Pieces longer than this are not kept in the cache.
CACHE_BYTES = 64


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in a byte-level vocabulary: visible Latin-1 characters stand
    for themselves, the other bytes in order for the letters from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBPE:
    """An encoder for the vocabulary file at ``path`` (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.base[byte] = vocab[letter]
        self.shift = max(vocab.values()).bit_length()
        self.rank = {vocab[a] << self.shift | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.find = regex.compile(pattern or _pattern()).findall
        self.cache: dict[str, list[int]] = {}

    def _encode_new(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(r) for r in raw])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        first = self.base[joined]
        keys = first[:-1] << self.shift | first[1:]
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        known = self._keys[at] == keys
        known[ends[:-1] - 1] = False  # no pair across pieces
        places = np.flatnonzero(known)
        ranks = self._order[at[places]]
        by_rank = np.argsort(ranks, kind="stable")
        index: dict[int, list[int]] = {}
        if len(places):
            values, starts = np.unique(ranks[by_rank], return_index=True)
            index = {int(r): part.tolist() for r, part in zip(values, np.split(places[by_rank], starts[1:]))}
        symbols, n = first.tolist(), len(first)
        after = list(range(1, n + 1))
        for e in ends.tolist():
            after[e - 1] = -1
        before = [-1] * n
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
        heap, get, shift = list(index), self.rank.get, self.shift
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = self.left[rank], self.right[rank], self.merged[rank]
            for i in sorted(index.pop(rank)):
                j = after[i]
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue
                symbols[i], symbols[j] = new, -1
                k, h = after[j], before[i]
                after[i], after[j] = k, -1
                if k >= 0:
                    before[k] = i
                    r = get(new << shift | symbols[k])
                    if r is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(i)
                if h >= 0:
                    r = get(symbols[h] << shift | new)
                    if r is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(h)
        out, start = [], 0
        for e in ends.tolist():
            out.append([s for s in symbols[start:e] if s >= 0])
            start = e
        return out

    def pieces(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, list[int]]]:
        """The pieces of each text, and the ids of every piece that occurs."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        table = self.cache
        new = list({p for pieces in split for p in pieces if p not in table})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            table.update(zip(part, self._encode_new(part)))
        long = [p for p in new if len(p) > CACHE_BYTES]
        if long:
            self.cache = {k: v for k, v in table.items() if len(k) <= CACHE_BYTES}
        return split, table

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, without special tokens; null and empty texts give empty lists."""
        split, table = self.pieces(texts)
        return [[i for p in pieces for i in table[p]] for pieces in split]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split, table = self.pieces(texts)
        return [sum(len(table[p]) for p in pieces) for pieces in split]


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str | None) -> PairIndexBPE:
    return PairIndexBPE(path, pattern)


def _slices(texts: list[str | None], characters: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text without special tokens, nothing trimmed or normalised.

    Null and empty texts give an empty list. Strings of special tokens in a text are ordinary text. Repeated keys and
    texts give one row each; texts of any length are encoded whole. Runs within the partitions, without a shuffle.
    """
    path = path or default_path()
    schema = pa.schema([pa.field("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = encoder.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return df.select(F.col(key).cast("long").alias("key"), text).mapInArrow(rows, "key long, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, carried: list[str], path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, carried..., tokens): the number of tokens of each text; 0 for null and empty texts."""
    path = path or default_path()
    names = [key, *carried]
    kept = df.select(*names, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            counts = [c for a, b in _slices(texts) for c in encoder.count_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=[*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(rows, f"{schema}, tokens long")
