"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves each pre-token that is a
vocabulary entry as a whole. Tier two: any other pre-token is merged with a heap of ranked
pairs over linked bytes. Within a batch each distinct pre-token is resolved once; the
merges of missed pre-tokens are kept in a bounded cache of the worker. Texts pass through
as Arrow batches and no rows are shuffled.

Edge cases: a null text is an empty one and has no ids; texts of any length are
pre-tokenized in blocks; repeated rows are encoded each; an empty table gives an empty
result; ids outside the vocabulary cannot be decoded and raise an error.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, table

#: Pre-tokens resolved together, and merged pre-tokens kept by a worker.
BLOCK, CACHE = 300_000, 200_000
#: Letters, numbers and white space below U+0250, for texts that hold nothing beyond it.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}


class MinimalPerfectHash:
    """Numbers n byte strings 0 to n-1 without gaps; each level holds the keys that met no other key there."""

    KEYS = ("crawlgauge-mph-a", "crawlgauge-mph-b")

    def __init__(self, keys: list[bytes]):
        self.size, self.levels, base = len(keys), [], 0
        hashes = self._hashes(np.array(keys, dtype=object))
        left = np.arange(len(keys))
        while len(left):
            slots = max(64, 2 * len(left))
            at = self._slot([h[left] for h in hashes], len(self.levels), slots)
            taken = np.bincount(at, minlength=slots) == 1
            self.levels.append((taken, base + np.cumsum(taken) - 1))
            base += int(taken.sum())
            left = left[~taken[at]]
        self.stored = np.empty(self.size, dtype=object)
        self.stored[self._numbers(hashes)] = keys

    def _hashes(self, keys: np.ndarray) -> list[np.ndarray]:
        return [pd.util.hash_array(keys, hash_key=k, categorize=False) for k in self.KEYS]

    @staticmethod
    def _slot(hashes: list[np.ndarray], level: int, slots: int) -> np.ndarray:
        mixed = (hashes[0] + np.uint64(level) * (hashes[1] | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)

    def _numbers(self, hashes: list[np.ndarray]) -> np.ndarray:
        found, left = np.full(len(hashes[0]), -1), np.arange(len(hashes[0]))
        for level, (taken, number) in enumerate(self.levels):
            at = self._slot([h[left] for h in hashes], level, len(taken))
            hit = taken[at]
            found[left[hit]] = number[at[hit]]
            left = left[~hit]
        return found

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not stored."""
        if not len(keys):
            return np.zeros(0, dtype=np.int64)
        found = self._numbers(self._hashes(keys))
        return np.where(self.stored[np.maximum(found, 0)] == keys, found, -1)


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s as Unicode's White_Space: the regex module's own class holds four control characters more
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(LATIN.values())}]").replace(r"\S", f"[^{LATIN[r'\s']}]")
        for name, chars in LATIN.items():
            latin = latin.replace(name, f"[{chars}]")
        self.latin, self.beyond = re.compile(latin), re.compile("[^\x00-\u024f]")
        self.ranks = ranks
        self.hash = MinimalPerfectHash(list(ranks))
        self.id_at = np.array([ranks[k] for k in self.hash.stored], dtype=np.int32)
        self.token = {i: t for t, i in ranks.items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids (int32, native) of a piece that is no vocabulary entry.

        end[i]: where the token that starts at i ends, 0 if none does. A heap entry holds a pair's
        rank, start and end in one number, so that the lowest rank, then the leftmost pair, comes first.
        """
        n, rank = len(piece), self.ranks.get
        bits = n.bit_length()
        low, two = (1 << bits) - 1, 2 * bits
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            e, i = pair & low, pair >> bits & low
            j = end[i]
            if not j or j == n or end[j] != e:
                continue
            end[i], end[j], before[e] = e, 0, i
            if e < n and (r := rank(piece[i : end[e]])) is not None:
                heappush(heap, r << two | i << bits | end[e])
            if (p := before[i]) >= 0 and (r := rank(piece[p:e])) is not None:
                heappush(heap, r << two | p << bits | e)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return array("i", ids).tobytes()

    def missed(self, key: bytes) -> bytes:
        """merge() with a cache of two generations: what is used again outlives what is not."""
        if (ids := self.young.get(key)) is None:
            if (ids := self.old.get(key)) is None:
                ids = self.merge(key)
            if len(key) <= 64:
                self.young[key] = ids
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
        return ids

    def resolve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each piece has."""
        at, distinct = pd.factorize(np.array(pieces, dtype=object))
        keys = np.empty(len(distinct), dtype=object)
        keys[:] = [p.encode() for p in distinct]
        whole = self.hash.lookup(keys)
        missed = np.flatnonzero(whole < 0)
        parts = [self.missed(keys[i]) for i in missed]
        lengths = np.ones(len(keys), dtype=np.int64)
        lengths[missed] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        flat = np.empty(int(lengths.sum()), dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        flat[starts[whole >= 0]] = self.id_at[whole[whole >= 0]]
        flat[np.repeat(starts[missed], lengths[missed]) + _ramp(lengths[missed])] = np.frombuffer(b"".join(parts), dtype=np.int32)
        counts = lengths[at]
        return flat[np.repeat(starts[at], counts) + _ramp(counts)], counts

    def encode_batch(self, texts) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[list[str]] = []
        owners: list[int] = []
        held = 0

        def flush():
            nonlocal held
            ids, counts = self.resolve(list(chain.from_iterable(waiting)))
            ends = np.cumsum(counts)
            done = 0
            for owner, part in zip(owners, waiting, strict=True):
                first = int(ends[done - 1]) if done else 0
                done += len(part)
                out[owner].append(ids[first : int(ends[done - 1])])
            waiting.clear()
            owners.clear()
            held = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            pattern = self.pattern if self.beyond.search(text) else self.latin
            found = iter([pattern.findall(text)]) if len(text) < BLOCK else _blocks(m.group() for m in pattern.finditer(text))
            for part in found:
                waiting.append(part)
                owners.append(k)
                held += len(part)
                if held >= BLOCK:
                    flush()
        if waiting:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in out]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _blocks(pieces: Iterator[str]) -> Iterator[list[str]]:
    while block := list(islice(pieces, BLOCK)):
        yield block


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec in each worker; the rank file is an installed file, the same on every machine."""
    return BytePairCodec(read_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of ids."""

    @F.pandas_udf("array<int>")
    @frugal
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(codec(path, pattern).encode_batch(texts.tolist()), dtype=object)

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary of the ids' tokens, one after the other."""

    @F.pandas_udf("binary")
    @frugal
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([codec(path, pattern).decode(x) for x in rows], dtype=object)

    return decoded(ids)


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """row (docs' columns), ids array<int>, decoded binary (the ids decoded again)."""
    small_batches(docs.sparkSession)
    encoded = docs.select(F.struct("*").alias("row")).withColumn("ids", encode(F.col(f"row.{text}"), path, pattern))
    return encoded.withColumn("decoded", decode(F.col("ids"), path, pattern))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
