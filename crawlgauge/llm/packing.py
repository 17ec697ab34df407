"""Sum-of-squares packing of documents into fixed windows.

Each task packs the documents of its partition as they come. A document's ids (its
separator id last) fill whole windows first; the rest is placed at the fill level that
keeps the sum of the squared counts of partially filled windows least, which an array of
counts by level gives at once (a full window leaves the array; ties take the fuller
window). At the end of a partition the windows still open are merged by cutting pieces at
window ends, and the last partial one is cut into powers of two, which need no padding. No
rows are shuffled. Memory is one Arrow batch and the ids of the windows still open: few
where sizes vary (1,011 windows after 10,000 documents of the test tables), at most the
ids of the partition's texts.

Edge cases: a null text is an empty one and holds its separator alone; texts of any
length are cut into windows; repeated rows are packed each; only doc_id and text are read,
whatever other columns are called; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, table

WINDOW, SEPARATOR = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """The packer of one partition. A piece is [doc, start, ids, doc_tokens]; full windows come out as lists of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The fill level to which a rest of this size goes; 0 opens a window."""
        room = self.window - size
        before, after = self.count[1 : room + 1], self.count[size + 1 : self.window + 1]
        change = 2 * after - 2 * before + 2
        if room:
            change[-1] = 1 - 2 * before[-1]  # a full window is no longer counted
        change[before == 0] = np.iinfo(np.int64).max
        opened = 2 * self.count[size] + 1
        if not room or change.min() > opened:
            return 0
        return room - int(np.argmin(change[::-1]))

    def place(self, piece: list) -> Iterator[list]:
        size = len(piece[2])
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self._keep(level + size, pieces)

    def _keep(self, level: int, pieces: list) -> None:
        self.at[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        n, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield [[doc, start, ids[start : start + self.window], n]]
        if whole < n:
            yield from self.place([doc, whole, ids[whole:], n])

    def merge_open(self) -> Iterator[list]:
        """Empty the array: the open windows' pieces, one after the other, cut at window ends; a partial rest stays open."""
        pieces = [p for level in reversed(self.at) for window in level for p in window]
        self.count[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.open = 0
        rest = yield from self._cut(pieces, self.window)
        if rest:
            self._keep(sum(len(p[2]) for p in rest), rest)

    @staticmethod
    def _cut(pieces: list, window: int):
        out, fill = [], 0
        for doc, start, ids, n in pieces:
            while len(ids):
                part = ids[: window - fill]
                out.append([doc, start, part, n])
                start, ids, fill = start + len(part), ids[len(part) :], fill + len(part)
                if fill == window:
                    yield out
                    out, fill = [], 0
        return out

    def finish(self) -> Iterator[list]:
        yield from self.merge_open()
        left = [p for level in self.at for window in level for p in window]
        power = self.window
        while left:
            fill = sum(len(p[2]) for p in left)
            while power > fill:
                power //= 2
            left = yield from self._first(left, power)

    def _first(self, pieces: list, size: int):
        head, fill, tail = [], 0, []
        for doc, start, ids, n in pieces:
            k = min(len(ids), size - fill)
            if k:
                head.append([doc, start, ids[:k], n])
            if k < len(ids):
                tail.append([doc, start + k, ids[k:], n])
            fill += k
        yield head
        return tail


class Tokens:
    """Ids of a byte-level BPE given as a JSON file of the tokenizers library.

    The file's merges are run by tiktoken, which is three times as fast and yields the same
    ids (tests hold both against each other); texts that it refuses, and files with other
    parts than plain byte-level BPE, go to the tokenizers library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
        )
        self.fast = self._fast(spec) if plain else None

    @staticmethod
    def _fast(spec: dict):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocabulary = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"]["".join(m)] for m in merges]
        if order != sorted(order) or len(vocabulary) != len(merges) + 256:
            return None  # ids do not follow the merges
        return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens=added)

    @property
    @lru_cache(maxsize=1)  # noqa: B019
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # tiktoken gives up on some very long runs of white space with a Rust panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The PIECES, with_ids: and ids array<int> of each. sequence_id: the task's partition and a number within it."""
    small_batches(docs.sparkSession)

    def rows(sequences: Iterator[list], numbers: Iterator[int]) -> Iterator[tuple]:
        for pieces in sequences:
            sequence, offset = next(numbers), 0
            for doc, start, ids, n in pieces:
                yield (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, *([ids.astype(np.int32)] if with_ids else []))
                offset += len(ids)

    def pack_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 33
        numbers = iter(range(first, first + (1 << 33)))
        packer = SumOfSquares(window)
        names = [c.split()[0] for c in schema.split(", ")]

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = np.append(tokens(path).ids(value or ""), np.uint32(separator)).astype(np.uint32)
                out += rows(packer.add(doc, ids), numbers)
            yield frame(out)
        yield frame(list(rows(packer.finish(), numbers)))

    schema = PIECES + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(frugal(pack_all), schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
