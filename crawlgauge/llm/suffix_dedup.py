"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document
of smaller doc_id, or earlier in the same one. Strings are judged on the input.

1. Anchors. Of the hashes of GRAM bytes in every LENGTH-byte string, the least (the first
   of equal ones) is an anchor. The choice depends on the string alone, so its copies have
   the same anchor at the same spot, and copies meet by joining anchors. An anchor's
   context holds all strings that chose it.
2. Equal contexts of an anchor are one entry that stands at its earliest place; its other
   places repeat that one whole.
3. Entries of anchors with different contexts go to shards by the anchor's earliest
   document. A shard's contexts are one text (those of a document that overlap are one
   stretch of it). Its suffix array is built by induced sorting, permuted common prefixes
   give the runs of suffixes that share LENGTH bytes, and of a run all but the earliest
   place go.
4. Anchors of more than ANCHOR_MOST different contexts are first told apart: the strings of
   a context are halved by where the anchor stands in them, each half is keyed by the bytes
   common to its strings, and halves are entries as in 2. Half of them usually are alone
   with their key or equal; what still has too many contexts is halved again, until a key
   is a string. So a shard is bounded however many contexts an anchor has, and a context
   has at most two rows in each of six rounds.

Edge cases: a null text is an empty one; a null doc_id comes after all others; documents of
equal doc_id and different text are ordered by a hash of both; rows equal in doc_id and
text are one document, and each gets its result; texts of any length are taken in
stretches of BUFFER bytes; an empty table gives an empty result. Cut characters stay cut:
``kept`` is bytes; ``kept_text`` drops the broken characters and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import broadcast_bytes_up_to, doc_key, frugal, join_heads, order_of_id, release_memory, small_batches, stored, table
from .induced_sort import common_prefixes, suffix_array

#: Longer grams recur less by chance, shorter ones need fewer anchors: 2 in LENGTH - GRAM + 2 bytes.
LENGTH, GRAM = 100, 40
#: Bytes hashed at once: a task's arrays hold some sixty bytes for each.
BUFFER = 1 << 19
#: Different contexts of one anchor that a shard takes whole; contexts that a shard should hold; bytes of an earliest
#: document whose anchors meet in one shard; the shard number of contexts that are told apart first; tasks that sort shards.
ANCHOR_MOST, SHARD_ROWS, LEADER_BYTES, TOLD_APART, MOST_TASKS = 1000, 6000, 8192, -1, 20_000
#: A byte that no text holds in UTF-8: ends the contexts in a shard's text.
END = b"\xff"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > BUFFER + 1:  # only here: not kept
            return _powers(n, _BASE), _powers(n, _INVERSE)
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BUFFER + 1, _BASE), _powers(BUFFER + 1, _INVERSE)
        return cls.up[:n], cls.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substring of data from one pass of prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.of(len(data) + 1)
        codes = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)  # bytes as random words
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, context hash, context start, anchor, context end) of all anchors; data: documents one after the other, ends: their ends."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    h = Hashes(data)
    width = length - gram + 1
    position = np.arange(len(data) - gram + 1)
    grams = h.of(position, position + gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | position.astype(np.uint64)
    least = (_sliding_min(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    inside = doc[: len(least)] == doc[length - 1 :]
    least = least[inside]
    if not len(least):
        return none, none, none, none, none, none
    at = least[np.concatenate(([True], least[1:] != least[:-1]))]  # a document's windows choose rising places
    d = doc[at]
    lo, hi = np.maximum(at - (length - gram), starts[d]), np.minimum(at + length, ends[d])
    context = _mix(h.of(lo, hi) + (at - lo).astype(np.uint64) * np.uint64(_BASE) + (hi - lo).astype(np.uint64))
    return d, grams[at].view(np.int64), context.view(np.int64), lo - starts[d], at - starts[d], hi - starts[d]


#: by: what the row is dealt by, of a COUNTED row its anchor; code: kind, length, anchor and start of the span in one number.
ROWS = "by long, anchor long, context long, ord long, k long, code long"
#: kind of a row: it counts towards its anchor's places; its anchor is known to recur; a span to remove.
COUNTED, RECURS, SPAN = 0, 1, 2


def _buffers(texts: pd.Series, length: int) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Stretches of the texts, at most BUFFER bytes at a time, with the number of their text and their start in it.

    A longer text is cut into stretches that overlap by length - 1 bytes, so that each string lies in one.
    """
    parts: list[bytes] = []
    numbers: list[int] = []
    starts: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        data = (text or "").encode()
        for start in range(0, max(1, len(data) - length + 1), BUFFER - length + 1):
            part = data[start : start + BUFFER]
            if held + len(part) > BUFFER and parts:
                yield parts, numbers, starts
                parts, numbers, starts, held = [], [], [], 0
            parts.append(part)
            numbers.append(number)
            starts.append(start)
            held += len(part)
    if parts:
        yield parts, numbers, starts


def _anchors_of(parts: list[bytes], numbers: list[int], starts: list[int], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors() of stretches, with the numbers of their texts and places in them."""
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    d, anchor, context, lo, at, hi = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, length, gram)
    first = np.array(starts, dtype=np.int64)[d]
    return np.array(numbers, dtype=np.int64)[d], anchor, context, lo + first, at + first, hi + first


def anchor_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """ROWS of (k, ord, text) rows. Of contexts that recur within a batch only the first is sent on; the rest are spans."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # documents in their order, so that the first of equal contexts is the earliest; a document met twice counts once
            batch = batch.drop_duplicates("k").sort_values(["ord", "k"], kind="stable")
            found = [part for buffer in _buffers(batch["text"], length) for part in [_anchors_of(*buffer, length, gram)] if len(part[0])]
            if not found:
                continue
            d, anchor, context, lo, at, hi = map(np.concatenate, zip(*found, strict=True))
            out = pd.DataFrame({"anchor": anchor, "context": context})
            kind = np.where(out.duplicated().to_numpy(), SPAN, COUNTED)
            # of an anchor with several contexts here, two rows stand witness and the others need no count
            kept = out[kind == COUNTED]
            number = kept.groupby("anchor", sort=False).cumcount()
            kind[number.index[number >= 2]] = RECURS
            counted = kind == COUNTED
            spread = _mix((anchor ^ context).view(np.uint64) + lo.astype(np.uint64)).view(np.int64)
            yield pd.DataFrame({
                "by": np.where(counted, anchor, spread), "anchor": np.where(counted, 0, anchor), "context": context, "ord": batch["ord"].to_numpy()[d],
                "k": batch["k"].to_numpy()[d], "code": kind + 4 * ((hi - lo) + 256 * ((at - lo) + 64 * lo)),
            })

    return docs.mapInPandas(frugal(compute), ROWS)


def _later_in_shard(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans (k, ord, lo, hi) of a shard's contexts that repeat an earlier one's strings."""
    shard = shard.sort_values(["ord", "k", "lo"], ignore_index=True)
    data = np.frombuffer(END.join([*shard["bytes"], b""]), dtype=np.uint8)
    sizes = shard["bytes"].map(len).to_numpy().astype(np.int32)
    ord_, k, at = shard["ord"].to_numpy(), shard["k"].to_numpy(), shard["lo"].to_numpy()
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    sa = suffix_array(data)
    shared = common_prefixes(data, sa)
    # contexts are in document order, so (document, place) orders strings, those of overlapping contexts too
    doc = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (ord_[1:] != ord_[:-1]))))
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    place = np.arange(len(data)) - starts[owner]
    whole = place + length <= sizes[owner]  # the suffix holds a string of its own context
    when = doc[owner] * np.int64(1 << 40) + at[owner] + place
    heads = np.flatnonzero(shared[sa] < length)
    in_order = when[sa]
    first = np.repeat(np.minimum.reduceat(in_order, heads), np.diff(np.append(heads, len(sa))))
    late = sa[whole[sa] & (in_order > first)].astype(np.int64)
    late.sort()
    if not len(late):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("k", "ord", "lo", "hi")})
    new = np.concatenate(([True], (late[1:] != late[:-1] + 1) | (owner[late[1:]] != owner[late[:-1]])))
    head, tail = late[new], late[np.append(np.flatnonzero(new)[1:] - 1, len(late) - 1)]
    return pd.DataFrame({"k": k[owner[head]], "ord": ord_[owner[head]], "lo": at[owner[head]] + place[head], "hi": at[owner[tail]] + place[tail] + length})


def _later_and_release(shard: pd.DataFrame, length: int) -> pd.DataFrame:
    out = _later_in_shard(shard, length)
    release_memory()
    return out


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of a document in the same shard that overlap become one stretch; those to be told apart stay alone."""
    for batch in batches:
        out = []
        for at in batch["at"]:
            merged: list[dict] = []
            for c in sorted(at, key=lambda x: (x["shard"], x["lo"], x["hi"])):
                if merged and merged[-1]["shard"] == c["shard"] != TOLD_APART and c["lo"] <= merged[-1]["hi"]:
                    merged[-1]["hi"] = max(merged[-1]["hi"], c["hi"])
                else:
                    merged.append(dict(c))
            out.append(merged)
        yield pd.DataFrame({"k": batch["k"], "ord": batch["ord"], "at": out})


def _halves(rows: DataFrame, low: int, high: int, length: int) -> DataFrame:
    """Rows (k, ord, lo, at, bytes) cut to the strings that start ``low`` to ``high`` bytes before the anchor, with their common bytes as core; those without such strings go."""
    start, end = F.greatest("lo", F.col("at") - high), F.least(F.col("at") - low, F.col("lo") + F.octet_length("bytes") - length)
    cut = rows.withColumns({"start": start, "end": end}).where("start <= end")
    cut = cut.select("k", "ord", F.col("start").alias("lo"), "at", F.substring("bytes", F.col("start") - F.col("lo") + 1, F.col("end") + length - F.col("start")).alias("bytes"))
    core = F.substring("bytes", F.col("at") - low - F.col("lo") + 1, F.lit(length - (high - low)))
    return cut.withColumns({"low": F.lit(low), "core": core})


def told_apart(rows: DataFrame, most: int, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of contexts of crowded anchors: (k, ord, lo, hi) spans that repeat another whole, and entries (k, ord, lo, bytes, core, low) of cores with 2 to most contexts."""
    spans, entries = [], []
    ranges = [(0, length - gram)]
    while ranges and rows.limit(1).count():
        halves = [half for low, high in ranges for half in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)) if half[0] <= half[1]]
        if len(ranges) == 1 and "low" not in rows.columns:
            cut = [_halves(rows, low, high, length) for low, high in halves]
        else:
            of = {low: next(r[0] for r in ranges if r[0] <= low <= r[1]) for low, _ in halves}
            cut = [_halves(rows.where(F.col("low") == of[low]).drop("low", "core"), low, high, length) for low, high in halves]
        seen = cut[0]
        for half in cut[1:]:
            seen = seen.unionByName(half)
        seen = stored(seen)
        spot = F.struct("ord", "k", "lo", "at")
        first = stored(seen.groupBy("low", "core", "bytes").agg(F.min(spot).alias("first"), F.count("*").alias("n")))
        again = join_heads(seen, first.where("n > 1"), ["low", "core", "bytes"]).where(spot > F.col("first"))
        spans.append(again.select("k", "ord", "lo", (F.col("lo") + F.octet_length("bytes")).alias("hi")))
        cores = stored(first.groupBy("low", "core").agg(F.count("*").alias("n")).where("n > 1"))
        mixed = join_heads(first.select("low", "core", "bytes", "first"), cores, ["low", "core"])
        entry = mixed.select("first.k", "first.ord", "first.lo", "first.at", "bytes", "low", "core", "n")
        entries.append(entry.where(F.col("n") <= most).drop("n", "at"))
        rows = stored(entry.where(F.col("n") > most).drop("n"))
        ranges = [r for r in halves if r[0] < r[1]]
    return spans, entries


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, anchor_most: int = ANCHOR_MOST) -> DataFrame:
    """Stored (k, ord, spans): by document the removed runs as [start, end, start, end, ...], only of documents that lose bytes."""
    texts = docs.select(doc_key().alias("k"), order_of_id().alias("ord"), "text")
    rows = anchor_rows(texts, length, gram)
    # recurring anchors: rows of unknown anchors meet by anchor, all others are dealt out
    kind = F.pmod("code", F.lit(4)).cast("int")
    length_, before, start = F.pmod(F.shiftright("code", 2), F.lit(256)), F.pmod(F.shiftright("code", 10), F.lit(64)), F.shiftright("code", 16)
    recurs = rows.withColumn("places", F.count_if(kind == COUNTED).over(Window.partitionBy("by"))).where((kind != COUNTED) | (F.col("places") > 1))
    seen = stored(recurs.select(
        kind.alias("kind"), F.when(kind == COUNTED, F.col("by")).otherwise(F.col("anchor")).alias("anchor"), "context", "ord", "k",
        start.alias("lo"), (start + before).alias("at"), (start + length_).alias("hi"),
    ))
    places = seen.where(F.col("kind") != SPAN)
    spot = F.struct("ord", "k", "lo", "at", "hi")
    first = stored(places.groupBy("anchor", "context").agg(F.min(spot).alias("first"), F.count("*").alias("n")))
    whole = join_heads(places, first.where("n > 1"), ["anchor", "context"]).where(spot > F.col("first"))
    # an anchor's contexts meet where its earliest document is dealt, so contexts that overlap there become one stretch
    several = stored(first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("leader")).where("n > 1"))
    total = several.where(F.col("n") <= anchor_most).agg(F.sum("n")).first()[0] or 0
    shards = max(1, total // SHARD_ROWS)
    block = F.floor(F.col("leader.lo") / LEADER_BYTES)
    upto = F.sum("n").over(Window.partitionBy("leader.k", block).orderBy("leader.lo", "anchor"))
    calm = several.where(F.col("n") <= anchor_most).withColumn("part", F.floor(upto / SHARD_ROWS))
    calm = calm.select("anchor", "n", F.pmod(F.xxhash64("leader.k", block, "part"), F.lit(shards)).alias("shard"))
    crowded = several.where(F.col("n") > anchor_most).select("anchor", "n", F.lit(TOLD_APART).cast("long").alias("shard"))
    mixed = join_heads(first.select("anchor", "first"), stored(calm.unionByName(crowded)), ["anchor"])
    mixed = mixed.groupBy("first.k", "first.ord").agg(F.collect_list(F.struct("shard", "first.lo", "first.at", "first.hi")).alias("at"))  # a document's own anchors
    mixed = stored(mixed.mapInPandas(frugal(_stretches), "k long, ord long, at array<struct<shard:long,lo:long,at:long,hi:long>>"))
    size = mixed.agg(F.sum(F.size("at") * 64 + 64)).first()[0] or 0  # bytes of a list's struct and row
    fetched = texts.join(broadcast_bytes_up_to(mixed, size), ["k", "ord"])
    parts = fetched.select("k", "ord", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"), F.explode("at").alias("c")).select(
        "k", "ord", "c.shard", "c.lo", "c.at", F.substring("b", (F.col("c.lo") + 1).cast("int"), (F.col("c.hi") - F.col("c.lo")).cast("int")).alias("bytes")
    )
    parts = stored(parts.dropDuplicates(["k", "ord", "shard", "lo", "at"]))
    equal, entries = told_apart(parts.where(F.col("shard") == TOLD_APART).drop("shard"), anchor_most, length, gram)
    tasks = shards
    shard_parts = parts.where(F.col("shard") != TOLD_APART).select("shard", "ord", "k", "lo", "bytes")
    if entries:
        apart = entries[0]
        for more in entries[1:]:
            apart = apart.unionByName(more)
        apart = stored(apart)
        further = max(1, apart.count() // SHARD_ROWS)
        more, tasks = F.pmod(F.xxhash64("low", "core"), F.lit(further)) + shards, shards + further
        shard_parts = shard_parts.unionByName(apart.select(more.alias("shard"), "ord", "k", "lo", "bytes"))
    # shards are small in bytes and long to sort, so tasks follow their number
    sorted_ = shard_parts.repartition(min(tasks, MOST_TASKS), "shard").groupBy("shard").applyInPandas(lambda pdf: _later_and_release(pdf, length), "k long, ord long, lo long, hi long")
    spans = seen.where(F.col("kind") == SPAN).select("k", "ord", "lo", "hi").unionByName(whole.select("k", "ord", "lo", "hi")).unionByName(sorted_)
    for more in equal:
        spans = spans.unionByName(more)
    lists = spans.groupBy("k", "ord").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # a document's own spans

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = []
            for pairs in batch["spans"]:
                out: list[int] = []
                for lo, hi in sorted((p["lo"], p["hi"]) for p in pairs):
                    if out and lo <= out[-1]:
                        out[-1] = max(out[-1], hi)
                    else:
                        out += [lo, hi]
                merged.append(out)
            yield pd.DataFrame({"k": batch["k"], "ord": batch["ord"], "spans": merged})

    return stored(lists.mapInPandas(frugal(merge), "k long, ord long, spans array<long>"))


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row (docs' columns), n_bytes, n_removed, n_spans, kept (binary)."""
    spans = repeated_spans(docs.select("doc_id", "text"), length)
    spans = broadcast_bytes_up_to(spans, spans.agg(F.sum(F.size("spans") * 8 + 64)).first()[0] or 0)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, lists, strict=True):
            if spans is None:
                out.append(None)
                continue
            b, kept, done = text.encode(), [], 0
            for lo, hi in zip(spans[::2], spans[1::2], strict=True):
                kept.append(b[done:lo])
                done = hi
            out.append(b"".join([*kept, b[done:]]))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"), doc_key().alias("k"), order_of_id().alias("ord")).join(spans, ["k", "ord"], "left")
    whole = F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")
    rows = rows.withColumn("kept", F.coalesce(cut(F.when(F.col("spans").isNotNull(), F.col("row.text")), F.col("spans")), whole))
    n = F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long")
    return rows.select(
        "row", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"),
        (F.coalesce(F.size("spans"), F.lit(0)) / 2).cast("long").alias("n_spans"), "kept",
    )


def kept_text(kept: Column) -> Column:
    """The kept bytes as text: pieces of characters that a cut left are dropped, genuine U+FFFD stay."""

    @F.pandas_udf("string")
    def whole_characters(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(errors="ignore"))

    return whole_characters(kept)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
