"""N-gram Jaccard self-join by parity sketches.

A document's set holds the hashes of its distinct 5-word shingles. A parity sketch XORs
each hash into one of m words chosen by the hash: sets that differ in d shingles differ in
at most d words. Sets of Jaccard similarity 0.8 or more and sizes a and b differ in at most
(a + b) / 9 shingles. So, within a band of sizes with one m above that bound, similar sets
share a word, and by the pigeonhole they share one among the first k + 1 of their words in
any order common to all, k being the bound for the set's own size. The order takes frequent
words, as counted over all documents by a hash of 16 bits, last (it decides cost only, never
results), then words of many shingles first. Sets near the next band's sizes send words to it too.
A set with too few words that hold a shingle sends its empty words as well.

Documents that share a word are candidates: first each with the least of the word's group,
then, across what is not yet connected, the others of the group in blocks: those outside
the group's largest component with one another and with that component, which is never
compared within. Candidates must
pass the size ratio and a second, 1024-bit parity sketch, whose Hamming distance is a lower
bound of the difference too; what remains is verified on the whole texts' shingle sets.

Edge cases: a null text or one without words has an empty set and is linked with nothing;
texts with fewer than five words have one shingle; equal sets are one node from the start;
repeated rows are members of the same node; an empty table gives an empty result; null
doc_ids take part, and are the component's id only if no other is there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, doc_key, frugal, join_heads, small_batches, stored, table
from .components import components

SHINGLE, SKETCH_BITS = 5, 1024
#: Words are counted by BUCKETS hashes. Those of a bucket with more than twice a bucket's mean, and FREQUENT_LEAST, are frequent. Sets that a task remembers as sent.
BUCKETS, FREQUENT_LEAST, KNOWN_MOST = 1 << 16, 12, 1_000_000
#: Members of a word's group compared at once; rows up to which node lists are broadcast; links below which a round of nearest pairs is the last.
BLOCK, BROADCAST_NODES, FEW_LINKS = 256, 500_000, 1000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(size, len(h))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x += h[i : len(h) - n + 1 + i] * _MULTIPLIERS[i % 5]
        x = _mix(x) if i % 5 == 4 else x
    x = np.sort(x if n % 5 == 0 else _mix(x))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def most_apart(n: int) -> int:
    """The largest symmetric difference of a set of n with any set that is similar to it."""
    return (n + 5 * n // 4) // 9


def words_in_band(band: int) -> int:
    """m for sets of 2**band to 2**(band + 1) - 1 shingles."""
    return 2 * (2 ** (band + 1) - 1) // 9 + 2 + 2**band // 10


@functools.lru_cache(64)
def _salts(band: int) -> np.ndarray:
    return _mix(np.arange(words_in_band(band), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))


def remixed(x: np.ndarray) -> np.ndarray:
    """What the words of sketches are made of."""
    return _mix(x ^ np.uint64(0x5851F42D4C957F2D))


def parity_words(x: np.ndarray, y: np.ndarray, band: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sketch's words that hold a shingle, how many each holds, and, if no more than k hold one, keys of the empty words. y: remixed(x)."""
    salts = _salts(band)
    at = ((x >> np.uint64(32)) * np.uint64(len(salts))) >> np.uint64(32)  # rises with x
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    word = np.bitwise_xor.reduceat(y, starts)
    empty = np.setdiff1d(np.arange(len(salts), dtype=np.uint64), at[starts]) if len(starts) <= k else np.zeros(0, dtype=np.uint64)
    return _mix(word + salts[at[starts]]), np.diff(np.append(starts, len(x))), _mix(salts[empty] ^ np.uint64(0x2545F4914F6CDD1D))


def words_of(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Words by which a set can be joined, in its own band and, if a partner can be there, in the next; those of many shingles first.

    With them, for each band, how many words stand here and how many of these are to be sent.
    """
    n, y = len(x), remixed(x)
    band = n.bit_length() - 1
    k, out, parts = most_apart(n), [], []
    for b in (band, band + 1) if 5 * n // 4 >= 2 ** (band + 1) else (band,):
        keys, holds, empty = parity_words(x, y, b, k)
        few = len(keys) <= k
        if few:
            keys = np.concatenate((keys, empty))
        else:
            order = np.argsort(keys)
            keys = keys[order[np.argsort(-np.minimum(holds[order], 30_000).astype(np.int16), kind="stable")]]
        out.append(keys)
        parts += [len(keys), len(keys) if few else k + 1]
    return np.concatenate(out), parts


def chosen(keys: np.ndarray, often: np.ndarray, parts: list[int]) -> np.ndarray:
    """Of each band's words those to be sent, the least frequent ones."""
    out, start = [], 0
    for here, sent in zip(parts[::2], parts[1::2], strict=True):
        band = slice(start, start + here)
        out.append(keys[band] if sent == here else keys[band][np.argsort(often[band], kind="stable")[:sent]])
        start += here
    return np.concatenate(out)


def bit_sketch(x: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((x & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def identity(x: np.ndarray) -> int:
    """64 bits of the whole set."""
    if not len(x):
        return 0
    both = np.add.reduce(x ^ (x >> np.uint64(23)), keepdims=True) + np.bitwise_xor.reduce(x, keepdims=True) * _MULTIPLIERS[:1] + np.uint64(len(x))
    return int(_mix(both).view(np.int64)[0])


def word_counts(found: DataFrame) -> np.ndarray:
    """How many words of all sets fall into each of BUCKETS. found: stored features().

    Words are added up in the JVM, in each task first: a task sends a row for each bucket that it met.
    """
    bucket = F.shiftrightunsigned("key", 64 - BUCKETS.bit_length() + 1).cast("int").alias("bucket")
    counts = found.select(F.explode("keys").alias("key")).groupBy(bucket).agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[counts["bucket"].to_numpy(dtype=np.int64)] = counts["n"]
    return out


def frequent(counts: np.ndarray) -> np.ndarray:
    """counts of the buckets that are frequent, 0 elsewhere."""
    return np.where(counts > max(2 * counts.sum() // BUCKETS, FREQUENT_LEAST - 1), counts, 0)


FEATURES = "doc_id long, k long, n long, ident long, sketch array<long>, keys array<long>, parts array<int>"


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of each row; a task sends sketch, keys (all words by which a set can be joined) and parts (see words_of) once for each set that it meets, however many copies."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        for batch in batches:
            rows = []
            if len(known) > KNOWN_MOST:
                known.clear()
            for text in batch["text"]:
                x = shingle_set(text)
                ident = identity(x)
                first = bool(len(x)) and ident not in known
                known.add(ident)
                keys, parts = words_of(x) if first else (None, None)
                rows.append((len(x), ident if len(x) else None, bit_sketch(x) if first else None, keys.view(np.int64) if first else None, parts))
            out = pd.DataFrame(rows, columns=["n", "ident", "sketch", "keys", "parts"])
            out["ident"] = pd.array([r[1] for r in rows], dtype="Int64")
            out.insert(0, "doc_id", pd.arrays.IntegerArray(batch["id"].to_numpy(), batch["no_id"].to_numpy()))
            out.insert(1, "k", batch["k"].to_numpy())
            yield out

    # a column with nulls would reach pandas as doubles, which round large ids
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), doc_id.isNull().alias("no_id"), doc_key().alias("k"), "text")
    return rows.mapInPandas(frugal(compute), FEATURES)


def words_sent(found: DataFrame, often: np.ndarray) -> DataFrame:
    """(ident, key): the words by which each set of features() is joined."""
    often = found.sparkSession.sparkContext.broadcast(often)  # BUCKETS numbers
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = [chosen(keys, often.value[(keys.view(np.uint64) >> shift).astype(np.int64)], parts) for keys, parts in zip(batch["keys"], batch["parts"], strict=True)]
            yield pd.DataFrame({"ident": batch["ident"], "keys": sent})

    small_batches(found.sparkSession)
    return found.where("keys is not null").select("ident", "keys", "parts").mapInPandas(frugal(choose), "ident long, keys array<long>").select("ident", F.explode("keys").alias("key"))


def _near(a: str, b: str) -> Column:
    """Whether two nodes can be similar, by their sizes and bit sketches."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * apart <= na + nb)


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored (a, b) of the pairs whose sets, made again from the whole texts, are similar. nodes: stored (ident, n, sketch, k)."""
    a, b = nodes.alias("p"), nodes.alias("q")
    near = pairs.join(a, F.col("a") == F.col("p.ident")).join(b, F.col("b") == F.col("q.ident")).where(_near("p", "q"))
    near = stored(near.select("a", "b", F.col("p.k").alias("ka"), F.col("q.k").alias("kb")))
    wanted = stored(near.select(F.col("ka").alias("k")).union(near.select("kb")).distinct())
    texts = docs.select(doc_key().alias("k"), "text").join(broadcast_up_to(wanted, BROADCAST_NODES), "k", "left_semi").dropDuplicates(["k"])
    texts = stored(texts)
    # the partners of one set in blocks: its text is sent once a block, each partner's once a pair
    partners = stored(near.groupBy("a").agg(F.count("*").alias("n")))
    dealt = join_heads(near, partners, ["a"]).withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    leads = dealt.select("a", "block", F.lit(0).alias("role"), F.col("a").alias("b"), F.col("ka").alias("k")).distinct()
    rows = leads.unionByName(dealt.select("a", "block", F.lit(1).alias("role"), "b", F.col("kb").alias("k"))).join(texts, "k").select("a", "block", "role", "b", "text")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = []
            for role, text in zip(batch["role"], batch["text"], strict=True):
                y = shingle_set(text)
                if role == 0:
                    x = y
                    keep.append(False)
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    small_batches(docs.sparkSession)
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return stored(rows.mapInPandas(frugal(similar), "a long, b long"))


def rest_of_groups(shared: DataFrame, comps: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): near pairs of a word's group, apart from its least member, that no link connects so far.

    Groups are cut into blocks and the pairs of blocks dealt to tasks, which compare bit
    sketches in place. nearest: each component sends its nearest pair only, which connects
    large groups at a row a component; else every near pair across components is sent.
    """
    now = shared.join(comps, shared["ident"] == comps["id"], "left").select("key", "ident", "pivot", F.coalesce("component", "ident").alias("comp"))
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    groups = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("bulk"), F.max("c").alias("held"), F.sum("c").alias("n")).where("held < n and n > 2")
    groups = stored(groups)
    one = F.col("g.n") <= BLOCK
    others = F.when(one, 1).otherwise(F.ceil((F.col("g.n") - F.col("held")) / BLOCK)).cast("int")
    bulk = F.when(one, 0).otherwise(F.ceil(F.col("held") / BLOCK)).cast("int")
    rows = join_heads(now.where("ident <> pivot"), groups.select("key", "n", F.struct("n", "held", "bulk").alias("g")), ["key"]).drop("n")
    rows = rows.select("key", "ident", "comp", "g", F.col("g.held").alias("held")).join(nodes.select("ident", "n", "sketch"), "ident")
    # a group that fits is one block; else blocks 0 to others - 1 hold the members outside the largest component, the next ones that component
    inside = ~one & (F.col("comp") == F.col("g.bulk"))
    mine = F.when(inside, others + F.pmod(F.xxhash64("ident"), bulk)).otherwise(F.pmod(F.xxhash64("ident"), others)).cast("int")
    to = F.when(inside, others).otherwise(others + bulk)
    rows = rows.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), to - 1))})
    dealt = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "ident", "comp", "n", "sketch")

    def compare(ident: np.ndarray, comp: np.ndarray, n: np.ndarray, mine: np.ndarray, sketch: np.ndarray, across: bool) -> np.ndarray:
        """across: of two blocks only pairs across them, as each meets itself elsewhere."""
        if len(ident) < 2 or (comp == comp[0]).all():
            return np.zeros((0, 2), dtype=np.int64)
        found = []
        for start in range(0, len(ident) - 1, 64):
            rows = slice(start, start + 64)
            able = (comp[rows, None] != comp[None, start:]) & (5 * np.minimum(n[rows, None], n[None, start:]) >= 4 * np.maximum(n[rows, None], n[None, start:]))
            if across:
                able &= mine[rows, None] != mine[None, start:]
            a, b = (x + start for x in np.nonzero(np.triu(able, 1)))
            if len(a):
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
                near = 9 * apart <= n[a] + n[b]
                found.append(np.column_stack((a[near], b[near], apart[near])))
        if not found:
            return np.zeros((0, 2), dtype=np.int64)
        near = np.concatenate(found)
        if nearest and len(near):
            near = near[np.argsort(near[:, 2], kind="stable")]
            both = np.concatenate((comp[near[:, 0]], comp[near[:, 1]]))
            first = np.unique(both, return_index=True)[1]
            near = near[np.unique(first % len(near))]
        return np.sort(np.column_stack((ident[near[:, 0]], ident[near[:, 1]])), axis=1)

    def compare_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        sent: set[tuple[int, int]] = set()  # what this task has sent lately

        def fresh(pairs: np.ndarray) -> pd.DataFrame:
            if len(sent) > 500_000:
                sent.clear()
            new = [p for p in map(tuple, pairs.tolist()) if p not in sent and not sent.add(p)]
            return pd.DataFrame(new, columns=["a", "b"], dtype="int64")

        def groups(rows: pd.DataFrame, last: bool) -> tuple[Iterator[np.ndarray], int]:
            """Pairs of each whole group of rows, and where the group begins that may go on."""
            by = rows[["key", "i", "j"]].to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]).any(axis=1), [last])))
            ident, comp, n, mine = (rows[c].to_numpy() for c in ("ident", "comp", "n", "mine"))
            sketch = np.stack(rows["sketch"].to_numpy()).view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
            pairs = (compare(ident[s:e], comp[s:e], n[s:e], mine[s:e], sketch[s:e], by[s, 1] != by[s, 2]) for s, e in zip(cut[:-1], cut[1:], strict=True))
            return (p for p in pairs if len(p)), cut[-1]

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                pairs, rest = groups(held, False)
                found = list(pairs)
                if found:
                    yield fresh(np.concatenate(found))
                held = held.iloc[rest:]
        if held is not None and len(held):
            found = list(groups(held, True)[0])
            if found:
                yield fresh(np.concatenate(found))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(frugal(compare_all), "a long, b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n_shingles, ident, component) of every row; component: a set's identity, null for an empty set.

    k is the document's key (common.doc_key); rows of one component are linked, directly or through others.
    """
    docs = docs.select("doc_id", "text")
    found = stored(features(docs))
    sent = found.where("keys is not null")
    words = words_sent(found, frequent(word_counts(found)))
    groups = words.groupBy("key").agg(F.min("ident").alias("pivot"), F.max("ident").alias("top"), F.count("*").alias("n")).where("pivot <> top")
    shared = stored(join_heads(words, stored(groups.select("key", "pivot", "n")), ["key"]).select("key", "ident", "pivot").distinct())
    idents = shared.select("ident").distinct()
    nodes = sent.join(idents, "ident", "left_semi").groupBy("ident").agg(F.min_by(F.struct("n", "sketch", "k"), "k").alias("s"))
    nodes = stored(nodes.select("ident", "s.n", "s.sketch", "s.k"))
    links = verify(shared.where("ident <> pivot").select(F.col("pivot").alias("a"), F.col("ident").alias("b")).distinct(), nodes, docs)
    comps = stored(components(links))
    # connect what is near first, so that the last round, which tries every near pair, has few left
    nearest = True
    while True:
        more = verify(rest_of_groups(shared, comps, nodes, nearest), nodes, docs)
        new = more.count()
        if new:
            links = stored(links.union(more))
            comps = stored(components(links))
        if not nearest:
            break
        nearest = new >= FEW_LINKS
    comps = broadcast_up_to(comps, BROADCAST_NODES)
    members = found.select("doc_id", "k", F.col("n").alias("n_shingles"), "ident")
    return members.join(comps, members["ident"] == comps["id"], "left").select(
        "doc_id", "k", "n_shingles", "ident", F.coalesce("component", "ident").alias("component")
    )


def with_component_id(members: DataFrame) -> DataFrame:
    """members with component_id, the smallest doc_id of the component; a document without a set is its own."""
    least = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    least = stored(least.where("members > 1").drop("members"))
    out = members.join(broadcast_up_to(least, BROADCAST_NODES), "component", "left")
    return out.withColumn("component_id", F.coalesce("least", "doc_id")).drop("least")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all documents without words stay. Same columns."""
    members = stored(join(docs))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), "k")
    groups = members.where("component is not null").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    groups = broadcast_up_to(stored(groups), BROADCAST_NODES)
    grouped = stored(members.join(groups, "component").select("k", (place == F.col("first")).alias("kept")))
    gone = stored(grouped.where("not kept").select("k").distinct())
    twice = stored(grouped.where("kept").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    rows = docs.select(F.struct("*").alias("row"), doc_key().alias("k")).join(broadcast_up_to(gone, BROADCAST_NODES), "k", "left_anti")
    if not twice.limit(1).count():
        return rows.select("row.*")
    # rows that repeat a kept document: one of them stays
    twice = broadcast_up_to(twice, BROADCAST_NODES)
    return rows.join(twice, "k", "left_anti").unionByName(rows.join(twice, "k", "left_semi").dropDuplicates(["k"])).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    members = stored(join(table(spark, sf_dir, "documents")))
    return with_component_id(members).select("doc_id", "n_shingles", "component_id")
