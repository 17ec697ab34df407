"""Balanced label propagation: linked documents move together, shards stay even.

Documents get a number without gaps. Those with links start in even ranges, ordered by the
least of each document and its neighbours, so documents around one start side by side. In
each round they look at their neighbours' shards: who has more neighbours in another shard
proposes to move there. Proposals are counted by the pair of shards, and as many are met as
exchanges and the shards' room allow: arrivals exceed departures by at most the room, so
linked documents change places even where no shard has room, and none outgrows its quota.
Of a pair's proposals the greatest gains go first, neighbours of one document together.
Odd and even rounds take turns between documents that have a smaller neighbour and those
that have none, so that two ends of a link do not swap.
Documents without links come last and fill every shard to its exact quota: document
counts differ by one at most (law ``rows``).

Numbers and ranks come from counts by hash bucket plus a place within the bucket, so no
task sorts a shard as a whole.

ROUNDS bounds the rounds: what has not settled by then stays where it is, and counts are
exact all the same.

Edge cases: a null text has size 1 and links with nothing; a null doc_id is placed like any
other; rows equal in all columns are placed one by one; an empty table gives an empty
result; very long texts are only hashed and measured; of equal proposals a hash decides;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_heads, stored, table

SHARDS, ROUNDS = 8, 8
#: Rows that a numbering bucket should hold, and buckets of one gain among the proposals to a shard.
BUCKET_ROWS, GAIN_BUCKETS = 20_000, 256


#: Cycles of exchanges that a round's plan may take; a plan cut short is valid, and the next round goes on from it.
CYCLES = 2000


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, bucket: Column | None = None) -> DataFrame:
    """df with a number from 0, without gaps, within each combination of by.

    order: columns that settle the order within a bucket. bucket: orders first; None: a hash of order.
    """
    rows = df.count()
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(max(1, rows // BUCKET_ROWS))) if bucket is None else bucket)
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.select(*[F.col(c).alias(f"_{c}") for c in [*by, "_b"]], "_o")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    placed = df.withColumn("_p", place)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_b"]]
    joined = placed.join(F.broadcast(offsets), on) if rows < 10**9 else placed.join(offsets, on)  # one row per bucket: rows / BUCKET_ROWS
    return joined.withColumn(name, (F.col("_p") - 1 + F.col("_o")).cast("long")).drop("_b", "_p", "_o", "__b", *[f"_{c}" for c in by])


def exchanges(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wishes (from, to) -> n are met: no shard's arrivals exceed its departures by more than its room.

    A greatest circulation by cancelling cycles: shards are nodes, a further node lends and takes back room.
    """
    outside = len(room)
    edges: list[list[int]] = []  # [from, to, free, gain]; an edge and its reverse are neighbours
    for (a, b), n in wishes.items():
        edges += [[a, b, n, 1], [b, a, 0, -1]]
    for s, n in enumerate(room):
        edges += [[s, outside, n, 0], [outside, s, 0, 0], [outside, s, sum(wishes.values()), 0], [s, outside, 0, 0]]
    for _ in range(CYCLES):
        best, via, last = [0] * (outside + 1), [-1] * (outside + 1), -1
        for _ in range(outside + 1):
            last = -1
            for e, (a, b, free, gain) in enumerate(edges):
                if free and best[a] + gain > best[b]:
                    best[b], via[b], last = best[a] + gain, e, b
            if last < 0:
                break
        if last < 0:
            break
        for _ in range(outside + 1):  # back into the cycle
            last = edges[via[last]][0]
        cycle, at = [via[last]], edges[via[last]][0]
        while at != last:
            cycle.append(via[at])
            at = edges[via[at]][0]
        most = min(edges[e][2] for e in cycle)
        for e in cycle:
            edges[e][2] -= most
            edges[e ^ 1][2] += most
    return {pair: edges[2 * i + 1][2] for i, pair in enumerate(wishes)}


def propagate(links: DataFrame, state: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Stored (v, shard) of the linked documents. links: stored (a, b), each link once; state: stored (v, shard)."""
    both = stored(links.select("a", "b").union(links.select("b", "a")))
    hubs = both.groupBy("a").agg((F.min("b") < F.col("a")).alias("has_smaller"), F.least("a", F.min("b")).alias("hub"))
    state = stored(state.join(hubs, state["v"] == hubs["a"]).select("v", "shard", "has_smaller", "hub"))
    shards, quiet = len(quota), 0
    for r in range(rounds):
        moving = state.where(F.col("has_smaller") == F.lit(r % 2 == 0))
        seen = both.join(state.select(F.col("v").alias("b"), F.col("shard").alias("at")), "b").groupBy("a", "at").agg(F.count("*").alias("c"))
        best = seen.groupBy("a").agg(F.max_by("at", F.struct("c", -F.col("at"))).alias("to"), F.max("c").alias("most"), F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("by"))
        wish = moving.join(best, moving["v"] == best["a"]).where("to <> shard")
        wish = wish.withColumn("gain", F.col("most") - F.coalesce(F.element_at("by", F.col("shard")), F.lit(0))).where("gain > 0")
        bucket = F.pmod(F.xxhash64("hub", F.lit(r)), F.lit(GAIN_BUCKETS))
        wish = stored(wish.select("v", "shard", "to", "hub", "gain", bucket.alias("bucket")))
        held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        room = [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]
        wishes = {(x["shard"], x["to"]): x["n"] for x in wish.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # one row a pair of shards
        met = {pair: n for pair, n in exchanges(wishes, room).items() if n}
        if not met:
            quiet += 1
            if quiet == 2:
                break
            continue
        quiet = 0
        met = F.create_map(*[x for (a, b), n in met.items() for x in (F.lit(a * shards + b), F.lit(n))])
        group = ["shard", "to", "gain", "bucket"]
        counts = wish.groupBy(*group).agg(F.count("*").alias("n"))  # fewer rows than wishes
        upto = Window.partitionBy("shard", "to").orderBy(F.desc("gain"), "bucket")
        left = F.coalesce(F.element_at(met, F.col("shard") * shards + F.col("to")), F.lit(0)) - (F.sum("n").over(upto) - F.col("n"))
        granted = stored(counts.withColumn("take", left).where("take > 0"))
        # whole groups go as they are, the last one of a pair in part
        whole = wish.join(granted.where("take >= n").select(*group), group, "left_semi").select("v", "to")
        part = wish.join(granted.where("take < n").select(*group, "take"), group)
        part = part.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("hub", "v"))).where("place <= take").select("v", "to")
        moves = whole.union(part)
        moves = stored(moves)
        state = stored(state.join(moves, "v", "left").select("v", F.coalesce("to", "shard").alias("shard"), "has_smaller", "hub"))
    return state.select("v", "shard")


def beside(linked: DataFrame, n_linked: int) -> DataFrame:
    """(v, i): linked documents (v, hub) numbered from 0, those of equal hub side by side; a hub of very many is cut into buckets."""
    large = linked.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    rows = linked.join(large, "hub", "left")
    cut = F.pmod(F.xxhash64("v"), F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)))
    bucket = F.struct(F.pmod(F.xxhash64("hub"), F.lit(max(1, n_linked // BUCKET_ROWS))), F.when(F.col("n").isNotNull(), F.col("hub")).otherwise(F.lit(-1)), cut)
    return numbered(rows, [], ["hub", "v"], "i", bucket).select("v", "i")


def in_ranges(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(v, shard): rows (v, i) cut by i into ranges of these sizes."""
    shard = F.lit(len(sizes) - 1)
    for s in reversed(range(len(sizes) - 1)):
        shard = F.when(F.col("i") < sum(sizes[: s + 1]), F.lit(s)).otherwise(shard)
    return rows.select("v", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked) of each row.

    links: (a, b) of row numbers v as in rows(); None: each text is linked with the first
    document of the same text.
    """
    numbered_rows = stored(rows(docs))
    total = numbered_rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    if links is None:
        same = numbered_rows.where("same is not null")
        hub = stored(same.groupBy("same").agg(F.min("v").alias("hub"), F.count("*").alias("n")).where("n > 1"))
        links = join_heads(same, hub, ["same"]).where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b"))
    links = stored(links)
    ends = links.select(F.col("a").alias("v"), F.least("a", "b").alias("hub")).union(links.select("b", F.least("a", "b")))
    linked = stored(ends.groupBy("v").agg(F.min("hub").alias("hub")))
    n_linked = linked.count()
    start = stored(in_ranges(beside(linked, n_linked), [n_linked // shards + (s < n_linked % shards) for s in range(shards)]))
    state = propagate(links, start, quota, rounds)
    held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    free = [quota[s] - held.get(s, 0) for s in range(shards)]
    rest = in_ranges(numbered(numbered_rows.join(linked, "v", "left_anti").select("v"), [], ["v"], "i"), free)
    placed = stored(state.withColumn("linked", F.lit(True)).unionByName(rest.withColumn("linked", F.lit(False))))
    out = stored(numbered_rows.join(placed, "v"))
    return numbered(out, ["shard"], ["v"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "linked")


def rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, same, v): v numbers the rows without gaps; same identifies the text, null for a null text."""
    text = F.col("text")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text, F.length(text))).alias("same"),
    )
    return numbered(stored(out), [], ["doc_id", "same", "size"], "v")


def query(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
