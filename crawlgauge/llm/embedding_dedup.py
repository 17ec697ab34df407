"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared within their label. Equal vectors are one point. A label of at most
NODE_MOST points is compared whole. Of a larger one every tree splits the points again and again at a random quantile of their projections on a random
direction; points near the split go to both sides (spill). Nodes with more than NODE_MOST
points are split by Spark, a level at a time, with quantiles aggregated over the node;
smaller nodes are split on in one task down to leaves of LEAF_MOST points. A label has as
many trees as its points ask for: pairs just at the threshold are made for a sample of
them, the trees' splits are followed, and the share of pairs that a tree keeps together
gives the number that keeps a share of RECALL, so large and narrow labels get more. In a leaf all
points are compared; each point sends a link to the least point of its group there. The
links of all trees are united to components, and the links of a component's points are
then counted exactly in blocks: a group of g close points costs g links, and g / BLOCK + 1
copies of each of its vectors for the count, which compares all its pairs.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite components
links with nothing, as does a null label or vectors of other length; rows of equal vec_id
are points of their own that share the id; exactly parallel vectors that differ are points
of their own too; columns other than vec_id, embedding and label are left out, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stored, table
from .components import components

COSINE = 0.93
TREES, NODE_MOST, LEAF_MOST, SPILL, SEED = 10, 20_000, 2048, 0.05, 7
#: Share of pairs that a label's trees should bring together; points and trees that are followed to learn how many that takes.
RECALL, SAMPLE, FOLLOWED = 0.99, 4000, 16
#: Points of a component compared at once when links are counted.
BLOCK, BROADCAST_POINTS = 4096, 500_000


def unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def direction(tree: int, depth: int, width: int) -> np.ndarray:
    return np.random.default_rng((SEED, tree, depth)).standard_normal(width)


def quantile(tree: int, depth: int) -> float:
    return float(np.random.default_rng((SEED, 1, tree, depth)).uniform(0.4, 0.6))


def _v() -> Column:
    return F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0


def point() -> Column:
    """A hash of label and vector; null for a row that links with nothing."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    return F.when(usable, F.xxhash64(F.col("label").cast("string"), _v()))


def points_of(vectors: DataFrame) -> DataFrame:
    """(point, label, v, copies): the distinct usable vectors."""
    keyed = vectors.select(point().alias("point"), F.col("label").cast("string").alias("label"), _v().alias("v")).where("point is not null")
    return keyed.groupBy("point").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"))


def _split(x: np.ndarray, tree: int, depth: int, members: np.ndarray, leaf_most: int) -> Iterator[np.ndarray]:
    if len(members) <= leaf_most:
        yield members
        return
    p = x[members] @ direction(tree, depth, x.shape[1])
    q = quantile(tree, depth)
    low, high = np.quantile(p, [q - SPILL, q + SPILL])
    left, right = members[p <= high], members[p >= low]
    if max(len(left), len(right)) == len(members):  # close to a single spot: projections are ties
        order = np.argsort(p, kind="stable")
        left, right = members[order[: len(order) // 2 + 1]], members[order[len(order) // 2 :]]
    yield from _split(x, tree, depth + 1, left, leaf_most)
    yield from _split(x, tree, depth + 1, right, leaf_most)


def _leaf_links(x: np.ndarray, leaf: np.ndarray, points: np.ndarray, cosine: float, block: int = 256) -> list[np.ndarray]:
    """(point, least point of its group) for the groups of linked points in a leaf."""
    v, root = x[leaf], np.arange(len(leaf))
    for start in range(0, len(leaf), block):
        near = (v[start : start + block] @ v[start:].T) >= cosine
        while True:  # pairs of different groups; of each group the least one it meets
            a, b = (root[start + i] for i in np.nonzero(near & (root[start : start + block, None] != root[None, start:])))
            if not len(a):
                break
            to = np.arange(len(leaf))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while (to[to] != to).any():
                to = to[to]
            root = to[root]
    moved = root != np.arange(len(leaf))
    return [np.column_stack((points[leaf[moved]], points[leaf[root[moved]]]))] if moved.any() else []


def trees_needed(x: np.ndarray, n: int, cosine: float, leaf_most: int, least: int) -> int:
    """Trees that bring RECALL of the pairs at the threshold together in a space of n points. x: unit vectors of a sample."""
    u = np.random.default_rng(SEED).standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(u, axis=1, keepdims=True)
    y = np.where(length > 1e-9, cosine * x + np.sqrt(1 - cosine**2) * u / np.maximum(length, 1e-9), x)
    entered = survived = 0
    ends: list[tuple[int, np.ndarray, float]] = []  # tree, pairs together, levels that the sample is too small to follow
    for tree in range(FOLLOWED):
        todo = [(np.arange(len(x)), np.arange(len(x)), 0)]
        while todo:
            members, pairs, depth = todo.pop()
            size = n * len(members) / len(x)
            if size <= leaf_most or len(members) < 32:
                ends.append((tree, pairs, max(0.0, np.log(size / leaf_most) / -np.log(0.5 + SPILL))))
                continue
            along, q = direction(tree, depth, x.shape[1]), quantile(tree, depth)
            p, px, py = x[members] @ along, x[pairs] @ along, y[pairs] @ along
            low, high = np.quantile(p, [q - SPILL, q + SPILL])
            if low >= high:
                ends.append((tree, pairs, 0.0))  # ties
                continue
            left, right = (px <= high) & (py <= high), (px >= low) & (py >= low)
            entered, survived = entered + len(pairs), survived + int((left | right).sum())
            todo += [(members[p <= high], pairs[left], depth + 1), (members[p >= low], pairs[right], depth + 1)]
    level = survived / max(1, entered)
    together = np.zeros((FOLLOWED, len(x)))
    for tree, pairs, levels in ends:
        together[tree, pairs] = np.maximum(together[tree, pairs], level**levels)
    share = max(together.mean(), min(1.0, leaf_most / n))  # points dealt blindly meet that often
    return least if share >= RECALL else max(least, int(np.ceil(np.log(1 - RECALL) / np.log(1 - share))))


def _projection(depth: int):
    @F.pandas_udf("double")
    def projected(v: pd.Series, tree: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], np.ndarray] = {}

        def along(x: np.ndarray, t: int) -> float:
            if (t, len(x)) not in known:
                known[t, len(x)] = direction(t, depth, len(x))
            return float(x @ known[t, len(x)] / np.linalg.norm(x))

        return pd.Series([along(x, t) for x, t in zip(v, tree, strict=True)], dtype="float64")

    return projected


def forest_links(points: DataFrame, cosine: float = COSINE, trees: int = TREES, node_most: int = NODE_MOST, leaf_most: int = LEAF_MOST) -> DataFrame:
    """(a, b) links between points that share a leaf and are close; enough of them to connect each leaf's groups."""
    spark = points.sparkSession
    spaced = points.select("point", F.concat_ws("/", "label", F.size("v").cast("string")).alias("space"), "v")
    spaces = stored(spaced.groupBy("space").agg(F.count("*").alias("points")))
    large = spaces.where(F.col("points") > node_most)
    sample = spaced.join(large, "space").where(F.pmod(F.xxhash64("point", F.lit(SEED)), F.ceil(F.col("points") / SAMPLE)) == 0)

    def count_trees(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point", ignore_index=True)
        return pd.DataFrame({"space": group["space"][:1], "trees": trees_needed(unit(group["v"]), int(group["points"].iloc[0]), cosine, leaf_most, trees)})

    wanted = stored(sample.groupBy("space").applyInPandas(count_trees, "space string, trees int"))
    rows = spaced.join(broadcast_up_to(wanted, BROADCAST_POINTS), "space", "left")
    last = F.when(F.col("trees").isNull(), 0).otherwise(F.col("trees") - 1)  # a small space is compared whole, once
    nodes = stored(rows.withColumn("tree", F.explode(F.sequence(F.lit(0), last))).select("point", "space", "v", "tree", F.lit("r").alias("node")))
    most_trees = wanted.agg(F.max("trees")).first()[0] or 1
    done: list[DataFrame] = []
    for depth in range(64):
        sizes = stored(nodes.groupBy("space", "tree", "node").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > node_most).select("space", "tree", "node")
        if not large.limit(1).count():
            break
        # only points of large nodes are projected and split; their quantiles are aggregated
        done.append(nodes.join(large, ["space", "tree", "node"], "left_anti"))

        split = stored(nodes.join(large, ["space", "tree", "node"], "left_semi").withColumn("p", _projection(depth)("v", "tree")))
        shares = F.create_map(*[F.lit(x) for t in range(most_trees) for x in (t, quantile(t, depth))])
        grid = [round(0.3 + 0.025 * i, 3) for i in range(17)]
        cuts = split.groupBy("space", "tree", "node").agg(F.percentile_approx("p", grid, 2000).alias("q"))
        at = lambda s: F.element_at("q", (F.round((F.element_at(shares, F.col("tree")) + s - 0.3) / 0.025) + 1).cast("int"))  # noqa: B023, E731
        cuts = stored(cuts.select("space", "tree", "node", at(-SPILL).alias("low"), at(SPILL).alias("high")))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("high"), F.lit("0")), F.when(F.col("p") >= F.col("low"), F.lit("1"))))
        # ties of a node whose projections hardly differ are dealt by hash, otherwise in each tree, so that it still shrinks
        stuck = F.col("low") >= F.col("high")
        sides = F.when(stuck, F.array(F.pmod(F.xxhash64("point", "tree", F.lit(depth)), F.lit(2)).cast("string"))).otherwise(sides)
        nodes = stored(split.join(cuts, ["space", "tree", "node"]).withColumn("side", F.explode(sides)).select("point", "space", "v", "tree", F.concat("node", "side").alias("node")))
    for part in done:
        nodes = nodes.unionByName(part.select(*nodes.columns))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point", ignore_index=True)
        x, points = unit(group["v"]), group["point"].to_numpy()
        tree, depth = int(group["tree"].iloc[0]), len(group["node"].iloc[0]) - 1
        out = [p for leaf in _split(x, tree, depth, np.arange(len(x)), leaf_most if depth else node_most) for p in _leaf_links(x, np.sort(leaf), points, cosine)]
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return nodes.groupBy("space", "tree", "node").applyInPandas(link, "a long, b long").distinct()


def count_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(point, linked): copies of other points of its component that are linked with it. members: (point, component, v, copies)."""
    sizes = stored(members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    rows = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "point", "v", "copies"
    )

    def count(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point", ignore_index=True)
        x, copies = unit(group["v"]), group["copies"].to_numpy()
        mine, across = group["mine"].to_numpy(), group["i"].iloc[0] != group["j"].iloc[0]  # of two blocks only pairs across them
        linked = np.zeros(len(x), dtype=np.int64)
        for start in range(0, len(x), 256):
            near = (x[start : start + 256] @ x.T) >= cosine
            rows = np.arange(len(near))
            near[rows, start + rows] = False
            if across:
                near &= mine[start : start + 256, None] != mine[None, :]
            linked[start : start + 256] = near @ copies
        return pd.DataFrame({"point": group["point"], "linked": linked})

    return dealt.groupBy("component", "i", "j").applyInPandas(count, "point long, linked long").groupBy("point").agg(F.sum("linked").alias("linked"))


def link_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, node_most: int = NODE_MOST, leaf_most: int = LEAF_MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    points = stored(points_of(vectors))
    links = stored(forest_links(points, cosine, trees, node_most, leaf_most))
    comps = stored(components(links))
    members = comps.join(points, comps["id"] == points["point"]).select("point", "component", "v", "copies")
    found = comps.withColumnRenamed("id", "point").join(stored(count_links(members, cosine)), "point")
    found = broadcast_up_to(stored(found), BROADCAST_POINTS)
    copies = points.select("point", "copies")
    rows = vectors.select("vec_id", point().alias("p"))
    rows = rows.join(broadcast_up_to(stored(copies.where("copies > 1")), BROADCAST_POINTS).withColumnRenamed("point", "cp"), F.col("p") == F.col("cp"), "left")
    rows = rows.join(found, F.col("p") == F.col("point"), "left").select(
        "vec_id",
        F.when(F.col("p").isNotNull(), F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "p").alias("component"),
    )
    rows = stored(rows)
    least = stored(rows.where("n_links > 0").groupBy("component").agg(F.min("vec_id").alias("least")))
    out = rows.join(broadcast_up_to(least, BROADCAST_POINTS), "component", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
