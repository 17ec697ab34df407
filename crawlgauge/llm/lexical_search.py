"""Ranked lexical search: three-phase uniform threshold (TPUT) over term-partitioned postings.

A document's score for a query is the sum of what each of the query's terms contributes. A
term's posting list holds the documents of the term with their contribution; lists are
written partitioned by term, long ones in slices. For each query:

1. The head of each of its lists (the k documents of largest contribution) is fetched; what the
   lists hold of these documents gives a lower bound of the query's k-th score.
2. With m lists, a document at or above that bound contributes bound / m or more in one of
   them. Every list sends all its postings at or above this uniform threshold, the least of the
   queries that read it. Sums of what was sent raise the bound; a document whose sum, plus the
   thresholds of the lists that sent nothing of it, stays below the bound is out.
3. What the lists hold of the remaining candidates is looked up; their scores are exact, and ranked.

A posting is sent once, to its document's task, whatever the number of queries that read its
list, and there added up for all of them; a task sends on its k best of each query, or its
candidates. Results are exact: a query with fewer than k scored documents has the bound 0 and
fetches its lists whole. Heads are cut in each task before the shuffle; no list is gathered.
Queries are worked off in blocks of BLOCK_TERMS terms, which bounds what is broadcast.

Edge cases: a null text has no terms and is not counted; a document of null doc_id is ranked,
after others of its score; rows equal in doc_id and text are documents each; documents of
equal score and doc_id are ordered by their place in the input; very long texts are counted
whole; a query without terms, or whose terms stand nowhere, has no rows; each row of queries
is a query, also with a repeated item_id, and columns beside item_id and text are not read;
empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_up_to, frugal, small_batches, stored, table

TOP = 10
#: Terms of the queries worked off at once (with those of one more query), postings in one slice of a list, rows up to which a list of documents is broadcast, postings added up at once.
BLOCK_TERMS, SLICE, BROADCAST_ROWS, CHUNK = 200_000, 200_000, 1_000_000, 300_000

#: Of ASCII, letters and digits stay, A-Z folded; all other ASCII parts terms. Bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order, with repeats."""
    return (text or "").encode().translate(_FOLD).split()


def query_terms(queries: DataFrame) -> DataFrame:
    """Stored (item, item_id, term binary, block) of each query's distinct terms; item numbers the queries' rows, block says which are worked off together."""
    small_batches(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), pa.array([w for x in each for w in x], pa.binary())], ["item", "item_id", "term"])

    found = stored(queries.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(frugal(run), "item long, item_id long, term binary"))
    blocks = -(-found.count() // BLOCK_TERMS)
    return found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))))


class Queries:
    """A block of queries: its vocabulary, numbered, and each query's terms by number."""

    def __init__(self, terms: pd.DataFrame):
        self.numbers = {w: i for i, w in enumerate(sorted(set(map(bytes, terms["term"]))))}
        items = terms.groupby("item", sort=True)
        self.items = list(items.groups)
        self.item_ids = dict(zip(terms["item"].tolist(), terms["item_id"].astype(object).where(terms["item_id"].notna(), None).tolist(), strict=True))
        self.terms = [np.array([self.numbers[bytes(w)] for w in group["term"]]) for _, group in items]

    def lowest(self, bounds: dict[int, int]) -> np.ndarray:
        """Of each term the least threshold of the queries that read its list: their bound over the number of their lists, rounded up."""
        out = np.full(len(self.numbers), np.iinfo(np.int64).max)
        for i, own in enumerate(self.terms):
            out[own] = np.minimum(out[own], -(-bounds.get(i, 0) // len(own)))
        return out


def counted(docs: DataFrame, queries: Queries) -> DataFrame:
    """Stored (row, doc_id, n, terms array<int>, tfs array<int>) of documents with terms: which of the queries' terms stand there, and how often. row numbers the documents."""
    known = docs.sparkSession.sparkContext.broadcast(queries.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            rows, n, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(words)
                    held = numbers.keys() & counts.keys() if len(numbers) < len(counts) else [w for w in counts if w in numbers]
                    rows.append(i)
                    n.append(len(words))
                    terms.append([numbers[w] for w in held])
                    tfs.append([counts[w] for w in held])
            keep = pa.array(rows, pa.int32())
            columns = [batch.column("row").take(keep), batch.column("doc_id").take(keep), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(frugal(run), "row long, doc_id long, n long, terms array<int>, tfs array<int>"))


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2) / (2 * df + 1))).cast("long")


def contribution(w: Column, tf: Column, length: Column) -> Column:
    """What a term of weight w adds to a document in which it stands tf times."""
    tf = tf.cast("long")
    return w * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * length)


def posting_lists(found: DataFrame) -> DataFrame:
    """Stored (term, row, c): the lists of counted()'s terms, partitioned by term, a long list in slices; contributions of 0 are left out."""
    totals = found.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = totals["docs"], max(totals["words"] or 0, 1)
    length = F.lit(10) + F.call_function("div", F.lit(90) * F.col("n") * F.lit(n_docs), F.lit(n_words))
    each = found.select("row", length.alias("length"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "length", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    weights = stored(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("w", weight(F.lit(n_docs), F.col("df"))))
    lists = each.join(broadcast_up_to(weights, BROADCAST_ROWS), "term").select("term", "row", contribution(F.col("w"), F.col("tf"), F.col("length")).alias("c"), "df").where("c > 0")
    part = F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.ceil(F.col("df") / SLICE)))
    return stored(lists.withColumn("slice", part).repartition("term", "slice").drop("slice", "df"))


#: What a task makes of the postings of some documents: (rows, numbers of rows by posting, terms, contributions) to (query, row, value) arrays.
Adder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _summed(queries: Queries, rows: np.ndarray, at: np.ndarray, terms: np.ndarray, c: np.ndarray, more: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, sums by row, sums of ``more`` by row) of each query with postings here; sums stay below 2**53 and are exact."""
    order = np.argsort(terms, kind="stable")
    at, terms, c = at[order], terms[order], c[order]
    start, end = (np.searchsorted(terms, np.arange(len(queries.numbers)), side) for side in ("left", "right"))
    for q, own in enumerate(queries.terms):
        own = own[end[own] > start[own]]
        if len(own):
            span = np.concatenate([np.arange(start[t], end[t]) for t in own])
            where = at[span]
            yield q, np.bincount(where, c[span], len(rows)), np.bincount(where, more[terms[span]], len(rows)) if more is not None else None


def best(queries: Queries, k: int) -> Adder:
    """The k largest sums of each query, and all equal to the last."""

    def run(rows, at, terms, c):
        for q, sums, _ in _summed(queries, rows, at, terms, c):
            least = np.partition(sums, -k)[-k] if len(sums) > k else 0
            held = (sums >= least) & (sums > 0)
            yield q, rows[held], sums[held]

    return run


def candidates(queries: Queries, lowest: np.ndarray, bounds: dict[int, int]) -> Adder:
    """Documents whose sum, with what lists that sent nothing of them may still hold, reaches the query's bound."""
    unsent = (lowest - 1).clip(0).astype(np.float64)
    whole = [unsent[own].sum() for own in queries.terms]

    def run(rows, at, terms, c):
        for q, sums, seen in _summed(queries, rows, at, terms, c, unsent):
            held = (sums > 0) & (sums + whole[q] - seen >= bounds.get(q, 0))
            yield q, rows[held], sums[held]

    return run


def by_document(postings: DataFrame, adder: Adder) -> DataFrame:
    """(query, row, value) of what adder makes of each document's postings(term, row, c), sent to the document's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(held: list[np.ndarray]) -> pa.RecordBatch:
            rows, at = np.unique(held[0], return_inverse=True)
            found = list(adder(rows, at, held[1], held[2]))
            columns = [np.repeat([q for q, _, _ in found], [len(r) for _, r, _ in found]).astype(np.int32)]
            columns += [np.concatenate([np.zeros(0), *(x[i] for x in found)]).astype(np.int64) if i == 2 else np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "row", "value"])

        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("row", "term", "c"), strict=True)]
            if len(held[0]) >= CHUNK and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last document may go on
                yield added([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield added(held)

    spark = postings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNK // 4))  # narrow rows: a few MB
    return postings.select("row", "term", "c").repartition("row").sortWithinPartitions("row").mapInArrow(frugal(run), "query int, row long, value long")


def _kth(found: DataFrame, k: int) -> dict[int, int]:
    """The k-th largest value of each query that has as many documents; as many numbers as a block has queries."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value")))
    ranked = found.select("query", "value").withColumn("rank", rank).where(F.col("rank") <= k)
    return dict(map(tuple, ranked.where(F.col("rank") == k).select("query", "value").collect()))


def _of_rows(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """What the lists hold of stored rows."""
    return lists.join(broadcast_up_to(rows, BROADCAST_ROWS), "row", "left_semi")


def _search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    found = counted(docs, queries)
    lists = posting_lists(found)
    # phase 1
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("c"), "row"))
    heads = stored(lists.withColumn("place", place).where(F.col("place") <= k).select("row").distinct())
    bounds = _kth(by_document(_of_rows(lists, heads), best(queries, k)), k)
    # phase 2
    lowest = queries.lowest(bounds)
    limits = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": np.arange(len(lowest), dtype=np.int32), "lowest": lowest}), "term int, lowest long"))  # as many rows as a block has terms
    limited = lists.join(limits, "term")
    sent = stored(limited.where("c >= lowest").select("row", "term", "c"))
    raised = _kth(by_document(sent, best(queries, k)), k)
    bounds = {q: max(bounds.get(q, 0), raised.get(q, 0)) for q in bounds.keys() | raised.keys()}
    left = stored(by_document(sent, candidates(queries, lowest, bounds)).select("row").distinct())
    # phase 3
    rest = limited.where("c < lowest").select("row", "term", "c")
    exact = by_document(_of_rows(sent.unionByName(rest), left), best(queries, k))
    out = stored(stored(exact).join(found.select("row", "doc_id"), "row"))
    small_batches(spark)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value"), F.asc_nulls_last("doc_id"), "row"))
    names = F.broadcast(spark.createDataFrame([(q, queries.item_ids[item]) for q, item in enumerate(queries.items)], "query int, item_id long"))  # as many rows as a block has queries
    return out.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("value").alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of docs(doc_id, text) for each query of queries(item_id, text)."""
    terms = query_terms(queries)
    blocks = [r[0] for r in terms.select("block").distinct().orderBy("block").collect()]
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    each = [_search_block(docs, Queries(terms.where(F.col("block") == b).drop("block").toPandas()), k) for b in blocks]
    return reduce(DataFrame.unionByName, each)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY d, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, d, doc_id, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (d), totals GROUP BY item_id, d, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
