"""Line dedup by winnowing.

Documents are cut at newlines and each line is hashed. In every window of RUN lines the
least hash is a fingerprint (the first of equal ones), so two places that share RUN lines
in a row share a fingerprint at the same spot. Only these positions are kept, each with
the RUN - 1 lines before and after it. Positions whose fingerprint occurs once go. The
others are joined: positions with equal fingerprint and equal lines around it are one
entry, which stands at the earliest of them, and every later one repeats all its runs.
An entry is extended both ways to the runs of RUN lines around its fingerprint; a run that
another entry has at an earlier place is a repeat too. A line goes if it lies in a run
that also starts earlier: in a document of smaller doc_id, or earlier in the same one. Runs
are judged on the input, and are equal if the 64-bit hashes of all their lines are.

All steps are DataFrame functions. Counts and first places are aggregated before rows are
joined with them, and hot keys are joined by a broadcast (``join_heads``), so a run that a
third of all documents share does not meet in one task.

Edge cases: a null text is an empty one (one empty line) and nothing is removed from it; a
null doc_id comes after all others; documents of equal doc_id and different text are
ordered by a hash of both; rows equal in doc_id and text are one document, and each gets
its result; the lines of a very long text are taken in stretches of STRETCH windows, its
array of lines is held once; an empty table gives an empty result; other columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bytes_up_to, doc_key, join_heads, order_of_id, stored, table

#: Lines of the shortest run, and of a winnowing window; windows of a document in one row.
RUN, STRETCH = 3, 4096


def fingerprints(lines: DataFrame, run: int = RUN, stretch: int = STRETCH) -> DataFrame:
    """(k, ord, at, fp, near): the chosen positions, from 0, with the hashes of the run - 1 lines before, the line and the run - 1 lines after (null beyond the document)."""
    h = lines.select("k", "ord", F.transform("lines", lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= run)
    side = run - 1
    # a stretch: the windows that start at lines b to b + stretch - 1 (from 1), with the lines around them from line lo on
    cut = F.transform(
        F.sequence(F.lit(1), F.size("h") - side, F.lit(stretch)),
        lambda b: F.struct(b.alias("b"), F.greatest(b - side, F.lit(1)).alias("lo"), F.slice("h", F.greatest(b - side, F.lit(1)), F.least(b - 1, F.lit(side)) + stretch + 2 * side).alias("h")),
    )
    part = h.select("k", "ord", F.size("h").alias("lines"), F.explode(cut).alias("c")).select("k", "ord", "lines", "c.*")
    first, last = F.col("b") - F.col("lo"), F.least(F.col("b") + stretch - 1, F.col("lines") - side) - F.col("lo")
    least = F.transform(F.sequence(first, last), lambda s: F.array_min(F.transform(F.slice("h", s + 1, run), lambda x, i: F.struct(x.alias("fp"), (s + i).alias("i")))))
    chosen = part.select("k", "ord", "lo", "h", F.explode(F.array_distinct(least)).alias("w"))
    near = F.transform(F.sequence(F.col("w.i") - side, F.col("w.i") + side), lambda i: F.get("h", i))
    return chosen.select("k", "ord", (F.col("w.i") + F.col("lo") - 1).alias("at"), "w.fp", near.alias("near"))


def _runs(rows: DataFrame, at, run: int, *keep: str) -> DataFrame:
    """rows' runs of lines around a fingerprint at line ``at``: keep, lines (their hashes), start."""
    each = F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda o: F.struct(F.slice("near", o + 1, run).alias("lines"), (at - (run - 1) + o).alias("start")))
    whole = F.filter(each, lambda r: F.forall(r["lines"], lambda x: x.isNotNull()))
    return rows.select(*keep, F.explode(whole).alias("r")).select(*keep, "r.*")


def later_runs(prints: DataFrame, run: int = RUN) -> DataFrame:
    """(k, ord, start) of the runs that also start earlier. prints: a stored table of fingerprints()."""
    place = F.struct("ord", "k", "at")
    again = prints.groupBy("fp").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count("*").alias("n")).where("one <> other")
    met = stored(join_heads(prints, stored(again.select("fp", "n")), ["fp"], "left_semi"))
    entries = stored(met.groupBy("fp", "near").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")))
    copies = join_heads(met, entries.where("first <> last").select("fp", "near", "first", "n"), ["fp", "near"]).where(place > F.col("first"))
    runs = stored(_runs(entries, F.col("first.at"), run, "first").select("lines", F.struct("first.ord", "first.k", "start").alias("place")))
    earliest = runs.groupBy("lines").agg(F.min("place").alias("earliest"), F.max("place").alias("latest"), F.count("*").alias("n")).where("earliest <> latest")
    moved = join_heads(runs, stored(earliest.select("lines", "earliest", "n")), ["lines"]).where(F.col("place") > F.col("earliest"))
    return moved.select("place.k", "place.ord", "place.start").unionByName(_runs(copies, F.col("at"), run, "k", "ord").select("k", "ord", "start"))


def removed_lines(docs: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """(k, ord, at): by document the numbers, from 0, of the lines that go; only documents that lose lines."""
    lines = docs.select(doc_key().alias("k"), order_of_id().alias("ord"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines")).where(F.size("lines") >= run)
    later = later_runs(stored(fingerprints(lines, run)), run)
    return later.select("k", "ord", F.explode(F.sequence(F.col("start"), F.col("start") + (run - 1))).alias("line")).groupBy("k", "ord").agg(F.collect_set("line").alias("at"))


def dedup_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """row (docs' columns), text (without the removed lines), n_lines, n_removed."""
    gone = stored(removed_lines(docs.select("doc_id", "text"), run=run))
    gone = broadcast_bytes_up_to(gone, gone.agg(F.sum(F.size("at") * 8 + 64)).first()[0] or 0)
    rows = docs.select(F.struct("*").alias("row"), doc_key().alias("k"), order_of_id().alias("ord")).join(gone, ["k", "ord"], "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "at"), lambda i: F.get("lines", i))
    return rows.withColumn("lines", F.when(F.col("at").isNotNull(), lines)).select(
        "row",
        F.when(F.col("at").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        (F.length(F.coalesce("row.text", F.lit(""))) - F.length(F.replace(F.coalesce("row.text", F.lit("")), F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
runs AS (
  SELECT *, lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3 FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT *, line3 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) > 1 AS r FROM runs),
gone AS (
  SELECT *, r OR coalesce(lag(r) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS g FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT g), '')) AS kept_sha256
FROM gone GROUP BY doc_id
"""
