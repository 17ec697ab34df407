"""Quality rules judged with the record of their host.

Each document is measured against a few rules. Failures are summed by host, each host's
failure rate of a rule is shrunk towards the corpus by a beta prior fitted to all hosts
(method of moments), and a host whose shrunk rate exceeds ``host_limit`` is flagged for
that rule. A document goes if it fails a base rule, or fails a rule that its host is
flagged for. A document that fails no rule always stays.

Edge cases: a null or blank text has no words and fails the base rules; a null host
counts as one host of its own; very long texts are measured whole; a host whose rate equals
the limit is not flagged; repeated rows are counted and judged each; an empty table
gives an empty result; other columns of the input are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, frugal, small_batches, stored

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rules beyond the base ones: name and condition of failure, in whole numbers so that every engine agrees.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 30 * n_words",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: A host is flagged for a rule beyond this shrunk rate of failing documents.
HOST_LIMIT = 0.25
#: Strength of the prior, in documents, where hosts differ no more than chance.
MAX_STRENGTH = 1e6
#: Hosts whose verdicts are broadcast; above it the join shuffles by host.
BROADCAST_HOSTS = 200_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows whose content occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    codes, known = pd.factorize(np.array(words, dtype=object))
    if len(known) < 1 << 20:
        window = (codes[:-2] * len(known) + codes[1:-1]) * len(known) + codes[2:]
    else:
        pair = pd.factorize(codes[:-1] * len(known) + codes[1:])[0]
        window = pair[:-1] * len(known) + codes[2:]
    _, at, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The STATS of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # splits at exactly the six ASCII white-space bytes
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dups += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, dups, repeated_words(words)


def _measure_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")], dtype="int64")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (all of docs' columns), the STATS, base_failed and fails (the names of the failed rules)."""
    small_batches(docs.sparkSession)
    stats = F.pandas_udf(frugal(_measure_all), STATS)
    measured = docs.select(F.struct("*").alias("row")).withColumn("s", stats(F.col(f"row.{text}"))).select("row", "s.*")
    fails = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]))
    return measured.withColumns({"base_failed": F.expr(BASE), "fails": fails})


def host_rates(stats: DataFrame, host: Column) -> DataFrame:
    """(host, rule, n, failed, rate): each host's rate of failing a rule, shrunk by the prior of all hosts.

    Two small aggregates: partial sums by host leave each task, then one row per rule of moments.
    """
    counts = [F.sum(F.array_contains("fails", name).cast("long")).alias(name) for name in RULES]
    by_host = stats.groupBy(host.alias("host")).agg(F.count("*").alias("n"), *counts)
    long = by_host.select("host", "n", F.explode(F.create_map(*[x for name in RULES for x in (F.lit(name), F.col(name))])).alias("rule", "failed"))
    long = stored(long)
    moments = long.groupBy("rule").agg(
        F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.count("*").alias("hosts"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    )
    mean = F.col("all_failed") / F.col("all_n")
    noise = mean * (1 - mean)
    between = F.col("squares") / F.col("all_n") - mean * mean - noise * F.col("hosts") / F.col("all_n")
    strength = F.when(between > noise / (MAX_STRENGTH + 1), noise / between - 1).otherwise(F.lit(MAX_STRENGTH))
    prior = moments.select("rule", mean.alias("mean"), F.greatest(strength, F.lit(0.0)).alias("strength"))
    return long.join(F.broadcast(prior), "rule").select(  # one row per rule
        "host", "rule", "n", "failed", ((F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate")
    )


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """row (docs' columns), the STATS, base_failed, fails, host_flags (rules its host is flagged for), kept."""
    stats = with_stats(docs)
    of = F.coalesce(F.col(f"row.{host}").cast("string"), F.lit(""))
    flagged = host_rates(stats, of).where(F.col("rate") > host_limit).groupBy("host").agg(F.sort_array(F.collect_set("rule")).alias("host_flags"))
    flagged = broadcast_up_to(stored(flagged), BROADCAST_HOSTS)
    judged = stats.withColumn("host", of).join(flagged, "host", "left")
    return judged.select(
        "row", *[c.split()[0] for c in STATS.split(", ")], "base_failed", "fails",
        F.coalesce("host_flags", F.array().cast("array<string>")).alias("host_flags"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.arrays_overlap("fails", "host_flags"))


def filter_documents(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """docs without the documents that the rules reject; same columns."""
    return judge(docs, host, host_limit).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT k, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs),
spans AS (
  SELECT k, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) > 1 AND w3 IS NOT NULL AS r FROM spans),
covered AS (
  SELECT k, r OR coalesce(lag(r) OVER o, false) OR coalesce(lag(r, 2) OVER o, false) AS c FROM again WINDOW o AS (PARTITION BY k ORDER BY i)),
repeats AS (SELECT k, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
stats AS (
  SELECT k, doc_id, host, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (k) LEFT JOIN dups USING (k)),
failing AS (
""" + " UNION ALL ".join(f"SELECT k, host, '{name}' AS rule, CAST(({rule}) AS BIGINT) AS f FROM stats" for name, rule in RULES.items()) + rf"""),
hosts AS (SELECT host, rule, count(*) AS n, sum(f) AS failed FROM failing GROUP BY ALL),
moments AS (
  SELECT rule, sum(n) AS all_n, sum(failed) / sum(n) AS mean, count(*) AS hosts, sum(failed * failed / n) AS squares FROM hosts GROUP BY rule),
spread AS (
  SELECT rule, mean, mean * (1 - mean) AS noise, squares / all_n - mean * mean - mean * (1 - mean) * hosts / all_n AS between_hosts FROM moments),
prior AS (
  SELECT rule, mean, greatest(CASE WHEN between_hosts > noise / {MAX_STRENGTH + 1} THEN noise / between_hosts - 1 ELSE {MAX_STRENGTH} END, 0) AS strength FROM spread),
flagged AS (
  SELECT host, rule FROM hosts JOIN prior USING (rule) WHERE (failed + mean * strength) / (n + strength) > {HOST_LIMIT}),
bad AS (SELECT DISTINCT k FROM failing SEMI JOIN flagged USING (host, rule) WHERE f = 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.k IS NULL AS kept
FROM stats LEFT JOIN bad USING (k)
"""
