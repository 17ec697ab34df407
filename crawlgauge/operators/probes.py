"""Probes of links and images: which URLs a snapshot should fetch, and what a fetch log says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Answers of servers that refuse HEAD: the request is repeated as GET.
HEAD_REFUSED = (405, 501)


def plan(wanted: DataFrame, most: int) -> DataFrame:
    """(key, host, pages, turn) of the URLs to probe: each once, however many pages want it, and ``most`` of a host, those wanted by most pages first.

    wanted(page_id, href). URLs are counted before hosts are, so a host that every page links to is cut in each task.
    """
    one = wanted.select(urls.visit_key(F.col("href")).alias("key"), "page_id").groupBy("key").agg(F.countDistinct("page_id").alias("pages"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "key"))
    return one.withColumn("host", urls.host(F.col("key"))).withColumn("turn", turn).where(F.col("turn") <= most).select("key", "host", "pages", "turn")


def outcomes(fetches: DataFrame) -> DataFrame:
    """(key, status) of each visit key of fetches(url, status): its latest fetch by fetched_at where that column is there; null status: no answer came.

    An answer by which a server refuses HEAD counts only where no other came; of answers of the same time that to HEAD counts (column method).
    """
    at = F.col("fetched_at") if "fetched_at" in fetches.columns else F.lit(0)
    head = F.coalesce(F.col("method") == "HEAD", F.lit(False)) if "method" in fetches.columns else F.lit(False)
    answered = ~(head & F.coalesce(F.col("status").isin(*HEAD_REFUSED), F.lit(False)))
    order = F.struct(answered.alias("answered"), at.alias("at"), head.alias("head"), F.col("status").alias("status"))
    return fetches.groupBy(urls.visit_key(F.col("url")).alias("key")).agg(F.max(order).alias("best")).select("key", F.col("best.status").alias("status"))


def pending(planned: DataFrame, fetches: DataFrame) -> DataFrame:
    """(key, method) of planned URLs that the log does not settle: never fetched, or only refused as HEAD."""
    known = outcomes(fetches).select("key", "status", F.lit(True).alias("fetched"))
    left = planned.join(known, "key", "left")
    refused = F.col("status").isin(*HEAD_REFUSED)
    return left.where(F.col("fetched").isNull() | refused).select("key", F.when(refused, "GET").otherwise("HEAD").alias("method"))
