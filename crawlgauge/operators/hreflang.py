"""hreflang alternates: codes, duplicates, self reference, and reciprocity as a join of pages with pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import nodes as N

CHECKED = 10


def alternates(pages: DataFrame) -> DataFrame:
    """(page_id, final_url, pos, hreflang, href, valid_code, is_self) of each alternate link."""
    value = lambda n, k: text.trimmed(F.coalesce(N.attr(n, k), F.lit("")))
    entries = N.where(lambda n: (n["tag"] == "link") & (N.lower_attr(n, "rel") == "alternate") & (value(n, "hreflang") != "") & (value(n, "href") != ""))
    each = pages.select("page_id", "final_url", F.posexplode(entries).alias("pos", "n"))
    href = F.coalesce("n.url", value(F.col("n"), "href"))
    code = value(F.col("n"), "hreflang")
    return each.select(
        "page_id", "final_url", "pos", code.alias("hreflang"), href.alias("href"), urls.valid_hreflang(code).alias("valid_code"),
        F.coalesce(urls.normalised(href) == urls.normalised(F.col("final_url")), F.lit(False)).alias("is_self"),
    )


def duplicate_codes(alts: DataFrame) -> DataFrame:
    """(page_id, code, n) of codes declared more than once, without regard to case."""
    return alts.groupBy("page_id", F.lower("hreflang").alias("code")).agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1").drop("pos")


def reciprocity(alts: DataFrame, pages: DataFrame) -> DataFrame:
    """alts with ``reciprocates``: whether the alternate page names this one; null where that page is not in the snapshot or not checked."""
    from pyspark.sql import Window

    order = Window.partitionBy("page_id").orderBy("pos")
    wanted = ~F.col("is_self") & (F.lower("hreflang") != "x-default")
    ranked = alts.withColumns({"source": urls.normalised(F.col("final_url")), "target": urls.normalised(F.col("href")), "turn": F.when(wanted, F.sum(wanted.cast("int")).over(order))})
    back = ranked.select(F.col("source").alias("b_source"), F.col("target").alias("b_target"), F.lit(True).alias("named")).distinct()
    known = pages.select(urls.normalised(F.col("final_url")).alias("known_url")).distinct()
    out = ranked.join(known, F.col("target") == F.col("known_url"), "left").join(back, (F.col("b_source") == F.col("target")) & (F.col("b_target") == F.col("source")), "left")
    checked = (F.col("turn") <= CHECKED) & F.col("known_url").isNotNull()
    return out.withColumn("reciprocates", F.when(checked, F.coalesce("named", F.lit(False)))).drop("source", "target", "turn", "b_source", "b_target", "named", "known_url")


def page_report(pages: DataFrame, alts: DataFrame) -> DataFrame:
    """(page_id, alternates, has_x_default, self_referencing, duplicate_codes, invalid_codes, not_reciprocal, hreflang_findings) of each page.

    alts: alternates(), or reciprocity() of them, whose verdicts then count.
    """
    checked = "reciprocates" in alts.columns
    back = F.col("reciprocates") if checked else F.lit(None).cast("boolean")
    asked = (~F.col("is_self") & (F.lower("hreflang") != "x-default")) if checked else F.lit(False)
    in_order = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "hreflang")))), lambda x: x["hreflang"])
    of_page = alts.groupBy("page_id").agg(
        F.count("*").alias("alternates"), F.bool_or(F.lower("hreflang") == "x-default").alias("has_x_default"), F.bool_or("is_self").alias("self_referencing"),
        in_order(~F.col("valid_code")).alias("invalid_codes"), in_order(back == F.lit(False)).alias("not_reciprocal"), F.count_if(asked).alias("asked"),
    )
    codes = alts.groupBy("page_id", F.lower("hreflang").alias("code")).agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1")
    twice = codes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("d"))
    out = pages.select("page_id").join(of_page, "page_id", "left").join(twice, "page_id", "left").withColumn("d", F.transform("d", lambda x: x["code"]))
    none = F.array().cast("array<string>")
    out = out.fillna(0, ["alternates", "asked"]).fillna(False, ["has_x_default", "self_referencing"])
    out = out.withColumns({"duplicate_codes": F.coalesce("d", none), "invalid_codes": F.coalesce("invalid_codes", none), "not_reciprocal": F.coalesce("not_reciprocal", none)})
    some = F.col("alternates") > 0
    found = N.findings(
        N.finding("hreflang_none", "info", ~some), N.finding("hreflang_found", "pass", some), N.finding("self_reference_missing", "fail", some & ~F.col("self_referencing")),
        N.finding("self_reference", "pass", F.col("self_referencing")), N.finding("x_default_missing", "warn", some & ~F.col("has_x_default")), N.finding("x_default", "pass", F.col("has_x_default")),
        N.finding("duplicate_codes", "fail", F.size("duplicate_codes") > 0), N.finding("invalid_codes", "fail", F.size("invalid_codes") > 0),
        N.finding("not_reciprocal", "fail", F.size("not_reciprocal") > 0), N.finding("reciprocal", "pass", (F.col("asked") > 0) & (F.size("not_reciprocal") == 0)),
    )
    return out.withColumn("hreflang_findings", found).drop("d", "asked")
