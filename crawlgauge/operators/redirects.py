"""Redirect chains, followed over a fetch log, and canonical hosts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from . import nodes as N

TEMPORARY = (302, 307)
REDIRECTS = (301, 302, 303, 307, 308)
#: Redirects that are followed.
MOST_HOPS = 10


def trace(fetches: DataFrame) -> DataFrame:
    """fetches(url, final_url, status, redirects array<struct<url,status,location>>) with hop_count, has_loop, https_upgrade and findings."""
    keys = F.transform(F.concat(F.transform("redirects", lambda h: h["url"]), F.array("final_url")), lambda u: urls.normalised(u))
    hops, ends = F.size("redirects"), urls.scheme(F.col("final_url")) == "https"
    out = fetches.withColumns({
        "hop_count": hops, "has_loop": F.size(F.array_distinct(keys)) < F.size(keys), "ends_https": ends, "https_upgrade": (urls.scheme(F.col("url")) == "http") & ends,
        "has_temporary_redirect": F.exists("redirects", lambda h: h["status"].isin(*TEMPORARY)),
    })
    found = N.findings(
        N.finding("hops_few", "pass", hops <= 1), N.finding("hops_some", "warn", hops.between(2, 3)), N.finding("hops_many", "fail", hops > 3), N.finding("loop", "fail", F.col("has_loop")),
        N.finding("https_upgrade", "pass", F.col("https_upgrade")), N.finding("not_https", "fail", ~F.col("https_upgrade") & ~ends),
        N.finding("temporary", "warn", F.col("has_temporary_redirect")), N.finding("final_status_bad", "fail", F.col("status") >= 400),
    )
    return out.withColumn("redirect_findings", found)


def resolved(log: DataFrame) -> DataFrame:
    """log(url, status, location, ...) with ``key``, the URL as a browser writes it, and ``target``, the location made absolute; null where there is none or it cannot be.

    A stage of its own, so that what follows can join by it.
    """

    def run(batches):
        for batch in batches:
            asked = batch.column("url").to_pylist()
            key = [urls.resolve_one(u, "") or u for u in asked]
            target = [urls.resolve_one(u, x) for u, x in zip(asked, batch.column("location").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.string()), pa.array(target, pa.string())], [*batch.schema.names, "key", "target"])

    return log.mapInArrow(run, T.StructType([*log.schema.fields, T.StructField("key", T.StringType()), T.StructField("target", T.StringType())]))


def follow(log: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(url, final_url, hop_count, outcome, has_temporary_redirect, path) of each URL of a fetch log(url, status, location).

    outcome: final, loop (the chain comes back to a URL that it left), too_many (more than
    ``most`` redirects), or unknown (it leads to a URL that the log lacks). Chains double
    each round: every URL knows its next 1, 2, 4, ... hops, and what it does not yet know it
    takes from the URL where it stands; so rounds grow with the logarithm of ``most``, and a
    chain that has ended takes no part any more. path holds at most twice ``most`` URLs. Of
    several rows of a URL the one of the greatest status, then location, counts.
    """
    known = resolved(log.select("url", "status", "location")).select(urls.visit_key(F.col("key")).alias("key"), F.struct("status", urls.visit_key(F.col("target")).alias("target")).alias("s"))
    known = known.groupBy("key").agg(F.max("s").alias("s")).select("key", "s.status", "s.target")
    moves = F.col("status").isin(*REDIRECTS) & F.col("target").isNotNull()
    step = F.struct(F.col("target").alias("url"), F.col("status").isin(*TEMPORARY).alias("temporary"))
    jumps = known.select("key", F.when(moves, F.array(step)).otherwise(F.array().cast("array<struct<url:string,temporary:boolean>>")).alias("hops"))
    reach = 1
    chains = jumps.withColumn("open", F.size("hops") > 0)
    while reach <= most:
        at = F.element_at("hops", -1)["url"]
        further = chains.select(F.col("key").alias("at"), F.col("hops").alias("more"), F.col("open").alias("more_open"))
        going = chains.where("open").withColumn("at", at).join(further, "at", "left")
        # a chain is settled when it stands at a URL that leads nowhere; where it comes back to a URL it has left it goes on to the end of the rounds
        going = going.select("key", F.concat("hops", F.coalesce("more", F.array().cast("array<struct<url:string,temporary:boolean>>"))).alias("hops"), F.coalesce("more_open", F.lit(False)).alias("open"))
        chains = chains.where("not open").unionByName(going)
        reach *= 2
    path = F.concat(F.array("key"), F.transform("hops", lambda h: h["url"]))
    back = F.filter(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.array_contains(F.slice("path", F.lit(1), i), F.get("path", i)))
    first_back = F.when(F.size("path") > 1, F.array_min(back))
    out = chains.withColumn("path", path).withColumn("back", first_back)
    looped = F.col("back").isNotNull() & (F.col("back") <= most)
    hops = F.least(F.when(looped, F.col("back")).otherwise(F.size("path") - 1), F.lit(most))
    out = out.select("key", F.slice("hops", F.lit(1), hops).alias("hops"), F.slice("path", F.lit(1), hops + 1).alias("path"), (F.size("path") - 1).alias("all"), hops.alias("hop_count"), looped.alias("looped"))
    ends = out.withColumn("final_url", F.element_at("path", -1)).join(known.select(F.col("key").alias("final_url"), F.lit(True).alias("there")), "final_url", "left")
    outcome = F.when(F.col("looped"), "loop").when(F.col("all") > most, "too_many").when(F.col("there"), "final").otherwise("unknown")
    return ends.select(F.col("key").alias("url"), "final_url", F.col("hop_count").cast("int").alias("hop_count"), outcome.alias("outcome"), F.exists("hops", lambda h: h["temporary"]).alias("has_temporary_redirect"), "path")


def host_variants(domains: DataFrame) -> DataFrame:
    """(domain, variant) of the four ways to ask for a domain's root."""
    base = urls.apex(F.col("domain"))
    forms = F.array(*[F.concat(F.lit(p), base, F.lit("/")) for p in ("http://", "https://", "http://www.", "https://www.")])
    return domains.select("domain", F.explode(forms).alias("variant"))


def canonical_host(domains: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row a domain: where its variants end, whether they agree and end on https; host_score."""
    seen = host_variants(domains).join(fetches.select(F.col("url").alias("variant"), "final_url", "status", "redirects"), "variant", "left")
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    http = F.col("variant").startswith("http://")
    by = seen.groupBy("domain").agg(
        F.array_sort(F.collect_set(F.when(ok, urls.normalised(F.col("final_url"))))).alias("distinct_endpoints"), F.count_if(ok).alias("reachable"),
        F.coalesce(F.bool_and(F.when(ok & http, urls.scheme(F.col("final_url")) == "https")), F.lit(False)).alias("forces_https"),
        F.coalesce(F.max(F.when(ok, F.size("redirects"))), F.lit(0)).alias("most_hops"), F.count_if(~ok).alias("unreachable"),
        F.coalesce(F.bool_or(F.exists("redirects", lambda h: h["status"].isin(*TEMPORARY))), F.lit(False)).alias("has_temporary_redirect"),
    )
    out = by.withColumn("converges", F.size("distinct_endpoints") == 1)
    short = (F.col("most_hops") <= 2) & (F.col("reachable") > 0)
    score = F.when(F.col("converges"), 60).otherwise(0) + F.when(F.col("forces_https"), 30).otherwise(0) + F.when(short, 10).otherwise(0)
    found = N.findings(
        N.finding("none_reachable", "fail", F.col("reachable") == 0), N.finding("converges", "pass", F.col("converges")), N.finding("diverges", "fail", ~F.col("converges") & (F.col("reachable") > 0)),
        N.finding("https_forced", "pass", F.col("forces_https")), N.finding("http_served", "fail", ~F.col("forces_https")), N.finding("hops_many", "warn", F.col("most_hops") > 2),
        N.finding("temporary", "warn", F.col("has_temporary_redirect")), N.finding("variants_unreachable", "info", F.col("unreachable") > 0),
    )
    return out.withColumns({"host_score": text.clamp(score), "host_grade": text.grade(score), "host_findings": found})
