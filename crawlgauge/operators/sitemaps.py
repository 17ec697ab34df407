"""Sitemaps: discovery, gzip, XML entries, index children, and one aggregate report a sitemap."""

from __future__ import annotations

import contextlib
import re
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text, urls
from . import nodes as N
from . import probes

SAMPLE, CHILDREN = 20, 3


def gunzip_one(raw: bytes | None, limit: int = fixed.SITEMAP_READ) -> tuple[bytes | None, bool]:
    """(bytes, whether more than limit came out); bytes that are no gzip pass as they are."""
    if raw is None or raw[:2] != b"\x1f\x8b":
        return raw, False
    try:
        inflate = zlib.decompressobj(31)
        out = inflate.decompress(raw, limit + 1)
    except zlib.error:
        return b"", False
    return (b"", True) if len(out) > limit else (out, False)


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("too_large", T.BooleanType())]))
def gunzipped(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gunzip_one(r) for r in raw], columns=["data", "too_large"])


def discovered(origins: DataFrame, robots_sitemaps: DataFrame, fetches: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(origin, sitemap_url, via): an explicit one (origin, sitemap_url), else the first that robots.txt names, if that is a URL, else the first usual place that answers.

    fetches(url, status, ...), see probes.outcomes: a place answers by HEAD or, where HEAD is refused, by GET.
    """
    named = robots_sitemaps.groupBy("origin").agg(F.min_by("url", "pos").alias("sitemap_url")).where(F.col("sitemap_url").rlike("(?i)^https?://[^/]+")).select("origin", "sitemap_url", F.lit("robots.txt").alias("via"), F.lit(0).alias("turn"))
    places = F.array(*[F.struct(F.lit(i + 1_000_000).alias("turn"), F.lit(p).alias("place")) for i, p in enumerate(fixed.SITEMAP_PATHS)])
    usual = origins.select("origin", F.explode(places).alias("p")).select("origin", F.concat("origin", "p.place").alias("sitemap_url"), F.lit("convention").alias("via"), F.col("p.turn").alias("turn"))
    usual = usual.join(probes.outcomes(fetches).where("status between 200 and 299").select(F.col("key").alias("sitemap_url")), "sitemap_url", "left_semi")
    both = named.unionByName(usual.select(*named.columns))
    if explicit is not None:
        both = both.unionByName(explicit.select("origin", "sitemap_url", F.lit("explicit").alias("via"), F.lit(-1).alias("turn")))
    return both.groupBy("origin").agg(F.min_by(F.struct("sitemap_url", "via"), "turn").alias("s")).select("origin", "s.*")


_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("loc", "lastmod", "changefreq", "priority")])
_PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("children", T.ArrayType(T.StringType()))])


def parse_one(xml: str | None) -> tuple[str, list[dict], list[str]]:
    """(kind, entries, children) of a sitemap file. What stands before a fault in the XML counts; entities of a document's own are refused."""
    path: list[str] = []
    words: list[str] = []
    entries: list[dict] = []
    children: list[str] = []
    seen: set[str] = set()
    entry: dict = {}

    def opened(name: str, _: dict) -> None:
        path.append(name.rpartition(":")[2])
        seen.add(path[-1])
        words.clear()
        if path[-2:] == ["urlset", "url"]:
            entry.clear()

    def closed(_: str) -> None:
        value = "".join(words).strip()
        words.clear()
        if path[-3:] == ["sitemapindex", "sitemap", "loc"] and value:
            children.append(value)
        elif "url" in path[:-1] and path[-1] in _ENTRY.names:
            entry.setdefault(path[-1], value)
        elif path[-2:] == ["urlset", "url"] and entry.get("loc"):
            entries.append({n: entry.get(n) or None for n in _ENTRY.names})
        path.pop()

    def refused(*_) -> None:
        raise ValueError("entity declarations are refused")

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = opened, closed, words.append, refused
    with contextlib.suppress(expat.ExpatError, ValueError):
        parser.Parse(re.sub(r"^\s*<\?xml.*?\?>", "", xml or "", count=1, flags=re.S).strip(), True)
    if children:
        return "index", [], children
    return "urlset" if entries else "index" if "sitemapindex" in seen else "unknown", entries, []


@F.pandas_udf(_PARSED)
def _parse(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_one(x) for x in xml], columns=_PARSED.names)


def parsed(sitemaps: DataFrame) -> DataFrame:
    """sitemaps(sitemap_url, xml) with kind, entries array<struct<loc,lastmod,changefreq,priority>>, children array<string>.

    A file with children is an index, else with entries a urlset, else an index if it says so; the rest, an empty urlset too, is unknown.
    """
    return sitemaps.withColumn("_p", _parse(F.col("xml"))).select(*sitemaps.columns, "_p.*")


def from_raw(fetched: DataFrame) -> DataFrame:
    """fetched(sitemap_url, raw binary), gunzipped where it is gzip, as parsed(), with ``cut``: whether the read limit was met. A plain file beyond it is read so far; one that unpacks beyond it is unknown."""
    limit = F.lit(fixed.SITEMAP_READ)
    plain = fetched.withColumn("_long", F.coalesce(F.octet_length("raw") > limit, F.lit(False))).withColumn("_g", gunzipped(F.substring("raw", F.lit(1), limit)))
    text_ = F.when(~F.col("_g.too_large"), F.make_valid_utf8(F.col("_g.data").cast("string")))
    return parsed(plain.select(*[c for c in fetched.columns if c != "raw"], (F.col("_long") | F.coalesce("_g.too_large", F.lit(False))).alias("cut"), text_.alias("xml")))


def with_children(maps: DataFrame, fetched: DataFrame, most: int = CHILDREN) -> DataFrame:
    """(sitemap_url, loc, lastmod, ...) entries of urlsets and of an index's first children. maps: parsed(); fetched: parsed() of all files."""
    own = maps.where("kind = 'urlset'").select("sitemap_url", F.explode("entries").alias("e"))
    child = maps.where("kind = 'index'").select("sitemap_url", F.explode(F.slice("children", 1, most)).alias("child"))
    below = child.join(fetched.select(F.col("sitemap_url").alias("child"), "entries"), "child").select("sitemap_url", F.explode("entries").alias("e"))
    return own.unionByName(below).select("sitemap_url", "e.*")


def lastmod_time(value: Column) -> Column:
    """Time of a lastmod of valid shape, read in UTC where it names no zone; null for what is no time."""
    shaped = F.when(value.rlike(fixed.LASTMOD), value)
    return F.try_to_timestamp(shaped)


def report(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """One row a sitemap: counts, lists of at most SAMPLE, newest and oldest lastmod, score. sites(sitemap_url, kind, via)."""
    at = lastmod_time(F.col("lastmod"))
    shaped = F.col("lastmod").rlike(fixed.LASTMOD)
    totals = entries.groupBy("sitemap_url").agg(
        F.count("*").alias("url_count"), F.count("lastmod").alias("with_lastmod"), F.count_if(~shaped).alias("invalid_lastmod"),
        F.max(at).alias("newest_lastmod"), F.min(at).alias("oldest_lastmod"),
        F.count_if(urls.host(F.col("loc")) != urls.host(F.col("sitemap_url"))).alias("off_origin"),  # what is no URL has no host
        F.count_if(~urls.scheme(F.col("loc")).isin("https", "")).alias("non_https"),
    )
    repeats = entries.groupBy("sitemap_url", "loc").agg(F.count("*").alias("n")).where("n > 1").groupBy("sitemap_url").agg(F.count("*").alias("duplicate_urls"))
    out = sites.join(totals, "sitemap_url", "left").join(repeats, "sitemap_url", "left").fillna(0, ["url_count", "with_lastmod", "invalid_lastmod", "off_origin", "non_https", "duplicate_urls"])
    # lists, and the counts that findings tell, end at SAMPLE
    out = out.withColumns({c: F.least(F.col(c), F.lit(SAMPLE)) for c in ("invalid_lastmod", "off_origin", "non_https", "duplicate_urls")})
    n = F.col("url_count")
    coverage = F.when(n > 0, F.col("with_lastmod") / n).otherwise(F.lit(0.0))
    score = 40 - F.when(F.col("kind") == "unknown", 25).otherwise(0) + F.when(F.col("via") == "robots.txt", 10).otherwise(0) + F.when(n > 0, 15).otherwise(0) + text.round_half_up(20 * coverage) + F.when((F.col("off_origin") == 0) & (n > 0), 5).otherwise(0)
    found = N.findings(
        N.finding("sitemap_found", "pass"), N.finding("sitemap_unknown", "fail", F.col("kind") == "unknown"), N.finding("sitemap_undeclared", "warn", F.col("via") != "robots.txt"),
        N.finding("sitemap_empty", "fail", (n == 0) & (F.col("kind") != "index")), N.finding("lastmod_none", "warn", (n > 0) & (F.col("with_lastmod") == 0)),
        N.finding("lastmod_coverage", F.when(coverage >= 0.9, "pass").otherwise("warn"), F.col("with_lastmod") > 0), N.finding("lastmod_invalid", "fail", F.col("invalid_lastmod") > 0),
        N.finding("off_origin", "fail", F.col("off_origin") > 0), N.finding("non_https", "warn", F.col("non_https") > 0), N.finding("duplicates", "warn", F.col("duplicate_urls") > 0),
        N.finding("urls_too_many", "fail", n > fixed.SITEMAP_URLS), N.finding("index", "info", F.col("kind") == "index"),
    )
    return out.withColumns({"sitemap_score": text.clamp(score), "sitemap_grade": text.grade(score), "sitemap_findings": found})


def _latest(fetches: DataFrame) -> DataFrame:
    """(key, status, raw) of each URL's latest GET; null status: it failed."""
    got = fetches.where(F.col("method") != "HEAD") if "method" in fetches.columns else fetches
    at = F.col("fetched_at") if "fetched_at" in fetches.columns else F.lit(0)
    return got.groupBy(urls.visit_key(F.col("url")).alias("key")).agg(F.max_by(F.struct("status", "raw"), F.struct(at, "status")).alias("g")).select("key", "g.status", "g.raw")


def lifecycle(origins: DataFrame, robots_sitemaps: DataFrame, fetches: DataFrame, explicit: DataFrame | None = None, most: int = CHILDREN) -> DataFrame:
    """One report an origin, from a log of raw fetches(url, status, raw, ...) to findings: discovery, unpacking, an index's first children, validation.

    A child file is read once, however many indexes name it. Children that did not answer
    with a sitemap are warned of; a file that met the read limit makes the counts lower bounds.
    An origin without a sitemap, or whose sitemap has an error status, scores 0.
    """
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    raw = _latest(fetches)
    sites = discovered(origins, robots_sitemaps, fetches, explicit).withColumn("key", urls.visit_key(F.col("sitemap_url"))).join(raw.select("key", "status"), "key", "left")
    mains = from_raw(sites.where(ok).select("key").distinct().join(raw, "key").select(F.col("key").alias("main"), "raw"))
    named = mains.where("kind = 'index'").select("main", F.posexplode(F.slice("children", 1, most)).alias("nth", "child")).withColumn("key", urls.visit_key(F.col("child")))
    read = from_raw(named.select("key").distinct().join(raw.where(ok), "key").select("key", "raw")).select("key", "entries", F.col("cut").alias("child_cut"))
    children = named.join(raw.select("key", "status"), "key", "left").join(read, "key", "left")
    warned = F.when(~ok, F.struct(F.when(F.col("status").isNull(), "child_unread").otherwise("child_status").alias("code"), F.lit("warn").alias("severity")))
    of_main = children.groupBy("main").agg(
        F.count_if(ok).alias("followed"), F.coalesce(F.bool_or("child_cut"), F.lit(False)).alias("child_cut"),
        F.transform(F.array_sort(F.collect_list(F.when(warned.isNotNull(), F.struct("nth", warned.alias("f"))))), lambda x: x["f"]).alias("warned"),
    )
    entries = mains.select(F.col("main").alias("sitemap_url"), F.explode("entries").alias("e")).unionByName(children.select(F.col("main").alias("sitemap_url"), F.explode("entries").alias("e"))).select("sitemap_url", "e.*")
    known = mains.select("main", "kind", "cut", F.size("children").alias("child_count")).join(of_main, "main", "left")
    reported = report(entries, sites.where(ok).drop("status").drop("sitemap_url").withColumnRenamed("key", "sitemap_url").join(known.withColumnRenamed("main", "sitemap_url"), "sitemap_url"))
    is_index = lambda f: f["code"] == "index"
    capped = N.findings(N.finding("read_cap", "warn", F.coalesce("cut", F.lit(False)) | F.coalesce("child_cut", F.lit(False))))
    none = F.array().cast("array<struct<code:string,severity:string>>")
    told = F.concat(F.coalesce("warned", none), F.filter("sitemap_findings", lambda f: ~is_index(f)), capped, F.filter("sitemap_findings", is_index))
    reported = reported.select("origin", "kind", "child_count", "followed", "url_count", "with_lastmod", "newest_lastmod", "oldest_lastmod", "off_origin", "non_https", "duplicate_urls", "invalid_lastmod", "sitemap_score", "sitemap_grade", told.alias("told"))
    out = origins.select("origin").join(sites.select("origin", "sitemap_url", "via", "status"), "origin", "left").join(reported, "origin", "left")
    failed = N.findings(N.finding("sitemap_missing", "fail", F.col("sitemap_url").isNull()), N.finding("sitemap_status", "fail", F.col("sitemap_url").isNotNull()))
    return out.withColumns({
        "found": F.col("kind").isNotNull(), "kind": F.coalesce("kind", F.lit("unknown")), "url_count": F.coalesce("url_count", F.lit(0)), "child_count": F.coalesce("child_count", F.lit(0)), "followed": F.coalesce("followed", F.lit(0)),
        "sitemap_score": F.coalesce("sitemap_score", F.lit(0)), "sitemap_grade": F.coalesce("sitemap_grade", F.lit("F")), "sitemap_findings": F.coalesce("told", failed),
    }).drop("told")
