"""The composite audits: one scan, one parse stage, every analysis as columns of the same row."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text, urls
from ..operators import nodes as N
from ..operators import onpage, robots, structured_data
from ..sources import pages as src

SEVERITIES = ("fail", "warn", "pass", "info")


def analysed(pages: DataFrame, references: Callable[[str], str] = unescape) -> DataFrame:
    """All on-page analyses of pages (with HTTP columns, see with_http_defaults) that pass the gates. references: see html_tree.tokens."""
    parsed = src.parse(src.loadable(pages).where("error is null").drop("error"), references).where("not too_deep")
    for step in (onpage.meta_tags, onpage.social, onpage.headings, onpage.content, structured_data.structured_data, onpage.images, onpage.links, onpage.rendering):
        parsed = step(parsed)
    return parsed


def by_severity(findings: Column) -> Column:
    """fail, warn, pass, info; in each the order in which they were found."""
    rank = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    ranked = F.transform(findings, lambda f, i: F.struct(F.element_at(rank, f["severity"]).alias("rank"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(ranked), lambda r: r["f"])


def issues(findings: Column, most: int = 3) -> Column:
    """Codes of a section's worst findings, failures first."""
    bad = F.filter(findings, lambda f: f["severity"].isin("fail", "warn"))
    return F.transform(F.slice(by_severity(bad), 1, most), lambda f: f["code"])


def rendered(findings: Column) -> Column:
    """Findings as lines of text, worst first; info shares the mark of a failure, as the audits that these rules follow have it."""
    mark = lambda s: F.when(s == "pass", "+").when(s == "warn", "!").otherwise("x")
    return F.array_join(F.transform(by_severity(findings), lambda f: F.concat(mark(f["severity"]), F.lit(" "), f["code"])), "\n")


def _holds_lists(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_lists(f.dataType) for f in kind)
    return isinstance(kind, T.ArrayType) or isinstance(kind, T.MapType) and _holds_lists(kind.valueType)


def cut(value: Column, kind: T.DataType, most: int) -> Column:
    """value with every list in it, at any depth of its type, cut to its first ``most`` elements; values without lists stay as they are."""
    if not _holds_lists(kind):
        return value
    if isinstance(kind, T.ArrayType):
        short = F.slice(value, 1, most)
        return F.transform(short, lambda x: cut(x, kind.elementType, most)) if _holds_lists(kind.elementType) else short
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: cut(v, kind.valueType, most))
    return F.when(value.isNotNull(), F.struct(*[cut(value[f.name], f.dataType, most).alias(f.name) for f in kind]))


def lists_over(value: Column, kind: T.DataType, most: int) -> Column:
    """How many lists in value, at any depth, are longer than ``most``. What lies beyond a cut isn't entered."""
    if not _holds_lists(kind):
        return F.lit(0)
    if isinstance(kind, T.StructType):
        return sum((lists_over(value[f.name], f.dataType, most) for f in kind if _holds_lists(f.dataType)), F.lit(0))
    inner = kind.valueType if isinstance(kind, T.MapType) else kind.elementType
    own = F.when(F.size(value) > most, 1).otherwise(0) if isinstance(kind, T.ArrayType) else F.lit(0)
    if not _holds_lists(inner):
        return own
    entered = F.map_values(value) if isinstance(kind, T.MapType) else F.slice(value, 1, most)
    return own + F.coalesce(F.aggregate(entered, F.lit(0), lambda n, x: n + lists_over(x, inner, most)), F.lit(0))


def capped(df: DataFrame, most: int = fixed.LIST_MOST, findings: str | None = None) -> DataFrame:
    """df with every list in every column cut to ``most`` elements and ``lists_cut``, how many were cut. Counts and scores stay.

    Where a column of findings is named, an info finding is added to it if anything was cut,
    after it was cut itself. A null list stays null. Built from the schema alone.
    """
    over = sum((lists_over(F.col(f"`{f.name}`"), f.dataType, most) for f in df.schema), F.lit(0))
    out = df.select(*[cut(F.col(f"`{f.name}`"), f.dataType, most).alias(f.name) for f in df.schema], over.cast("int").alias("lists_cut"))
    return out.withColumn(findings, F.concat(F.col(findings), N.findings(N.finding("lists_cut", "info", F.col("lists_cut") > 0)))) if findings else out


def truncated(s: Column, most: int = fixed.TEXT_MOST) -> Column:
    """Text up to ``most`` characters, and how many more there were."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("\n\n["), (F.length(s) - most).cast("string"), F.lit(" characters left out]"))).otherwise(s)


def with_json_text(df: DataFrame, findings: str | None = None, most: int = fixed.TEXT_MOST) -> DataFrame:
    """df with its lists cut (see capped) and ``text``: each row as JSON, nulls included, truncated. The columns stay whole beside it."""
    out = capped(df, findings=findings)
    return out.withColumn("text", truncated(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), most))


def error_kind(message: Column) -> Column:
    """A code for what an error message tells, most specific first."""
    out = F.lit("other")
    for pattern, code in reversed([
        (r"(?i)refusing to|private|not public|loopback", "private_host"), (r"(?i)timed? ?out|abort", "timeout"), (r"(?i)enotfound|eai_again|getaddrinfo|dns", "unknown_host"), (r"(?i)econnrefused|connection refused", "refused"),
        (r"(?i)econnreset|epipe|socket hang up|connection reset", "reset"),
        (r"(?i)certificate|ssl|tls|self.signed", "certificate"), (r"(?i)too many redirects|redirect loop", "redirects"), (r"http_404|\b404\b", "not_found"), (r"http_(401|403)|\b40[13]\b", "forbidden"), (r"not_html|content type", "not_html"),
    ]):
        out = F.when(message.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def with_site(pages: DataFrame, robots_txt: DataFrame | None) -> DataFrame:
    """Pages with their origin's robots report, its findings, and the search crawlers that it blocks there; nulls where none was fetched."""
    pages = pages.withColumns({"origin": urls.origin(F.col("final_url")), "path": urls.path(F.col("final_url"))})
    if robots_txt is None:
        return pages.withColumns({"robots_score": F.lit(None).cast("int"), "blocks_everything": F.lit(None).cast("boolean"), "sitemap_count": F.lit(None).cast("long"), "blocked_search": F.lit(None).cast("array<string>"), "robots_findings": F.lit(None).cast("array<struct<code:string,severity:string>>")})
    # one robots.txt an origin: an answer before an error, then the longer one
    rank = F.struct(F.col("status").alias("status"), (-F.length(F.coalesce("body", F.lit("")))).alias("size"), F.col("body").alias("body"))
    robots_txt = robots_txt.groupBy("origin").agg(F.min(rank).alias("r")).select("origin", "r.status", "r.body")
    report = robots.site_report(robots_txt).select("origin", "robots_score", "blocks_everything", "sitemap_count", "robots_findings")
    access = robots.access_summary(robots.crawler_access(pages.select("origin", "path").distinct().join(robots_txt.select("origin"), "origin", "left_semi"), robots_txt))
    return pages.join(report, "origin", "left").join(access.select("origin", "path", F.col("blocked_citation_critical").alias("blocked_search")), ["origin", "path"], "left")


def geo_audit(pages: DataFrame) -> DataFrame:
    """Readiness to be cited by answer engines: signals array<struct<id,weight,earned,status>>, geo_score. pages: analysed() and with_site()."""
    has = lambda p: F.exists("items", lambda i: F.array_contains(i["properties"], p))
    n, valid = F.col("item_count"), F.col("valid_items")
    lists = F.size(N.tag("ul", "ol", "table", "dl"))
    author_seen = F.exists(F.col("nodes"), lambda x: N.has_token(x, "class", "author") | N.has_token(x, "class", "byline") | (N.attr(x, "rel") == "author") | (N.attr(x, "itemprop") == "author"))
    author, entity, same = has("author") | F.coalesce(author_seen, F.lit(False)), F.col("has_organization") | F.col("has_person"), has("sameAs")
    dated = F.exists(F.col("nodes"), lambda x: (x["tag"] == "time") & F.map_contains_key(x["attrs"], "datetime"))
    points = lambda test, p: F.when(test, F.lit(float(p))).otherwise(F.lit(0.0))
    earned = {
        "crawler_access": points(F.coalesce(F.size("blocked_search"), F.lit(0)) <= 0, 25),
        "server_rendering": F.when(F.col("renders_without_js"), 20.0).when(F.col("spa_shell_detected"), 0.0).otherwise(8.0),
        "structured_data": F.when(n == 0, 0.0).when(F.size("parse_errors") > 0, 7.0).otherwise(15 * F.greatest(F.lit(0.6), valid / n)),
        "extractable_structure": points(F.col("h1_count") == 1, 4) + points(F.size("headings") >= 3, 4) + points(lists > 0, 4) + points(F.size("question_headings") > 0, 3),
        "attribution": F.when(F.col("has_article"), points(author, 4) + points(entity, 4) + points(same, 2)).otherwise(points(entity, 6) + points(same, 4)),
        "freshness": F.when(has("dateModified"), 5.0).when(has("datePublished"), 3.0).otherwise(0.0) + points(dated, 3),
        "depth": points(~F.col("thin_content"), 4) + points(F.col("reading_ease") >= 45, 2) + points(F.col("avg_words_per_sentence") <= 25, 1),
    }
    signals = F.array(*[
        F.struct(
            F.lit(k).alias("id"), F.lit(w).alias("weight"), text.round_half_up(earned[k]).cast("int").alias("earned"),
            F.when(earned[k] / w >= 0.85, "pass").when(earned[k] / w >= 0.4, "warn").otherwise("fail").alias("status"),
        )
        for k, w in fixed.SIGNAL_WEIGHTS.items()
    ])
    # a signal advises only where its own condition for advice holds too
    advise = {"extractable_structure": earned["extractable_structure"] < 12, "freshness": earned["freshness"] < 6, "depth": earned["depth"] < 5}
    out = pages.withColumn("signals", signals)
    status = lambda i: F.get("signals", F.lit(i))["status"]
    advice = [F.when((status(i) != "pass") & advise.get(k, F.lit(True)), F.lit(f"improve_{k}")) for i, k in enumerate(fixed.SIGNAL_WEIGHTS)]
    total = F.aggregate("signals", F.lit(0), lambda s, x: s + x["earned"])
    score = total / sum(fixed.SIGNAL_WEIGHTS.values()) * 100
    found = F.transform("signals", lambda s: F.struct(s["id"].alias("code"), s["status"].alias("severity")))
    return out.withColumns({
        "extractable_blocks": lists, "has_author_signals": author, "has_freshness_signals": has("dateModified") | has("datePublished"), "geo_score": text.clamp(score), "geo_grade": text.grade(text.clamp(score)),
        "geo_recommendations": F.slice(F.array_compact(F.array(*advice)), 1, 5), "geo_findings": found,
    })


def seo_audit(pages: DataFrame, include_geo: bool = False) -> DataFrame:
    """Weighted section scores with caps for excluded pages; sections, seo_score, top_recommendations. pages: analysed() and with_site()."""
    robots_score = F.coalesce("robots_score", F.lit(50))
    scores = {
        "meta": text.round_half_up(F.col("meta_score") * 0.75 + F.col("social_score") * 0.25).cast("int"), "headings": F.col("heading_score"), "content": F.col("content_score"),
        "structured_data": F.col("schema_score"), "images": F.col("image_score"), "links": F.col("links_score"), "robots": robots_score,
    }
    none = F.array().cast("array<struct<code:string,severity:string>>")
    robots_found = F.coalesce("robots_findings", none)
    found = {"meta": F.concat("meta_findings", "social_findings"), "headings": F.col("heading_findings"), "content": F.col("content_findings"), "structured_data": F.col("schema_findings"), "images": F.col("image_findings"), "links": F.col("link_findings"), "robots": robots_found}
    sections = F.array(*[
        F.struct(F.lit(k).alias("id"), scores[k].cast("int").alias("score"), text.grade(scores[k]).alias("grade"), F.lit(w).alias("weight"), issues(found[k]).alias("issues"))
        for k, w in fixed.SECTION_WEIGHTS.items()
    ])
    total = sum(scores[k] * w for k, w in fixed.SECTION_WEIGHTS.items()) / sum(fixed.SECTION_WEIGHTS.values())
    blocked = F.coalesce("blocks_everything", F.lit(False))
    score = F.least(text.clamp(total), F.when(~F.col("indexable"), 35).otherwise(100), F.when(blocked, 25).otherwise(100))
    advice = [
        F.when(~F.col("indexable"), F.lit("remove_noindex")), F.when(blocked, F.lit("unblock_robots")), F.when(F.col("title").isNull(), F.lit("add_title")), F.when(F.col("description").isNull(), F.lit("add_description")),
        F.when(F.col("h1_count") == 0, F.lit("add_h1")), F.when(F.col("item_count") == 0, F.lit("add_structured_data")), F.when(F.col("missing_alt") > 0, F.lit("add_alt_text")), F.when(F.col("thin_content"), F.lit("extend_content")),
        F.when(F.col("canonical").isNull(), F.lit("add_canonical")), F.when(F.col("sitemap_count") == 0, F.lit("declare_sitemap")),
    ]
    listed = F.array_compact(F.array(*advice))
    if include_geo:
        listed = F.concat(listed, F.col("geo_recommendations"))
    told = N.findings(
        N.finding("noindex", "fail", ~F.col("indexable")), N.finding("robots_block_everything", "fail", blocked), N.finding("overall", F.when(score >= 80, "pass").otherwise("info")),
        *[N.finding(k, F.when(scores[k] >= 80, "pass").when(scores[k] >= 60, "warn").otherwise("fail")) for k in fixed.SECTION_WEIGHTS],
    )
    return pages.withColumns({"sections": sections, "seo_score": score, "seo_grade": text.grade(score), "seo_findings": told, "top_recommendations": F.slice(F.array_distinct(listed), 1, 8)})
