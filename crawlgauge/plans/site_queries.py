"""Queries about sites. The page table has no robots.txt, sitemaps, redirects or head markup, so
each is made from the page table's own rows by a fixed rule, the same in Spark and in the SQL."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses, fixed, urls
from ..operators import hreflang, llms_txt, onpage, probes, redirects, robots, sitemaps, structured_data
from ..sources import pages as src
from . import audits

ROBOTS = [
    "User-agent: *\nDisallow:", "User-agent: *\nDisallow: /fr/\nAllow: /fr/8\nSitemap: https://x.example/s.xml", "User-agent: gptbot\nDisallow: /\n\nUser-agent: *\nDisallow: /de",
    "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /*/1*\n# end\n\nUser-agent: Googlebot\nDisallow: /*$", "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nDisallow:", "User-agent: OAI-SearchBot\nDisallow: /\nCrawl-delay: 3",
    "Disallow: /early\nnonsense\nUser-agent: *\nDisallow: /e*5$\nAllow: /en/9\nfoo: bar", "User-agent: ClaudeBot\nDisallow: /es\n\nUser-agent: claudebot\nDisallow: /en/2",
    "\ufeffUser-agent:\t*\nDisallow:\t/es\t", "User-agent: *\u00a0\r\n\tDisallow : /en\u00a0# why",
]
LLMS = ["# Name\n> About\n## Docs\n- [a](https://a.example/a)\n## Optional\n* [b](/b)", "plain", "# Only a title\n- [x](y)", ""]
HEADS = [
    '<meta property="og:title" content="t"><meta property="og:image" content="https://i.example/a.png"><meta name="twitter:card" content="summary">',
    '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:url" content="u"><meta property="og:type" content="w"><meta property="og:site_name" content="s">',
    "",
]
BODIES = ['<img src="/a.webp" alt="a" width="1" height="1" loading="lazy">', '<img src="/a.png"><img src="/b.png" alt="" width="1" height="2">', '<img src="/c.jpg" alt="c"><img src="/d.avif"><img src="/e.gif" alt="e" width="3" height="3">', ""]
LD = ['{"@type": "Event", "name": "x"}', '{"@type": "Product", "name": "p", "offers": "o"}', '{"@type": "Recipe", "author": "a"}', '{"@type": "JobPosting", "title": "t", "jobLocation": "l"}']
AGENTS = ["GPTBot", "ClaudeBot", "Googlebot"]


def _choice(values: list[str], by) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages")


def robots_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _pages(spark, sf_dir).select(urls.origin(F.col("url")).alias("origin")).distinct()
    size = F.length("origin")
    return sites.select("origin", F.when(F.pmod(size, F.lit(11)) == 0, 503).otherwise(200).alias("status"), _choice(ROBOTS, size).alias("body"))


def robots_verdicts(spark, sf_dir):
    asked = _pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"), F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent"))
    return robots.verdicts(asked, robots_table(spark, sf_dir)).select("page_id", "agent", "allowed", "matched_agent")


def robots_longest_match(spark, sf_dir):
    asked = _pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"), F.lit("ClaudeBot").alias("agent"))
    return robots.verdicts(asked, robots_table(spark, sf_dir)).select("page_id", "matched_type", "matched_path")


def crawler_access_by_purpose(spark, sf_dir):
    table = robots_table(spark, sf_dir)
    access = robots.crawler_access(table.select("origin", F.lit("/").alias("path")), table)
    return access.groupBy("purpose").agg(F.count_if(F.col("allowed")).alias("allowed_count"), F.count_if(~F.col("allowed")).alias("blocked_count"))


def sitemap_lastmod_stats(spark, sf_dir):
    n = F.col("page_id")
    lastmod = F.when(n % 4 == 0, F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).when(n % 4 == 1, "last week").when(n % 4 == 2, F.concat(F.lit("2023-05-05T"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":30:00Z")))
    entries = _pages(spark, sf_dir).select(F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/sitemap.xml")).alias("sitemap_url"), F.when(n % 7 == 3, "no url").when(n % 11 == 5, "https://other.example/x").otherwise(urls.visit_key(F.col("url"))).alias("loc"), lastmod.alias("lastmod"))
    sites = entries.select("sitemap_url").distinct().withColumns({"kind": F.lit("urlset"), "via": F.when(F.length("sitemap_url") % 2 == 0, "robots.txt").otherwise("convention")})
    out = sitemaps.report(entries, sites)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("sitemap_url", "url_count", "with_lastmod", F.col("invalid_lastmod").cast("long").alias("invalid_lastmod"), F.col("off_origin").cast("long").alias("off_origin"), stamp("newest_lastmod"), stamp("oldest_lastmod"), "sitemap_score")


def redirect_loops(spark, sf_dir):
    base = urls.visit_key(F.col("url"))
    hops = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<struct<url:string,status:int,location:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.col("page_id") % 5 - 1).cast("int")), lambda i: F.struct(F.concat(base, F.lit("~"), (i % 3).cast("string")).alias("url"), F.when(i == 1, 302).otherwise(301).alias("status"), F.lit("").alias("location")))
    )
    fetches = _pages(spark, sf_dir).select("page_id", "url", F.concat(base, F.lit("~f")).alias("final_url"), F.lit(200).alias("status"), hops.alias("redirects"))
    return redirects.trace(fetches).select("page_id", "hop_count", "has_loop", "https_upgrade", "has_temporary_redirect")


def host_variants(spark, sf_dir):
    domains = _pages(spark, sf_dir).select(urls.apex(urls.host(F.col("url"))).alias("domain")).distinct()
    kind = F.length("domain") % 3
    secure = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    final = F.when(kind == 0, secure).when(kind == 1, F.col("variant")).otherwise(F.concat(F.lit("https://www."), F.col("domain"), F.lit("/")))
    down = (kind == 2) & F.col("variant").startswith("http://www.")
    hop = F.array(F.struct(F.col("variant").alias("url"), F.lit(301).alias("status"), F.lit("").alias("location")))
    fetches = redirects.host_variants(domains).select(F.col("variant").alias("url"), final.alias("final_url"), F.when(down, 503).otherwise(200).alias("status"), F.when(final != F.col("variant"), hop).otherwise(F.slice(hop, 1, 0)).alias("redirects"))
    out = redirects.canonical_host(domains, fetches)
    return out.select("domain", F.size("distinct_endpoints").alias("endpoints"), "converges", "forces_https", "unreachable", "host_score")


def _spliced(spark: SparkSession, sf_dir: str, head=None, body=None) -> DataFrame:
    html = F.col("html")
    if head is not None:
        html = F.regexp_replace(html, F.lit("</head>"), F.concat(head, F.lit("</head>")))
    if body is not None:
        html = F.regexp_replace(html, F.lit("<article>"), F.concat(F.lit("<article>"), body))
    return src.parse(src.with_http_defaults(_pages(spark, sf_dir).select("page_id", "url", html.alias("html"))))


def hreflang_reciprocity(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    other = pages.select((F.col("page_id").bitwiseXOR(F.lit(1))).alias("page_id"), F.col("url").alias("other"))
    linked = pages.join(other, "page_id").where(F.col("page_id") % 3 != 0)
    tag = F.concat(F.lit('<head><link rel="alternate" hreflang="de" href="'), "other", F.lit('">'))
    rest = pages.join(linked.select("page_id"), "page_id", "left_anti").select("page_id", "url", "html")
    html = linked.select("page_id", "url", F.concat(F.substring_index("html", "<head>", 1), tag, F.expr("substring(html, instr(html, '<head>') + 6)")).alias("html"))
    parsed = src.parse(src.with_http_defaults(html.unionByName(rest)))
    return hreflang.reciprocity(hreflang.alternates(parsed), parsed).select("page_id", "is_self", "reciprocates")


def schema_missing_required(spark, sf_dir):
    head = F.concat(F.lit('<script type="application/ld+json">'), _choice(LD, F.col("page_id")), F.lit("</script>"))
    found = structured_data.structured_data(_spliced(spark, sf_dir, head=head))
    item = F.get("items", F.lit(0))
    return found.select("page_id", item["type"].alias("type"), F.array_join(item["missing_required"], ",").alias("missing_required"), item["valid"].alias("valid"), "schema_score")


def microdata_items(spark, sf_dir):
    """Microdata of every ruled type with more or fewer of its properties, in every third page inside an item of another type, and RDFa beside it."""
    n = F.col("page_id")
    ruled = F.array(*[F.struct(F.lit(t).alias("type"), F.array(*map(F.lit, [*r[0], *r[1]])).alias("props")) for t, r in fixed.SCHEMA_RULES.items()])
    item = F.element_at(ruled, (n % len(fixed.SCHEMA_RULES) + 1).cast("int"))
    spans = F.array_join(F.transform(F.slice(item["props"], F.lit(1), (n % 7).cast("int")), lambda p: F.concat(F.lit('<span itemprop="'), p, F.lit('">x</span>'))), "")
    scope = lambda kind, inner: F.concat(F.lit('<div itemscope itemtype=" https://schema.org/'), kind, F.lit(' ">'), inner, F.lit("</div>"))
    one = scope(item["type"], spans)
    body = F.concat(F.when(n % 3 == 0, scope(F.lit("Thing"), F.concat(F.lit('<b itemprop="extra">x</b>'), one))).otherwise(one), F.repeat(F.lit('<i typeof="Person">x</i>'), (n % 4).cast("int")))
    found = structured_data.structured_data(_spliced(spark, sf_dir, body=body))
    each = found.select("page_id", "microdata_items", "rdfa_items", F.explode("items").alias("item"))
    listed = lambda name: F.array_join(F.array_sort(F.col(f"item.{name}")), ",").alias(name)
    return each.select("page_id", "microdata_items", "rdfa_items", "item.format", "item.type", listed("properties"), listed("missing_required"), listed("missing_recommended"), "item.valid")


def splice_findings(spark, sf_dir):
    """The coded findings of previews and images over pages that are given some."""
    pages = _spliced(spark, sf_dir, head=_choice(HEADS, F.col("page_id")), body=_choice(BODIES, F.col("page_id")))
    codes = lambda name: F.array_join(F.transform(name, lambda f: F.concat(f["severity"], F.lit(":"), f["code"])), ",")
    return onpage.images(onpage.social(pages)).select("page_id", codes("social_findings").alias("social_codes"), codes("image_findings").alias("image_codes"))


def image_alt_score(spark, sf_dir):
    return onpage.images(_spliced(spark, sf_dir, body=_choice(BODIES, F.col("page_id")))).select("page_id", "total_images", "missing_alt", "missing_dimensions", "image_score")


def social_score(spark, sf_dir):
    found = onpage.social(_spliced(spark, sf_dir, head=_choice(HEADS, F.col("page_id"))))
    return found.select("page_id", F.array_join(F.array_sort(F.map_keys("open_graph")), ",").alias("open_graph"), "social_score")


def llms_sections(spark, sf_dir):
    files = robots_table(spark, sf_dir).select("origin", "status", _choice(LLMS, F.length("origin")).alias("body"), F.lit(404).alias("full_status"))
    return llms_txt.llms_txt(files).select("origin", "found", "title", "summary", F.array_join("sections", ",").alias("sections"), "link_count", "has_optional")


def private_hosts(spark, sf_dir):
    hosts = _pages(spark, sf_dir).select(urls.host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", addresses.is_private(F.col("host")).alias("private"), urls.admitted(F.col("host")).alias("admitted"))


def urls_resolved(spark, sf_dir):
    """References made from page numbers, one row each, read at their page's URL: dots, backslashes, each component's encoding, ports, names, addresses."""
    n = F.col("page_id").cast("string")
    number = F.pmod(F.col("page_id") * F.lit(2654435761), F.lit(2**32)).cast("string")
    made = F.array(
        F.concat(F.lit("../x y?a b#"), n), F.concat(F.lit("?k="), n, F.lit("&v={a}^'")), F.lit("#\u00e9"), F.concat(F.lit("\\\\HOST"), n, F.lit(".Example:80\\a\\.\\b")), F.lit("http:rel"),
        F.concat(F.lit(" HTTPS://User:@H"), n, F.lit(".EXAMPLE:0443/%7E/..\t")), F.concat(F.lit("//"), number), F.concat(F.lit("//a<"), n), F.concat(F.lit("mailto:A B@"), n),
        F.concat(F.lit("//x:"), (F.col("page_id") * 7).cast("string")), F.concat(F.lit(".//./..//%2e/\u00fc|^"), n), F.concat(F.lit("//M\u00dcNCHEN.example:/"), n),
    )
    rows = _pages(spark, sf_dir).select("page_id", urls.resolve_all("url", made).alias("resolved"))
    return rows.select("page_id", F.posexplode("resolved").alias("kind", "resolved")).withColumn("kind", F.col("kind").cast("long"))


def address_ranges(spark, sf_dir):
    """Addresses made from page numbers, half of them at the edges of the ranges, each in one of eight spellings."""
    n = F.col("page_id")
    ends = F.array(*[F.lit(x) for first, last in addresses.pairs(4) for x in (first - 1, first, last, last + 1) if 0 <= x < 2**32])
    number = F.when(n % 2 == 0, F.pmod(n * 2654435761, F.lit(2**32))).otherwise(F.element_at(ends, (F.pmod(F.floor(n / 2), F.size(ends)) + 1).cast("int")))
    made = _pages(spark, sf_dir).select("page_id", number.cast("long").alias("number"))
    byte = lambda i: F.shiftright("number", 24 - 8 * i).bitwiseAND(F.lit(255))
    dotted = F.concat_ws(".", *[byte(i).cast("string") for i in range(4)])
    half = lambda i: F.lower(F.hex(byte(2 * i) * 256 + byte(2 * i + 1)))
    spellings = [
        dotted, F.col("number").cast("string"), F.concat(F.lit("0x"), F.hex("number")), F.concat(F.lit("0"), F.conv(byte(0).cast("string"), 10, 8), F.lit("."), (F.col("number") % 2**24).cast("string")),
        F.concat(F.lit("[::ffff:"), dotted, F.lit("]")), F.concat(F.lit("::FFFF:"), half(0), F.lit(":"), half(1)), F.concat(F.lit("64:ff9b::"), dotted), F.concat(F.lit("2606:4700::"), half(0), F.lit(":"), half(1)),
    ]
    host = F.element_at(F.array(*spellings), (n % len(spellings) + 1).cast("int"))
    return made.select("page_id", host.alias("host")).select("page_id", "host", addresses.is_private(F.col("host")).alias("private"))


def robots_reports(spark, sf_dir):
    out = robots.site_report(robots_table(spark, sf_dir))
    codes = F.array_join(F.transform("robots_findings", lambda f: F.concat(f["severity"], F.lit(":"), f["code"])), ",")
    return out.select("origin", "found", "group_count", "sitemap_count", "warning_count", "delay_count", "blocks_everything", F.col("robots_score").cast("int").alias("robots_score"), codes.alias("findings"))


def crawler_findings(spark, sf_dir):
    table = robots_table(spark, sf_dir)
    out = robots.access_summary(robots.crawler_access(table.select("origin", F.lit("/").alias("path")), table))
    codes = F.array_join(F.transform("crawler_findings", lambda f: F.concat(f["severity"], F.lit(":"), f["code"])), ",")
    return out.select("origin", "allowed_count", "blocked_count", F.array_join("blocked_citation_critical", ",").alias("search_blocked"), codes.alias("findings"))


def redirect_log(spark, sf_dir):
    """A fetch log: runs of pages that redirect each to the next, some back, some by a path alone, some out of the log."""
    n = F.col("page_id")
    base = F.concat(urls.visit_key(F.col("url")), F.lit("/~"), n.cast("string"))
    nodes = _pages(spark, sf_dir).select("page_id", base.alias("url"))
    to = F.when((n % 60 >= 40) & (n % 60 < 58), n + 1).when(n % 4 == 0, F.lit(None)).when(n % 12 == 11, n - 2).when(n % 30 == 13, F.lit(-1)).otherwise(n + 1)
    joined = nodes.withColumn("to", to).join(nodes.select(F.col("page_id").alias("to"), F.col("url").alias("next")), "to", "left")
    location = F.when(F.col("to") == -1, F.concat(F.lit("https://gone.example/"), n.cast("string"))).when((n % 5 == 2) & (urls.scheme(F.col("next")) == urls.scheme(F.col("url"))), F.regexp_replace("next", "^[a-z]+:", "")).otherwise(F.col("next"))
    return joined.select("page_id", "url", F.when(location.isNull(), 200).when(n % 3 == 1, 302).otherwise(301).alias("status"), location.alias("location"))


def redirect_chains(spark, sf_dir):
    return redirects.follow(redirect_log(spark, sf_dir)).select("url", "final_url", "hop_count", "outcome", "has_temporary_redirect")


def rejected_pages(spark, sf_dir):
    n = F.col("page_id")
    pages = src.with_http_defaults(_pages(spark, sf_dir)).withColumns({
        "status": F.when(n % 9 == 1, 404).when(n % 9 == 4, 503).otherwise(200), "content_type": F.when(n % 5 == 2, "application/pdf").when(n % 5 == 3, "").otherwise("text/html"), "html": F.when(n % 13 != 6, F.when(n % 17 == 8, F.repeat(F.lit("<div>"), 600)).otherwise(F.col("html"))),
    })
    return src.load(pages).where("size(causes) > 0").select("page_id", F.array_join("causes", ",").alias("causes"))


def responses_loaded(spark, sf_dir):
    """A log of raw responses: bodies with a byte-order mark, broken bytes or beyond the cap, headers that repeat; loaded and audited."""
    n, html = F.col("page_id"), F.encode("html", "UTF-8")
    body = F.when(n % 50 == 7, F.concat(html, F.encode(F.repeat(F.lit("x"), 2_000_000), "UTF-8"))).when(n % 4 == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), html)).when(n % 4 == 2, F.concat(html, F.lit(bytearray(b"\xff")), F.encode(F.lit("é"), "UTF-8"), F.lit(bytearray(b"\xe2\x82")))).when(n % 20 != 0, html)
    header = lambda name, value: F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    often = F.array(header("Content-Type", " text/html; charset=UTF-8"), header("Set-Cookie", "a=1"), header("X-Robots-Tag", "noarchive"), header("set-cookie", "b=2"))
    headers = F.when(n % 3 == 0, F.concat(often, F.array(header("x-robots-tag", "NOINDEX ")))).otherwise(often)
    log = _pages(spark, sf_dir).select("page_id", "url", F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status"), headers.alias("headers"), body.alias("body"))
    read = src.from_responses(log)
    found = onpage.meta_tags(src.load(read.withColumn("html_md5", F.md5("html"))))
    return found.select("page_id", "bytes", "truncated", "html_md5", F.element_at("headers", F.lit("set-cookie")).alias("cookie"), "x_robots_tag", "content_type", "indexable", F.array_join("causes", ",").alias("causes"))


def external_domains(spark, sf_dir):
    """Domains that pages link to outside, from links made by a rule: other pages' hosts, some twice."""
    pages = _pages(spark, sf_dir)
    next_ = pages.select((F.col("page_id") - 1).alias("page_id"), urls.host(F.col("url")).alias("next_host"))
    link = lambda host, path: F.concat(F.lit('<a href="https://'), host, F.lit(f'/{path}">see</a>'))
    body = F.concat(F.lit('<a href="//cdn.example/x">see</a>'), F.coalesce(F.concat(link(F.col("next_host"), "a"), F.when(F.col("page_id") % 2 == 0, link(F.upper("next_host"), "b")).otherwise("")), F.lit("")))
    html = pages.join(next_, "page_id", "left").select("page_id", "url", F.regexp_replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), body)).alias("html"))
    found = onpage.external_domains(onpage.links(src.parse(src.with_http_defaults(html))))
    return found.select("page_id", "domain", "count", "rank")


ALTERNATES = [
    '<link rel="alternate" hreflang="de" href="/d"><link rel="alternate" hreflang="DE" href="/e"><link rel="alternate" hreflang="x-default" href="/">', '<link rel="alternate" hreflang="english" href="/e"><link rel="alternate" hreflang="zh-Hant-TW" href="/z">', "",
    '<link rel="alternate" hreflang=" fr " href=" /f "><link rel="alternate" hreflang="en_US" href="/u"><link rel="alternate" hreflang="es-419" href="/s">',
]


def hreflang_report(spark, sf_dir):
    parsed = _spliced(spark, sf_dir, head=_choice(ALTERNATES, F.col("page_id")))
    out = hreflang.page_report(parsed, hreflang.alternates(parsed))
    codes = F.array_join(F.transform("hreflang_findings", lambda f: F.concat(f["severity"], F.lit(":"), f["code"])), ",")
    return out.select("page_id", F.col("alternates").cast("long").alias("alternates"), "has_x_default", F.array_join("duplicate_codes", ",").alias("duplicate_codes"), F.array_join("invalid_codes", ",").alias("invalid_codes"), codes.alias("findings"))


DIRECTIVES = [
    '<title>\n  A title of fitting length, in lines\n</title><meta name="robots" content=" NOINDEX,\n nofollow ">', '<meta name="robots" content="none"><meta name="description" content="\n\tshort\n">', '<meta name="robots" content="index, follow"><link rel="canonical" href=" /self ">', "",
]


def meta_directives(spark, sf_dir):
    """Each page's title goes, so that the spliced head says all."""
    html = F.regexp_replace("html", "(?s)<title>.*?</title>|<meta name=\"?(?:description|robots)[^>]*>|<link rel=\"?canonical[^>]*>", "")
    html = F.regexp_replace(html, F.lit("</head>"), F.concat(_choice(DIRECTIVES, F.col("page_id")), F.lit("</head>")))
    found = onpage.meta_tags(src.parse(src.with_http_defaults(_pages(spark, sf_dir).select("page_id", "url", html.alias("html")))))
    return found.select("page_id", "title", "title_length", "description", "description_length", F.array_join("robots_directives", ",").alias("directives"), "indexable", "followable")


def seo_robots_section(spark, sf_dir):
    """The audit joined with robots.txt and with answer-engine readiness: the robots section, its issues, and what follows from them."""
    pages = audits.with_site(audits.analysed(src.with_http_defaults(_pages(spark, sf_dir))), robots_table(spark, sf_dir))
    out = audits.seo_audit(audits.geo_audit(pages), include_geo=True)
    section = F.get(F.filter("sections", lambda s: s["id"] == "robots"), F.lit(0))
    access = F.get(F.filter("signals", lambda s: s["id"] == "crawler_access"), F.lit(0))
    return out.select(
        "page_id", section["score"].alias("robots_score"), section["grade"].alias("robots_grade"), F.array_join(section["issues"], ",").alias("issues"), access["earned"].alias("crawler_access"),
        F.array_contains("top_recommendations", "unblock_robots").alias("advises_unblocking"), F.array_join("blocked_search", ",").alias("blocked_search"),
    )


def link_probes(spark, sf_dir):
    """The link audit with probes: links of all pages are probed once each, at most 5 of a host; answers by a rule, some of them missing, refused or repeated."""
    parsed = onpage.links(src.parse(src.with_http_defaults(_pages(spark, sf_dir))))
    sample = onpage.link_sample(parsed)
    planned = probes.plan(sample, 5)
    size = F.length("key")
    status = F.when(size % 7 == 0, 404).when(size % 7 == 1, 403).when(size % 7 == 2, F.lit(None)).otherwise(200)
    first = planned.where(size % 11 != 0).select(F.col("key").alias("url"), status.alias("status"), F.lit("GET").alias("method"), F.lit(1).alias("fetched_at"))
    later = first.where(F.length("url") % 7 == 0).select("url", F.lit(200).alias("status"), "method", F.lit(0).alias("fetched_at"))
    refused = first.where(F.length("url") % 3 == 0).select("url", F.lit(405).alias("status"), F.lit("HEAD").alias("method"), F.lit(2).alias("fetched_at"))
    checked = onpage.link_status(sample, first.unionByName(later).unionByName(refused))
    out = onpage.links(src.parse(src.with_http_defaults(_pages(spark, sf_dir))), checked)
    return out.select("page_id", "checked_count", "broken_count", "links_score")


SITEMAP_FILES = [
    '<?xml version="1.0"?><urlset><url ><loc><![CDATA[https://a.example/x]]></loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.example/?a=1&#38;b=2</loc></url></urlset>',
    "<sitemapindex><sitemap><loc> https://a.example/1.xml </loc></sitemap><sitemap><loc>https://a.example/2.xml</loc></sitemap></sitemapindex>",
    "<urlset></urlset>", "<sitemapindex/>", "<rss><channel/></rss>", "<urlset><url><loc>https://a.example/cut</loc></url><url><loc>https://a.exam",
]


def sitemap_files(spark, sf_dir):
    files = _pages(spark, sf_dir).select("page_id", F.col("url").alias("sitemap_url"), F.encode(_choice(SITEMAP_FILES, F.col("page_id")), "UTF-8").alias("raw"))
    return sitemaps.from_raw(files).select("page_id", "kind", F.size("entries").alias("entry_count"), F.size("children").alias("child_count"), F.get("entries", F.size("entries") - 1)["loc"].alias("last_loc"))


def sitemap_lifecycle(spark, sf_dir):
    """From a log of raw bytes, packed and plain, to each origin's sitemap report; which place answers, and how, follows from the origin's length."""
    table = robots_table(spark, sf_dir)
    kind = F.length("origin") % 5
    file = lambda i, pack=False: F.lit(gzip.compress(SITEMAP_FILES[i].encode(), mtime=0) if pack else SITEMAP_FILES[i].encode())
    row = lambda path, method, status, raw=None: F.struct(F.concat("origin", F.lit(path)).alias("url"), F.lit(method).alias("method"), F.lit(status).alias("status"), (F.lit(None).cast("binary") if raw is None else raw).alias("raw"))
    rows = (
        F.when(kind == 0, F.array(row("/sitemap.xml", "HEAD", 405), row("/sitemap.xml", "GET", 200, file(0, True))))
        .when(kind == 1, F.array(row("/sitemap.xml", "HEAD", 404), row("/sitemap_index.xml", "HEAD", 200), row("/sitemap_index.xml", "GET", 200, file(1))))
        .when(kind == 2, F.array(row("/sitemap.xml", "HEAD", 200), row("/sitemap.xml", "GET", 500)))
        .when(kind == 4, F.array(row("/sitemap.xml", "HEAD", 200), row("/sitemap.xml", "GET", 200, file(3))))
    )
    log = table.select(F.explode(rows).alias("r")).select("r.*")
    shared = [("https://a.example/1.xml", "GET", 200, bytearray(gzip.compress(SITEMAP_FILES[5].encode(), mtime=0))), ("https://a.example/2.xml", "GET", 500, None), ("https://x.example/s.xml", "GET", 200, bytearray(SITEMAP_FILES[2].encode()))]
    out = sitemaps.lifecycle(table.select("origin"), robots.sitemaps(table), log.unionByName(spark.createDataFrame(shared, log.schema)))
    codes = F.array_join(F.transform("sitemap_findings", lambda f: F.concat(f["severity"], F.lit(":"), f["code"])), ",")
    return out.select("origin", "sitemap_url", "via", "status", "found", "kind", F.col("url_count").cast("long").alias("url_count"), F.col("followed").cast("long").alias("followed"), F.col("sitemap_score").cast("int").alias("sitemap_score"), codes.alias("findings"))


QUERIES = {f.__name__: f for f in (
    urls_resolved, responses_loaded, external_domains, microdata_items, splice_findings, address_ranges, sitemap_lifecycle, redirect_chains, rejected_pages, hreflang_report, meta_directives, seo_robots_section, link_probes, robots_reports, crawler_findings, sitemap_files, robots_verdicts, robots_longest_match, crawler_access_by_purpose, sitemap_lastmod_stats, redirect_loops, host_variants, hreflang_reciprocity,
    schema_missing_required, image_alt_score, social_score, llms_sections, private_hosts,
)}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of literals; a single column's rows are numbered from 0."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _numbered(name: str, values: list[str]) -> str:
    return _values(name, "i, body", list(enumerate(values)))


_PG = """pg AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS q FROM pages)"""
_NORMAL = "scheme || '://' || host || CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END || q"
_WHITE = "' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 160, 0xFEFF))
_RULES = f"""{_numbered("bodies", ROBOTS)}, {_PG},
raws AS (SELECT i, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS ln FROM bodies),
bare AS (SELECT i, ln, trim(regexp_replace(raw, '#.*$', ''), {_WHITE}) AS b FROM raws),
fields AS (SELECT i, ln, lower(trim(split_part(b, ':', 1), {_WHITE})) AS field, trim(substr(b, instr(b, ':') + 1), {_WHITE}) AS value FROM bare WHERE contains(b, ':')),
kept AS (SELECT *, field = 'user-agent' AS is_agent FROM fields WHERE (field = 'user-agent' AND value <> '') OR field IN ('allow', 'disallow', 'crawl-delay', 'host', 'clean-param', 'noindex')),
seen AS (SELECT *, max(CASE WHEN is_agent THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY ln) AS s FROM kept),
flagged AS (SELECT *, is_agent AND NOT coalesce(lag(is_agent) OVER (PARTITION BY i ORDER BY ln), false) AS opens FROM seen WHERE s = 1),
grouped AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY ln) AS g FROM flagged),
agents AS (SELECT DISTINCT i, g, lower(value) AS agent FROM grouped WHERE is_agent),
rules AS (SELECT a.i, a.agent, r.ln, CASE WHEN r.value = '' THEN 'allow' ELSE r.field END AS type, CASE WHEN r.value = '' THEN '/' ELSE r.value END AS pattern
  FROM agents a JOIN grouped r ON a.i = r.i AND a.g = r.g WHERE r.field IN ('allow', 'disallow')),
regexes AS (SELECT *, '^' || replace(regexp_escape(replace(regexp_replace(pattern, '\\$$', ''), '*', 'ZSTARZ')), 'ZSTARZ', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END AS rx FROM rules),
sites AS (SELECT DISTINCT scheme || '://' || host AS origin FROM pg),
robots AS (SELECT origin, length(origin) % {len(ROBOTS)} AS i, CASE WHEN length(origin) % 11 = 0 THEN 503 ELSE 200 END AS status FROM sites)"""


def _judged(asked: str) -> str:
    return f"""asked AS ({asked}),
chosen AS (SELECT a.*, r.i, r.status, CASE WHEN EXISTS (SELECT 1 FROM agents g WHERE g.i = r.i AND g.agent = lower(a.agent)) THEN lower(a.agent)
  WHEN EXISTS (SELECT 1 FROM agents g WHERE g.i = r.i AND g.agent = '*') THEN '*' END AS matched_agent FROM asked a JOIN robots r USING (origin)),
best AS (SELECT c.id, max(CASE WHEN regexp_matches(c.path, x.rx) THEN {{'n': length(x.pattern), 'a': x.type = 'allow', 'o': -x.ln, 't': x.type, 'p': x.pattern}} END) AS hit
  FROM chosen c LEFT JOIN regexes x ON x.i = c.i AND x.agent = c.matched_agent GROUP BY c.id),
judged AS (SELECT c.*, CASE WHEN status >= 500 THEN false WHEN hit IS NULL THEN true ELSE hit.a END AS allowed, hit.t AS matched_type, hit.p AS matched_path FROM chosen c JOIN best USING (id))"""


_PATH = "scheme || '://' || host AS origin, CASE WHEN p = '' THEN '/' ELSE p END AS path"
_AGENTS = ", ".join(f"'{a}'" for a in AGENTS)
_CRAWLERS = _values("crawlers", "ordinal, token, vendor, purpose, respects, provenance, deprecated", fixed.crawler_rows())
_REQUIRED = _values("required", "type, props", [(t, ",".join(r[0])) for t, r in fixed.SCHEMA_RULES.items()])
_REC = _values("recommended", "type, props", [(t, ",".join(r[1])) for t, r in fixed.SCHEMA_RULES.items()])

#: What the bodies of ROBOTS say, by hand: groups, sitemaps, groups with a delay, whether all is blocked at the root, codes of the warnings.
_SAY = [
    (1, 0, 0, False, ""), (1, 1, 0, False, ""), (2, 0, 0, False, ""), (2, 0, 0, False, ""), (2, 0, 0, True, ""), (1, 0, 1, False, ""),
    (1, 0, 0, False, "warn:rule_before_agent,warn:no_colon,warn:unknown_field"), (2, 0, 0, False, ""), (1, 0, 0, False, ""), (1, 0, 0, False, ""),
]
#: What the files of SITEMAP_FILES hold, by hand.
_HOLD = [("urlset", 2, 0, "https://a.example/?a=1&b=2"), ("index", 0, 2, None), ("unknown", 0, 0, None), ("index", 0, 0, None), ("unknown", 0, 0, None), ("urlset", 1, 0, "https://a.example/cut")]

#: What becomes of each kind of origin, by hand: place, via, status, found, kind, URLs, children read, score, findings. 9: robots.txt names an empty file.
_LIFE = [
    (0, "/sitemap.xml", "convention", 200, True, "urlset", 2, 0, 65, "pass:sitemap_found,warn:sitemap_undeclared,warn:lastmod_coverage,fail:off_origin"),
    (1, "/sitemap_index.xml", "convention", 200, True, "index", 1, 1, 55, "warn:child_status,pass:sitemap_found,warn:sitemap_undeclared,warn:lastmod_none,fail:off_origin,info:index"),
    (2, "/sitemap.xml", "convention", 500, False, "unknown", 0, 0, 0, "fail:sitemap_status"), (3, None, None, None, False, "unknown", 0, 0, 0, "fail:sitemap_missing"),
    (4, "/sitemap.xml", "convention", 200, True, "index", 0, 0, 40, "pass:sitemap_found,warn:sitemap_undeclared,info:index"),
    (9, "https://x.example/s.xml", "robots.txt", 200, True, "unknown", 0, 0, 25, "pass:sitemap_found,fail:sitemap_unknown,fail:sitemap_empty"),
]

SQL = {
    "robots_reports": f"""WITH {_PG}, {_values("say", "i, groups, maps, delays, blocks, warned", [(i, *s) for i, s in enumerate(_SAY)])},
      s AS (SELECT DISTINCT scheme || '://' || host AS origin FROM pg), r AS (SELECT origin, length(origin) % 11 <> 0 AS found, say.* FROM s JOIN say ON length(origin) % {len(ROBOTS)} = i)
      SELECT origin, found, CAST(groups AS BIGINT) AS group_count, CAST(maps AS BIGINT) AS sitemap_count, CAST(len(list_filter(string_split(warned, ','), lambda x: x <> '')) AS BIGINT) AS warning_count,
        CAST(delays AS BIGINT) AS delay_count, found AND blocks AS blocks_everything, CASE WHEN found AND blocks THEN 0 WHEN NOT found THEN 40 WHEN maps > 0 THEN 100 ELSE 70 END AS robots_score,
        concat_ws(',', CASE WHEN found THEN 'pass:robots_found' ELSE 'fail:robots_failed' END, CASE WHEN found AND blocks THEN 'fail:blocks_everything' END,
          CASE WHEN maps > 0 THEN 'pass:sitemap_declared' ELSE 'warn:sitemap_undeclared' END, nullif(warned, ''), CASE WHEN delays > 0 THEN 'info:crawl_delay' END) AS findings FROM r""",
    "crawler_findings": f"WITH {_RULES}, {_CRAWLERS}, flags AS (SELECT i, bool_or(agent = 'applebot') AS apple, bool_or(agent = 'googlebot') AS google FROM agents GROUP BY i), "
    + _judged("SELECT origin || ' ' || token AS id, origin, '/' AS path, purpose, token, respects, ordinal, CASE WHEN token = 'Applebot' AND NOT coalesce(apple, false) AND coalesce(google, false) THEN 'Googlebot' ELSE token END AS agent FROM robots LEFT JOIN flags USING (i), crawlers WHERE NOT deprecated")
    + """, c AS (SELECT origin, count(*) FILTER (allowed) AS allowed_count, count(*) FILTER (NOT allowed) AS blocked_count, coalesce(string_agg(token, ',' ORDER BY ordinal) FILTER (NOT allowed AND purpose = 'search'), '') AS search_blocked,
      count(*) FILTER (NOT allowed AND respects <> 'yes') AS weak, count(*) FILTER (allowed AND purpose = 'training') AS training FROM judged GROUP BY origin)
      SELECT origin, allowed_count, blocked_count, search_blocked, concat_ws(',', CASE WHEN blocked_count = 0 THEN 'info:all_crawlers_allowed' ELSE 'info:crawlers_blocked' END, CASE WHEN search_blocked <> '' THEN 'warn:search_crawlers_blocked' END,
        CASE WHEN weak > 0 THEN 'warn:blocks_unenforceable' END, CASE WHEN training > 0 THEN 'info:training_crawlers_allowed' END) AS findings FROM c""",
    "sitemap_files": f"""WITH {_values("hold", "i, kind, n, c, loc", [(i, *h) for i, h in enumerate(_HOLD)])}
      SELECT page_id, kind, CAST(n AS INTEGER) AS entry_count, CAST(c AS INTEGER) AS child_count, loc AS last_loc FROM pages JOIN hold ON page_id % {len(_HOLD)} = i""",
    "private_hosts": f"WITH {_PG} SELECT DISTINCT host, false AS private, 'https://' || host || '/' AS admitted FROM pg",

    "urls_resolved": f"""WITH {_PG}, parts AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, scheme, host, scheme || '://' || host AS site, CASE WHEN p = '' THEN '/' ELSE p END AS p, q, page_id * 2654435761 % 4294967296 AS a FROM pg),
      folders AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS dir FROM parts)
      SELECT page_id, unnest(range(0, 12)) AS kind, unnest([
        site || regexp_replace(dir, '[^/]+/$', '') || 'x%20y?a%20b#' || n, site || p || '?k=' || n || '&v={{a}}^%27', site || p || q || '#%C3%A9', scheme || '://host' || n || '.example' || CASE WHEN scheme = 'http' THEN '' ELSE ':80' END || '/a/b',
        CASE WHEN scheme = 'http' THEN site || dir || 'rel' ELSE 'http://rel/' END, 'https://User@h' || n || '.example/', scheme || '://' || concat_ws('.', a // 16777216, a // 65536 % 256, a // 256 % 256, a % 256) || '/', NULL, 'mailto:A B@' || n,
        CASE WHEN page_id * 7 <= 65535 THEN scheme || '://x' || CASE WHEN page_id * 7 = CASE WHEN scheme = 'http' THEN 80 ELSE 443 END THEN '' ELSE ':' || page_id * 7 END || '/' END, site || dir || '/%C3%BC|%5E' || n, scheme || '://xn--mnchen-3ya.example/' || n]) AS resolved FROM folders""",
    "address_ranges": f"""WITH {_values("nets", "i, net", [(i, n) for i, n in enumerate(addresses.NOT_PUBLIC) if "." in n])},
      parsed AS (SELECT string_split(split_part(net, '/', 1), '.') AS o, CAST(split_part(net, '/', 2) AS INTEGER) AS bits FROM nets),
      ranges AS (SELECT lo, lo + CAST(pow(2, 32 - bits) AS BIGINT) - 1 AS hi FROM (SELECT ((CAST(o[1] AS BIGINT) * 256 + CAST(o[2] AS BIGINT)) * 256 + CAST(o[3] AS BIGINT)) * 256 + CAST(o[4] AS BIGINT) AS lo, bits FROM parsed)),
      whole AS (SELECT lo, hi FROM ranges WHERE lo <> 4026531840), joined AS (SELECT lo, CASE WHEN lo = 3758096384 THEN 4294967295 ELSE hi END AS hi FROM whole),
      edges AS (SELECT list(x ORDER BY lo, k) AS e FROM (SELECT lo, unnest([lo - 1, lo, hi, hi + 1]) AS x, generate_subscripts([1, 2, 3, 4], 1) AS k FROM joined) WHERE x BETWEEN 0 AND 4294967295),
      made AS (SELECT page_id, page_id % 8 AS s, CASE WHEN page_id % 2 = 0 THEN page_id * 2654435761 % 4294967296 ELSE e[CAST(page_id // 2 % len(e) AS INTEGER) + 1] END AS a FROM pages, edges),
      bytes AS (SELECT *, a // 16777216 AS b0, a // 65536 % 256 AS b1, a // 256 % 256 AS b2, a % 256 AS b3, concat_ws('.', a // 16777216, a // 65536 % 256, a // 256 % 256, a % 256) AS dotted, printf('%x:%x', a // 65536, a % 65536) AS halves FROM made)
      SELECT page_id, CASE s WHEN 0 THEN dotted WHEN 1 THEN CAST(a AS VARCHAR) WHEN 2 THEN printf('0x%X', a) WHEN 3 THEN '0' || ltrim(CAST(b0 // 64 * 100 + b0 // 8 % 8 * 10 + b0 % 8 AS VARCHAR)) || '.' || CAST(a % 16777216 AS VARCHAR)
        WHEN 4 THEN '[::ffff:' || dotted || ']' WHEN 5 THEN '::FFFF:' || halves WHEN 6 THEN '64:ff9b::' || dotted ELSE '2606:4700::' || halves END AS host,
        CASE s WHEN 6 THEN true WHEN 7 THEN false ELSE EXISTS (SELECT 1 FROM ranges WHERE a BETWEEN lo AND hi) END AS private FROM bytes""",
    "robots_verdicts": f"WITH {_RULES}, {_judged(f'SELECT page_id || agent AS id, page_id, agent, {_PATH} FROM pg, (SELECT unnest([{_AGENTS}]) AS agent)')} SELECT page_id, agent, allowed, matched_agent FROM judged",
    "robots_longest_match": f"WITH {_RULES}, " + _judged(f"SELECT page_id AS id, page_id, 'ClaudeBot' AS agent, {_PATH} FROM pg") + " SELECT page_id, matched_type, matched_path FROM judged",
    "crawler_access_by_purpose": f"WITH {_RULES}, {_CRAWLERS}, flags AS (SELECT i, bool_or(agent = 'applebot') AS apple, bool_or(agent = 'googlebot') AS google FROM agents GROUP BY i), "
    + _judged("SELECT origin || ' ' || token AS id, origin, '/' AS path, purpose, CASE WHEN token = 'Applebot' AND NOT coalesce(apple, false) AND coalesce(google, false) THEN 'Googlebot' ELSE token END AS agent FROM robots LEFT JOIN flags USING (i), crawlers WHERE NOT deprecated")
    + " SELECT purpose, count(*) FILTER (allowed) AS allowed_count, count(*) FILTER (NOT allowed) AS blocked_count FROM judged GROUP BY purpose",
    "sitemap_lastmod_stats": f"""WITH {_PG}, e AS (SELECT 'https://' || host || '/sitemap.xml' AS sitemap_url, page_id % 7 = 3 OR page_id % 11 = 5 AS elsewhere, CASE page_id % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN 'last week'
      WHEN 2 THEN '2023-05-05T' || lpad(CAST(page_id % 24 AS VARCHAR), 2, '0') || ':30:00Z' END AS lastmod FROM pg),
      t AS (SELECT *, try_cast(replace(replace(lastmod, 'T', ' '), 'Z', '') AS TIMESTAMP) AS tm FROM e),
      s AS (SELECT sitemap_url, count(*) AS url_count, count(lastmod) AS with_lastmod, least(20, count(*) FILTER (lastmod = 'last week')) AS invalid_lastmod, least(20, count(*) FILTER (elsewhere)) AS off_origin,
        strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS newest_lastmod, strftime(min(tm), '%Y-%m-%d %H:%M:%S') AS oldest_lastmod FROM t GROUP BY sitemap_url)
      SELECT *, CAST(40 + CASE WHEN length(sitemap_url) % 2 = 0 THEN 10 ELSE 0 END + 15 + floor(20 * (with_lastmod / url_count) + 0.5) + CASE WHEN off_origin = 0 THEN 5 ELSE 0 END AS INTEGER) AS sitemap_score FROM s""",
    "redirect_loops": f"WITH {_PG} SELECT page_id, CAST(page_id % 5 AS INTEGER) AS hop_count, len(list_distinct(list_transform(range(page_id % 5), lambda i: i % 3))) < page_id % 5 AS has_loop, false AS https_upgrade, page_id % 5 > 1 AS has_temporary_redirect FROM pg",
    "host_variants": f"""WITH {_PG}, d AS (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS domain FROM pg), v AS (SELECT domain, pre, length(domain) % 3 AS kind FROM d, (VALUES ('http://'), ('https://'), ('http://www.'), ('https://www.')) AS t(pre)),
      f AS (SELECT domain, pre, CASE kind WHEN 0 THEN 'https://' || domain || '/' WHEN 1 THEN pre || domain || '/' ELSE 'https://www.' || domain || '/' END AS final, NOT (kind = 2 AND pre = 'http://www.') AS ok FROM v),
      g AS (SELECT domain, count(DISTINCT final) FILTER (ok) AS n, coalesce(bool_and(final LIKE 'https://%') FILTER (ok AND pre LIKE 'http://%'), false) AS forces_https, count(*) FILTER (NOT ok) AS unreachable FROM f GROUP BY domain)
      SELECT domain, CAST(n AS INTEGER) AS endpoints, n = 1 AS converges, forces_https, unreachable, CAST(CASE WHEN n = 1 THEN 60 ELSE 0 END + CASE WHEN forces_https THEN 30 ELSE 0 END + 10 AS INTEGER) AS host_score FROM g""",
    "hreflang_reciprocity": f"""WITH {_PG}, n AS (SELECT page_id, {_NORMAL} AS u FROM pg), l AS (SELECT a.page_id, a.u AS src, b.u AS dst FROM n a JOIN n b ON b.page_id = xor(a.page_id, 1) WHERE a.page_id % 3 <> 0)
      SELECT page_id, src = dst AS is_self, CASE WHEN src <> dst THEN EXISTS (SELECT 1 FROM l r WHERE r.src = l.dst AND r.dst = l.src) END AS reciprocates FROM l""",
    "schema_missing_required": f"""WITH {_numbered("ld", LD)}, {_REQUIRED}, {_REC}, m AS (SELECT page_id, body, json_extract_string(body, '$."@type"') AS type FROM pages JOIN ld ON page_id % {len(LD)} = i),
      x AS (SELECT page_id, m.type, list_filter(string_split(r.props, ','), lambda p: NOT list_contains(json_keys(body), p)) AS missing, len(list_filter(string_split(c.props, ','), lambda p: NOT list_contains(json_keys(body), p))) AS lacking FROM m JOIN required r USING (type) JOIN recommended c USING (type))
      SELECT page_id, type, array_to_string(missing, ',') AS missing_required, len(missing) = 0 AS valid, CAST(35 + CASE WHEN len(missing) = 0 THEN 25 ELSE 0 END + CASE WHEN lacking = 0 THEN 10 ELSE 0 END AS INTEGER) AS schema_score FROM x""",
    "responses_loaded": """WITH r AS (SELECT page_id, octet_length(encode(html)) AS n, html, page_id % 50 = 7 AS long, page_id % 4 AS k, page_id % 20 = 0 AS bare FROM pages),
      t AS (SELECT page_id, CASE WHEN long THEN 2000000 WHEN k = 1 THEN n + 3 WHEN k = 2 THEN n + 5 WHEN bare THEN 0 ELSE n END AS bytes, long,
        CASE WHEN long THEN html || repeat('x', 2000000 - n) WHEN k = 2 THEN html || chr(65533) || 'é' || chr(65533) WHEN bare THEN '' ELSE html END AS txt FROM r)
      SELECT page_id, CAST(bytes AS BIGINT) AS bytes, long AS truncated, md5(txt) AS html_md5, 'b=2' AS cookie, CASE WHEN page_id % 3 = 0 THEN 'noarchive, NOINDEX' ELSE 'noarchive' END AS x_robots_tag, 'text/html; charset=UTF-8' AS content_type, page_id % 3 <> 0 AS indexable, '' AS causes FROM t""",
    "external_domains": f"""WITH {_PG}, h AS (SELECT a.page_id, a.host, b.host AS nh FROM pg a LEFT JOIN pg b ON b.page_id = a.page_id + 1),
      e AS (SELECT page_id, 'cdn.example' AS domain, 1 AS n, 0 AS pos FROM h UNION ALL SELECT page_id, nh, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END, 1 FROM h WHERE nh IS NOT NULL AND nh <> host)
      SELECT page_id, domain, CAST(n AS BIGINT) AS "count", CAST(row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) AS INTEGER) AS "rank" FROM e""",
    "microdata_items": f"""WITH {_values("ruled", "i, type, required, recommended", [(i, t, ",".join(r[0]), ",".join(r[1])) for i, (t, r) in enumerate(fixed.SCHEMA_RULES.items())])},
      named AS (SELECT i, type, list_filter(string_split(required, ','), lambda p: p <> '') AS req, list_filter(string_split(recommended, ','), lambda p: p <> '') AS rec FROM ruled),
      given AS (SELECT page_id, type, req, rec, list_distinct(list_concat(req, rec)[1:page_id % 7]) AS props FROM pages JOIN named ON page_id % {len(fixed.SCHEMA_RULES)} = i),
      items AS (SELECT page_id, type, req, rec, props FROM given UNION ALL SELECT page_id, 'Thing', [], [], list_append(props, 'extra') FROM given WHERE page_id % 3 = 0)
      SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS microdata_items, CAST(page_id % 4 AS INTEGER) AS rdfa_items, 'microdata' AS format, type, array_to_string(list_sort(props), ',') AS properties,
        array_to_string(list_sort(list_filter(req, lambda p: NOT list_contains(props, p))), ',') AS missing_required, array_to_string(list_sort(list_filter(rec, lambda p: NOT list_contains(props, p))), ',') AS missing_recommended,
        len(list_filter(req, lambda p: NOT list_contains(props, p))) = 0 AS valid FROM items""",
    "splice_findings": f"""WITH {_numbered("heads", HEADS)}, {_numbered("bodies", BODIES)}, t AS (SELECT page_id, h.body AS head, regexp_extract_all(b.body, '<img[^>]*>') AS imgs, regexp_extract_all(h.body, 'property="([^"]*)"', 1) AS og FROM pages JOIN heads h ON page_id % {len(HEADS)} = h.i JOIN bodies b ON page_id % {len(BODIES)} = b.i),
      c AS (SELECT *, len(imgs) AS n, len(list_filter(imgs, lambda g: NOT contains(g, ' alt='))) AS a, len(list_filter(imgs, lambda g: NOT contains(g, ' width='))) AS d, len(list_filter(imgs, lambda g: regexp_matches(g, '\\.(webp|avif)"'))) AS m, len(list_filter(imgs, lambda g: contains(g, 'lazy'))) AS z FROM t)
      SELECT page_id, concat_ws(',', {", ".join(f"CASE WHEN list_contains(og, '{k}') THEN 'pass:{k.replace(':', '_')}_present' ELSE '{'fail' if k == 'og:image' else 'warn'}:{k.replace(':', '_')}_missing' END" for k in fixed.OG_POINTS)}, CASE WHEN contains(head, 'twitter:card') THEN 'pass:twitter_card_present' ELSE 'warn:twitter_card_missing' END) AS social_codes,
        concat_ws(',', CASE WHEN n = 0 THEN 'info:images_none' WHEN a = 0 THEN 'pass:alt_complete' ELSE 'fail:alt_missing' END, CASE WHEN n > 0 AND d = 0 THEN 'pass:dimensions_complete' WHEN d > 0 THEN 'warn:dimensions_missing' END,
          CASE WHEN n > 0 AND m > 0 THEN 'pass:modern_formats' WHEN n > 0 THEN 'warn:legacy_formats' END, CASE WHEN z > 0 THEN 'pass:lazy_loading' WHEN n > 5 THEN 'warn:lazy_loading_absent' END) AS image_codes FROM c""",
    "image_alt_score": f"""WITH {_numbered("bodies", BODIES)}, t AS (SELECT page_id, regexp_extract_all(body, '<img[^>]*>') AS imgs FROM pages JOIN bodies ON page_id % {len(BODIES)} = i),
      c AS (SELECT page_id, len(imgs) AS n, len(list_filter(imgs, lambda g: NOT contains(g, ' alt='))) AS a, len(list_filter(imgs, lambda g: NOT contains(g, ' width='))) AS d, len(list_filter(imgs, lambda g: regexp_matches(g, '\\.(webp|avif)"'))) AS m, len(list_filter(imgs, lambda g: contains(g, 'lazy'))) AS z FROM t)
      SELECT page_id, CAST(n AS INTEGER) AS total_images, CAST(a AS INTEGER) AS missing_alt, CAST(d AS INTEGER) AS missing_dimensions,
        CAST(CASE WHEN n = 0 THEN 100 ELSE floor(45 * (1 - a / n) + 0.5) + floor(25 * (1 - d / n) + 0.5) + CASE WHEN m > 0 THEN 20 ELSE 0 END + CASE WHEN z > 0 THEN 10 ELSE 0 END END AS INTEGER) AS image_score FROM c""",
    "social_score": f"""WITH {_numbered("heads", HEADS)}, t AS (SELECT page_id, body, list_sort(regexp_extract_all(body, 'property="([^"]*)"', 1)) AS og FROM pages JOIN heads ON page_id % {len(HEADS)} = i)
      SELECT page_id, array_to_string(og, ',') AS open_graph, CAST({" + ".join(f"CASE WHEN list_contains(og, '{k}') THEN {v} ELSE 0 END" for k, v in (fixed.OG_POINTS | {"og:site_name": 5}).items())} + CASE WHEN contains(body, 'twitter:card') THEN 10 ELSE 0 END AS INTEGER) AS social_score FROM t""",
    "llms_sections": f"""WITH {_numbered("files", LLMS)}, {_PG}, s AS (SELECT DISTINCT scheme || '://' || host AS origin FROM pg), f AS (SELECT origin, CASE WHEN length(origin) % 11 <> 0 AND body <> '' THEN body END AS b FROM s JOIN files ON length(origin) % {len(LLMS)} = i),
      x AS (SELECT origin, b IS NOT NULL AS found, nullif(regexp_extract(b, '(?m)^#[ \\t]+(.+)$', 1), '') AS title, nullif(regexp_extract(b, '(?m)^>[ \\t]*(.+)$', 1), '') AS summary, coalesce(regexp_extract_all(b, '(?m)^##[ \\t]+(.+)$', 1), []) AS sec,
        coalesce(len(regexp_extract_all(b, '(?m)^[ \\t]*[-*][ \\t]*\\[[^\\]]*\\]\\([^)]*\\)')), 0) AS n FROM f)
      SELECT origin, found, title, summary, array_to_string(sec, ',') AS sections, CAST(n AS INTEGER) AS link_count, list_contains(list_transform(sec, lambda s: lower(s)), 'optional') AS has_optional FROM x""",
    "sitemap_lifecycle": f"""WITH {_PG}, {_values("told", "k, place, via, status, found, kind, n, followed, score, findings", _LIFE)}, s AS (SELECT DISTINCT scheme || '://' || host AS origin FROM pg),
      j AS (SELECT origin, told.* FROM s JOIN told ON k = CASE WHEN length(origin) % {len(ROBOTS)} = 1 THEN 9 ELSE length(origin) % 5 END)
      SELECT origin, CASE WHEN k = 9 THEN place ELSE origin || place END AS sitemap_url, via, CAST(status AS INTEGER) AS status, found, kind, CAST(n AS BIGINT) AS url_count, CAST(followed AS BIGINT) AS followed, CAST(score AS INTEGER) AS sitemap_score, findings FROM j""",
    "redirect_chains": f"""WITH RECURSIVE {_PG}, nodes AS (SELECT page_id AS n, regexp_replace(url, '#.*$', '') || '/~' || page_id AS url FROM pg),
      edges AS (SELECT a.n, a.url, CASE WHEN a.n % 60 >= 40 AND a.n % 60 < 58 THEN a.n + 1 WHEN a.n % 4 = 0 THEN NULL WHEN a.n % 12 = 11 THEN a.n - 2 WHEN a.n % 30 = 13 THEN -1 ELSE a.n + 1 END AS nxt FROM nodes a),
      log AS (SELECT e.url, CASE WHEN e.nxt = -1 THEN 'https://gone.example/' || e.n ELSE t.url END AS target, e.n % 3 = 1 AS temporary FROM edges e LEFT JOIN nodes t ON t.n = e.nxt),
      walk(start, here, path, temporary, hops, looped) AS (SELECT url, url, [url], false, 0, false FROM log
        UNION ALL SELECT w.start, l.target, list_append(w.path, l.target), w.temporary OR l.temporary, hops + 1, list_contains(w.path, l.target) FROM walk w JOIN log l ON l.url = w.here WHERE l.target IS NOT NULL AND NOT w.looped AND hops < 10),
      last AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS r FROM walk)
      SELECT start AS url, here AS final_url, hops AS hop_count, CASE WHEN looped THEN 'loop' WHEN EXISTS (SELECT 1 FROM log l WHERE l.url = here AND l.target IS NOT NULL) THEN 'too_many' WHEN EXISTS (SELECT 1 FROM log l WHERE l.url = here) THEN 'final' ELSE 'unknown' END AS outcome,
        temporary AS has_temporary_redirect FROM last WHERE r = 1""",
    "rejected_pages": """WITH c AS (SELECT page_id, concat_ws(',', CASE WHEN page_id % 9 = 1 THEN 'http_404' WHEN page_id % 9 = 4 THEN 'http_503' END,
        CASE WHEN page_id % 13 <> 6 AND (page_id % 5 = 2 OR page_id % 5 = 3 AND page_id % 17 = 8) THEN 'not_html' END, CASE WHEN page_id % 13 = 6 THEN 'no_body' END) AS causes FROM pages)
      SELECT page_id, CASE WHEN causes = '' THEN 'too_deep' ELSE causes END AS causes FROM c WHERE causes <> '' OR page_id % 17 = 8""",
    "hreflang_report": f"""WITH {_numbered("heads", ALTERNATES)}, t AS (SELECT page_id, list_transform(regexp_extract_all(body, 'hreflang="([^"]*)"', 1), lambda x: trim(x)) AS c FROM pages JOIN heads ON page_id % {len(ALTERNATES)} = i),
      x AS (SELECT page_id, len(c) AS n, list_contains(list_transform(c, lambda v: lower(v)), 'x-default') AS d, list_filter(c, lambda v: NOT regexp_matches(v, '(?i)^[a-z]{{2,3}}(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?$') AND lower(v) <> 'x-default') AS bad,
        list_distinct(list_filter(list_transform(c, lambda v: lower(v)), lambda v: len(list_filter(c, lambda u: lower(u) = v)) > 1)) AS dup, page_id % {len(ALTERNATES)} = 0 AND regexp_matches(url, '^[a-z]+://[^/]*/?(#.*)?$') AS self FROM t JOIN pages USING (page_id))
      SELECT page_id, CAST(n AS BIGINT) AS alternates, d AS has_x_default, array_to_string(dup, ',') AS duplicate_codes, array_to_string(bad, ',') AS invalid_codes,
        concat_ws(',', CASE WHEN n = 0 THEN 'info:hreflang_none' ELSE 'pass:hreflang_found' END, CASE WHEN n > 0 AND NOT self THEN 'fail:self_reference_missing' WHEN self THEN 'pass:self_reference' END,
          CASE WHEN n > 0 AND NOT d THEN 'warn:x_default_missing' WHEN d THEN 'pass:x_default' END, CASE WHEN len(dup) > 0 THEN 'fail:duplicate_codes' END, CASE WHEN len(bad) > 0 THEN 'fail:invalid_codes' END) AS findings FROM x""",
    "meta_directives": f"""WITH {_numbered("heads", DIRECTIVES)}, t AS (SELECT page_id, nullif(trim(regexp_extract(body, '(?s)<title>(.*?)</title>', 1), {_WHITE}), '') AS title, nullif(trim(regexp_extract(body, '(?s)name="description" content="([^"]*)"', 1), {_WHITE}), '') AS description,
        list_filter(list_transform(string_split(lower(regexp_extract(body, '(?s)name="robots" content="([^"]*)"', 1)), ','), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS d FROM pages JOIN heads ON page_id % {len(DIRECTIVES)} = i)
      SELECT page_id, title, CAST(coalesce(length(title), 0) AS INTEGER) AS title_length, description, CAST(coalesce(length(description), 0) AS INTEGER) AS description_length, array_to_string(d, ',') AS directives,
        NOT list_has_any(d, ['noindex', 'none']) AS indexable, NOT list_has_any(d, ['nofollow', 'none']) AS followable FROM t""",
}
_REPORTS = SQL["robots_reports"]
SQL["seo_robots_section"] = f"""WITH {_RULES}, {_CRAWLERS}, flags AS (SELECT i, bool_or(agent = 'applebot') AS apple, bool_or(agent = 'googlebot') AS google FROM agents GROUP BY i),
  paths AS (SELECT DISTINCT {_PATH} FROM pg), """ + _judged(
    "SELECT origin || ' ' || path || ' ' || token AS id, origin, path, token, ordinal, CASE WHEN token = 'Applebot' AND NOT coalesce(apple, false) AND coalesce(google, false) THEN 'Googlebot' ELSE token END AS agent FROM paths JOIN robots USING (origin) LEFT JOIN flags USING (i), crawlers WHERE NOT deprecated AND purpose = 'search'"
) + f""", b AS (SELECT origin, path, coalesce(string_agg(token, ',' ORDER BY ordinal) FILTER (NOT allowed), '') AS blocked FROM judged GROUP BY origin, path),
  rep AS ({_REPORTS}), f AS (SELECT origin, robots_score, blocks_everything, string_split(findings, ',') AS l FROM rep),
  g AS (SELECT origin, robots_score, blocks_everything, list_concat(list_filter(l, lambda x: x LIKE 'fail:%'), list_filter(l, lambda x: x LIKE 'warn:%'))[1:3] AS worst FROM f)
  SELECT page_id, CAST(robots_score AS INTEGER) AS robots_score, {'CASE WHEN robots_score >= 90 THEN ' + repr('A') + ' WHEN robots_score >= 80 THEN ' + repr('B') + ' WHEN robots_score >= 70 THEN ' + repr('C') + ' WHEN robots_score >= 60 THEN ' + repr('D') + ' ELSE ' + repr('F') + ' END'} AS robots_grade,
    array_to_string(list_transform(worst, lambda x: substr(x, 6)), ',') AS issues, CASE WHEN blocked = '' THEN 25 ELSE 0 END AS crawler_access, blocks_everything AS advises_unblocking, blocked AS blocked_search
  FROM (SELECT page_id, {_PATH} FROM pg) p JOIN b USING (origin, path) JOIN g USING (origin)"""
