"""Redirect chains over a log, probes, loads with rejects, and white space of all kinds."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from crawlgauge.functions import text
from crawlgauge.operators import onpage, probes, redirects, robots, sitemaps
from crawlgauge.plans import audits
from crawlgauge.sources import pages as src


def walked(log, start, most):
    """(final_url, hops, outcome, temporary) of one URL, hop by hop."""
    here, seen, temporary = start, [start], False
    while True:
        if here not in log:
            return here, len(seen) - 1, "unknown", temporary
        status, target = log[here]
        if status not in redirects.REDIRECTS or target is None:
            return here, len(seen) - 1, "final", temporary
        if len(seen) - 1 == most:
            return here, most, "too_many", temporary
        temporary |= status in redirects.TEMPORARY
        if target in seen:
            return target, len(seen), "loop", temporary
        seen.append(target)
        here = target


def test_redirect_chains(spark):
    """Chains of all lengths around the limit, loops of all sizes, tails into loops, and many chains into one URL."""
    u = lambda k: f"https://a.example/{k}"
    log = {}
    for n in (0, 1, 2, 9, 10, 11, 12, 20):
        for i in range(n):
            log[u(f"c{n}-{i}")] = (302 if i == n // 2 else 301, u(f"c{n}-{i + 1}"))
        log[u(f"c{n}-{n}")] = (200, None)
    for n in (1, 2, 3, 10, 11, 15):
        for i in range(n):
            log[u(f"l{n}-{i}")] = (308, u(f"l{n}-{(i + 1) % n}"))
        log[u(f"t{n}-1")], log[u(f"t{n}-0")] = (307, u(f"l{n}-0")), (301, u(f"t{n}-1"))
    log |= {u(f"m{i}"): (301, u("c2-0")) for i in range(50)} | {u("gone"): (301, "https://b.example/"), u("no"): (304, u("c0-0")), u("bare"): (301, None)}
    rows = [(k, s, t if i % 2 or t is None else t.replace("https://a.example", "") + "#f") for i, (k, (s, t)) in enumerate(log.items())]
    rows.append((u("c1-0") + "#again", 301, "/c1-1"))
    got = {r["url"]: r for r in redirects.follow(spark.createDataFrame(rows, "url string, status int, location string").repartition(3)).collect()}
    assert got.keys() == log.keys()
    for url in log:
        r = got[url]
        assert (r["final_url"], r["hop_count"], r["outcome"], r["has_temporary_redirect"]) == walked(log, url, redirects.MOST_HOPS), url
        assert len(r["path"]) == r["hop_count"] + 1 and r["path"][0] == url
    assert redirects.follow(spark.createDataFrame([], "url string, status int, location string")).count() == 0


def test_probe_plan_and_outcomes(spark):
    wanted = spark.createDataFrame([(p, f"https://h.example/{i}#{p}") for i in range(6) for p in range(i + 1)] + [(9, "https://o.example/")], "page_id long, href string")
    plan = [(r["key"], r["pages"]) for r in probes.plan(wanted, 2).orderBy("host", "turn").collect()]
    assert plan == [("https://h.example/5", 6), ("https://h.example/4", 5), ("https://o.example/", 1)]
    log = [("https://h.example/5", 200, 1, "GET"), ("https://h.example/5#x", 404, 2, "GET"), ("https://h.example/4", 405, 3, "HEAD"), ("https://h.example/4", 200, 1, "GET"), ("https://o.example/", 501, 1, "HEAD"), ("https://p.example/", None, 1, "GET")]
    fetches = spark.createDataFrame(log, "url string, status int, fetched_at int, method string")
    assert {r["key"]: r["status"] for r in probes.outcomes(fetches).collect()} == {"https://h.example/5": 404, "https://h.example/4": 200, "https://o.example/": 501, "https://p.example/": None}
    assert {(r["key"], r["method"]) for r in probes.pending(probes.plan(wanted, 3), fetches).collect()} == {("https://o.example/", "GET"), ("https://h.example/3", "HEAD")}


def parsed(spark, *htmls, url="https://example.com/"):
    return src.parse(src.with_http_defaults(spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")))


def test_image_probes(spark):
    """One row a page whatever the columns and however often an image was fetched; a probe without an answer found nothing."""
    html = '<meta property="og:image" content=" /i.png ">'
    fetches = spark.createDataFrame([("https://example.com/i.png", 200), ("https://example.com/i.png#x", 404)], "url string, status int")
    out = onpage.social(parsed(spark, html, "<p>"), fetches)
    assert out.count() == 2
    rows = {r["page_id"]: r for r in out.collect()}
    assert (rows[0]["og_image_status"], rows[0]["og_image_reachable"], rows[1]["og_image_reachable"]) == (404, False, None)
    failed = onpage.social(parsed(spark, html), spark.createDataFrame([("https://example.com/i.png", None)], "url string, status int")).first()
    assert failed["og_image_reachable"] is False and "image_unreachable" in [f["code"] for f in failed["social_findings"]]


def test_failed_links_are_broken(spark):
    sample = onpage.link_sample(onpage.links(parsed(spark, '<a href="/x">x</a><a href="/y">y</a><a href="/z">z</a>')))
    fetches = spark.createDataFrame([("https://example.com/x", None), ("https://example.com/y", 200), ("https://example.com/y#a", 200)], "url string, status int")
    row = onpage.link_status(sample, fetches).first()
    assert (row["checked_count"], row["broken_count"]) == (2, 1)


def test_one_load_two_outputs(spark, tmp_path):
    rows = [(0, 200, "text/html", "<p>a"), (1, 404, "image/png", None), (2, 200, "", "plain"), (3, 200, "text/html", "<div>" * 600), (4, None, None, "<html><p>"), (5, 200, "text/plain", "<!doctype html><p>b")]
    pages = spark.createDataFrame(rows, "page_id long, status int, content_type string, html string").withColumns({"url": F.lit("https://a.example/"), "final_url": F.lit("https://a.example/")})
    counts = Observation()
    accepted, rejected = src.load_both(pages, str(tmp_path / "loaded"), counts)
    assert counts.get == {"pages": 6, "accepted": 2, "too_deep": 1}
    assert sorted(r["page_id"] for r in accepted.collect()) == [0, 5] and [n["tag"] for n in accepted.where("page_id = 0").first()["nodes"]] == ["p"]
    assert {r["page_id"]: r["causes"] for r in rejected.collect()} == {1: ["http_404", "no_body"], 2: ["not_html"], 3: ["too_deep"], 4: ["http_none"]}


def test_white_space_of_all_kinds(spark):
    bodies = ["User-agent:\t*\nDisallow:\t/x", "User-agent: *\nDisallow: /x\t", "﻿User-agent: *\nDisallow: /x", "User-agent : * \r\n Disallow: /x  "]
    table = spark.createDataFrame([(f"s{i}", 200, b) for i, b in enumerate(bodies)], "origin string, status int, body string")
    asked = table.select("origin", F.lit("/x/1").alias("path"), F.lit("anybot").alias("agent"))
    assert {r["allowed"] for r in robots.verdicts(asked, table).collect()} == {False}
    row = onpage.meta_tags(parsed(spark, '<title>\n   A title of some length here ok\n</title><meta name=description content="\n\tfour\n">')).first()
    assert (row["title"], row["title_length"], row["description_length"]) == ("A title of some length here ok", 30, 4)
    assert spark.range(1).select(text.trimmed(F.lit("　\x0b a b "))).first()[0] == "a b"


def test_sitemap_report_compares_hosts(spark):
    entries = spark.createDataFrame([("https://a.example/s.xml", x, None) for x in ("http://a.example/1", "https://b.example/", "no url", "https://a.example/")], "sitemap_url string, loc string, lastmod string")
    sites = spark.createDataFrame([("https://a.example/s.xml", "urlset", "robots.txt"), ("https://a.example/i.xml", "index", "robots.txt")], "sitemap_url string, kind string, via string")
    by = {r["sitemap_url"]: r for r in sitemaps.report(entries, sites).collect()}
    assert (by["https://a.example/s.xml"]["off_origin"], by["https://a.example/s.xml"]["non_https"]) == (2, 1)
    assert "sitemap_empty" not in [f["code"] for f in by["https://a.example/i.xml"]["sitemap_findings"]]


def test_audit_takes_one_robots_file_an_origin_and_lists_its_findings(spark):
    pages = src.with_http_defaults(spark.createDataFrame([(0, "https://a.example/", "<p>x")], "page_id long, url string, html string"))
    files = spark.createDataFrame([("https://a.example", 503, None), ("https://a.example", 200, "User-agent: *\nDisallow: /\nnonsense")], "origin string, status int, body string")
    (row,) = audits.seo_audit(audits.with_site(audits.analysed(pages), files)).collect()
    section = next(s for s in row["sections"] if s["id"] == "robots")
    assert section["issues"] == ["blocks_everything", "sitemap_undeclared", "no_colon"] and row["seo_score"] <= 25
