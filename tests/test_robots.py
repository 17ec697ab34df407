import re

import pytest

from crawlgauge.functions import fixed
from crawlgauge.operators import robots as R

#: body, status, agent, path, allowed: the rules of RFC 9309 (2.2.1 groups, 2.2.2 longest match, 2.2.3 special characters, 2.3.1 access results).
CASES = [
    ("User-Agent: shopbot\nDisallow: /cart\nAllow: /cart/help\n", 200, "ShopBot", "/cart/help/returns", True),
    ("User-Agent: shopbot\nDisallow: /cart\nAllow: /cart/help\n", 200, "ShopBot", "/cart/item", False),
    ("User-Agent: shopbot\nAllow: /cart/help\nDisallow: /cart\n", 200, "shopbot", "/cart/help", True),
    ("User-Agent: newsbot\nDisallow: /draft\nAllow: /draft\n", 200, "newsbot", "/draft", True),
    ("User-Agent: newsbot\nDisallow: /draft\n", 200, "otherbot", "/draft", True),
    ("User-Agent: *\nDisallow: /tmp\n\nUser-Agent: newsbot\nDisallow: /old\n", 200, "newsbot", "/tmp/1", True),
    ("User-Agent: *\nDisallow: /tmp\n\nUser-Agent: newsbot\nDisallow: /old\n", 200, "otherbot", "/tmp/1", False),
    ("User-Agent: mapbot\nDisallow: /en\n\nUser-Agent: *\nDisallow: /\n\nUser-Agent: mapbot\nDisallow: /fr\n", 200, "mapbot", "/fr/x", False),
    ("User-Agent: mapbot\nUser-Agent: newsbot\n\n\nDisallow: /shared\n", 200, "newsbot", "/shared", False),
    ("User-Agent: *\nDisallow: /\nAllow: /$\n", 200, "mapbot", "/", True),
    ("User-Agent: *\nDisallow: /\nAllow: /$\n", 200, "mapbot", "/index", False),
    ("User-Agent: *\nDisallow: /*/print\n", 200, "mapbot", "/2020/05/print?x", False),
    ("User-Agent: *\nDisallow: *.gif$\n", 200, "mapbot", "/pic.gif?big", True),
    ("User-Agent: mapbot\nDisallow:\n", 200, "mapbot", "/any", True),
    ("User-Agent: mapbot # ours\r\nDisallow: /box # closed\r\n", 200, "mapbot", "/box", False),
    ("Disallow: /lost\nUser-Agent: mapbot\nDisallow: /found\n", 200, "mapbot", "/lost", True),
    ("User-Agent: *\nDisallow: /\n", 404, "mapbot", "/x", True), ("User-Agent: *\nDisallow: /\n", 410, "mapbot", "/x", True),
    ("User-Agent: *\nAllow: /\n", 500, "mapbot", "/x", False), ("User-Agent: *\nDisallow: /\n", 403, "mapbot", "/x", False),
]
#: pattern, path, whether it matches: own cases, one or two to each rule, and a pattern that a backtracking matcher would try for long.
PATTERNS = [
    ("/shop", "/shopping", True), ("/shop", "/Shop", False), ("/shop/$", "/shop/", True), ("/shop/$", "/shop/1", False), ("/*sale", "/x/y/sale9", True), ("/*sale", "/x/y/sa", False),
    ("/q*=1*&z", "/q?x=1&y&z=2", True), ("/q*=1*&z", "/q?z&x=1", False), ("*", "/", True), ("*end$", "/the/end", True), ("*end$", "/the/end/", False), ("/m*", "/m", True), ("/k***l", "/kl", True),
    ("/pp*ppq$", "/pppq", False), ("/pp*ppq$", "/ppppq", True), ("/" + "*01" * 12 + "2", "/" + "01" * 900, False),
]


def test_verdicts(spark):
    robots = spark.createDataFrame([(f"https://s{i}.example", c[1], c[0]) for i, c in enumerate(CASES)], "origin string, status int, body string")
    asked = spark.createDataFrame([(f"https://s{i}.example", c[2], c[3], i) for i, c in enumerate(CASES)], "origin string, agent string, path string, i int")
    got = {r["i"]: r["allowed"] for r in R.verdicts(asked, robots).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}


def test_repeated_questions_are_answered_each(spark):
    robots = spark.createDataFrame([("o", 200, "User-Agent: *\nDisallow: /x\nDisallow: /")], "origin string, status int, body string")
    asked = spark.createDataFrame([("o", "a", "/x")] * 3 + [("p", "a", "/x")] * 2, "origin string, agent string, path string")
    got = R.verdicts(asked, robots).collect()
    assert len(got) == 5 and sorted((r["origin"], r["allowed"], r["matched_path"]) for r in got)[0] == ("o", False, "/x")


def test_many_rules_are_probed_by_prefix(spark):
    """3,000 rules of one host: answers of brute force, and few rules met by each path."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    part = lambda: rng.choice("abcd") + str(rng.randrange(12))
    listed = [(rng.choice(["allow", "disallow"]), "/" + "/".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "$", "/*", "*.x$", "/*/b1"])) for _ in range(3000)] + [("allow", "/*.png$"), ("disallow", "*q=1"), ("disallow", "/")]
    body = "User-agent: one\n" + "\n".join(f"{k}: {p}" for k, p in listed) + "\nUser-agent: *\nDisallow: /a"
    robots = spark.createDataFrame([("o", 200, body)], "origin string, status int, body string")
    paths = ["/" + "/".join(part() for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".x", ".png", "?q=1", "/"]) for _ in range(300)] + ["/", "", "/é"]
    asked = spark.createDataFrame([("o", a, p) for p in paths for a in ("One", "two", "three")], "origin string, agent string, path string")

    def fits(pattern, path):
        bare = pattern[:-1] if pattern.endswith("$") else pattern
        parts = [re.escape(x) for x in bare.split("*")]
        return re.match(".*".join(parts) + ("$" if pattern.endswith("$") else ""), path)

    def judge(rules, path):
        hits = [(len(p), k == "allow", -i) for i, (k, p) in enumerate(rules) if fits(p, path)]
        return max(hits)[1] if hits else True

    got = R.verdicts(asked, robots).collect()
    assert len(got) == len(paths) * 3
    for r in got:
        assert r["allowed"] == judge(listed if r["agent"] == "One" else [("disallow", "/a")], r["path"]), (r["agent"], r["path"])
    index = R.rule_index(robots).where("agent = 'one'")
    met = spark.createDataFrame([(p,) for p in paths], "path string").join(index, F.expr("substring(path, 1, length(prefix)) = prefix"))
    assert index.count() == len(listed) and met.count() < len(paths) * 60


def test_names_of_asked_columns_do_not_clash(spark):
    robots = spark.createDataFrame([("o", 200, "User-agent: *\nDisallow: /x"), ("o", 503, None)], "origin string, status int, body string")
    asked = spark.createDataFrame([("o", "a", "/x", 1, "p"), ("o", "a", None, 2, "p"), (None, "a", "/x", 3, "p"), ("o", None, "/x", 4, "p")], "origin string, agent string, path string, lengths int, prefix string")
    got = {r["lengths"]: (r["allowed"], r["matched_path"], r["prefix"]) for r in R.verdicts(asked, robots).collect()}
    assert got == {1: (False, "/x", "p"), 2: (True, None, "p"), 3: (True, None, "p"), 4: (False, "/x", "p")}


def test_only_the_first_bytes_count(spark):
    body = "#" + "é" * ((R.READ_BYTES + 20) // 2) + "\nUser-Agent: *\nDisallow: /far"
    robots = spark.createDataFrame([("o", 200, body)], "origin string, status int, body string")
    assert R.rules(robots).count() == 0 and len(body) < R.READ_BYTES


def test_report_findings_and_vendors(spark):
    noise = "\n".join(["junk"] * 120)
    bodies = [(0, 200, "User-Agent: *\nDisallow: /\nCrawl-delay: 4\nSitemap: https://a.example/s.xml"), (1, 404, "x"), (2, 503, ""), (3, 200, noise)]
    robots = spark.createDataFrame([(f"s{i}", s, b) for i, s, b in bodies], "origin string, status int, body string")
    got = {r["origin"]: [(f["severity"], f["code"]) for f in r["robots_findings"]] for r in R.site_report(robots).collect()}
    assert got["s0"] == [("pass", "robots_found"), ("fail", "blocks_everything"), ("pass", "sitemap_declared"), ("info", "crawl_delay")]
    assert got["s1"] == [("warn", "robots_absent"), ("warn", "sitemap_undeclared")] and got["s2"] == [("fail", "robots_failed"), ("warn", "sitemap_undeclared")]
    assert got["s3"].count(("warn", "no_colon")) == 100 and got["s3"][-1] == ("warn", "more_warnings")
    access = R.crawler_access(spark.createDataFrame([("s0", "/"), ("s3", "/")], "origin string, path string"), robots)
    by = {r["origin"]: [f["code"] for f in r["crawler_findings"]] for r in R.access_summary(access).collect()}
    assert by == {"s0": ["crawlers_blocked", "search_crawlers_blocked", "blocks_unenforceable"], "s3": ["all_crawlers_allowed", "training_crawlers_allowed"]}
    vendors = R.by_vendor(access).where("origin = 's0'").collect()
    assert sum(len(v["crawlers"]) for v in vendors) == 35 and not any(c["allowed"] for v in vendors for c in v["crawlers"])


def test_patterns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "i int, pattern string, path string, expected boolean")
    got = rows.withColumn("m", R.matches(F.col("pattern"), F.col("path"))).where("m <> expected").collect()
    assert got == []


def test_groups_sitemaps_and_warnings(spark):
    body = "Disallow: /early\nSitemap: https://a.example/s.xml\nUser-agent: a\n\nUser-agent: b\nCrawl-delay: 2.5x\nDisallow: /1\nnonsense\nfoo: bar\nUser-agent:\nUser-agent: c\nAllow: /"
    robots = spark.createDataFrame([("o", 200, body)], "origin string, status int, body string")
    rules = {(r["agent"], r["group_id"], r["type"], r["path"], r["crawl_delay"]) for r in R.rules(robots).collect()}
    assert rules == {("a", 1, "disallow", "/1", 2.5), ("b", 1, "disallow", "/1", 2.5), ("c", 2, "allow", "/", None)}
    assert [r["url"] for r in R.sitemaps(robots).collect()] == ["https://a.example/s.xml"]
    assert sorted(r["code"] for r in R.warnings(robots).collect()) == ["empty_agent", "no_colon", "rule_before_agent", "unknown_field"]
    report = R.site_report(robots).first()
    assert (report["found"], report["group_count"], report["sitemap_count"], report["blocks_everything"], report["robots_score"]) == (True, 2, 1, False, 100)


def test_crawlers(spark):
    rows = fixed.crawler_rows()
    assert len(rows) == 37 and sum(r[6] for r in rows) == 2
    purposes = {}
    for r in rows:
        purposes[r[3]] = purposes.get(r[3], 0) + 1
    assert purposes == {"training": 12, "search": 9, "user-fetch": 8, "scraping": 3, "ads": 2, "opt-out-control": 2, "preview": 1}
    bodies = ["User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /", "User-agent: OAI-SearchBot\nDisallow: /", "User-agent: *\nDisallow: /", "User-agent: Googlebot\nDisallow: /"]
    robots = spark.createDataFrame([(f"s{i}", 200, b) for i, b in enumerate(bodies)], "origin string, status int, body string")
    sites = robots.selectExpr("origin", "'/' AS path")
    access = R.crawler_access(sites, robots)
    assert access.where("origin = 's0'").count() == 35 and R.crawler_access(sites, robots, True).where("origin = 's0'").count() == 37
    by = {r["origin"]: r for r in R.access_summary(access).collect()}
    assert by["s0"]["blocked_citation_critical"] == [] and by["s0"]["blocked_count"] == 2
    assert by["s1"]["blocked_citation_critical"] == ["OAI-SearchBot"]
    assert "Perplexity-User" in by["s2"]["unenforceable_blocks"] and by["s2"]["allowed_count"] == 0
    assert by["s3"]["blocked_citation_critical"] == ["Googlebot", "Applebot"]


@pytest.mark.parametrize("body", [None, ""])
def test_no_rules_allow(spark, body):
    robots = spark.createDataFrame([("o", 200, body)], "origin string, status int, body string")
    asked = spark.createDataFrame([("o", "GPTBot", "/")], "origin string, agent string, path string")
    assert R.verdicts(asked, robots).first()["allowed"] is True
