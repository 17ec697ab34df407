from pyspark.sql import functions as F

from crawlgauge.functions import text, urls
from crawlgauge.operators import hreflang, onpage, structured_data
from crawlgauge.plans import audits
from crawlgauge.sources import html_tree
from crawlgauge.sources import pages as src


def pages(spark, *htmls, url="https://example.com/"):
    rows = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return src.parse(src.with_http_defaults(rows))


def ld(json):
    return f'<html><head><script type="application/ld+json">{json}</script></head><body><main><p>x</p></main></body></html>'


def test_nesting_guard():
    assert html_tree.too_deep("<div>" * 513 + "</div>" * 513)
    assert not html_tree.too_deep("<div>" * 512 + "</div>" * 512)
    assert not html_tree.too_deep("<ul>" + "<li><p>" * 600 + "</ul>")
    assert not html_tree.too_deep("<script>" + "<div>" * 600 + "</script><!--" + "<div>" * 600 + "-->")
    assert not html_tree.too_deep("<div></div>" * 600)


def test_tree():
    nodes = html_tree.build("<ul><li>a<li>b</ul><p>c<div>d</div></p><br><img alt=x>")
    assert [n[2] for n in nodes if n[2] != "#text"] == ["ul", "li", "li", "p", "div", "p", "br", "img"]
    assert html_tree.subtree_text(nodes, 0) == "ab"


def test_rendering(spark):
    words = "alpha beta gamma delta epsilon. " * 40
    got = onpage.rendering(onpage.content(pages(spark, '<body><div id="root"></div><script>x()</script></body>', f"<body><main><h1>t</h1><p>{words}</p></main></body>", f'<body><div id="root"><p>{words}</p></div></body>')))
    rows = {r["page_id"]: r for r in got.select("page_id", "spa_shell_detected", "framework_hint", "renders_without_js", "word_count").collect()}
    assert (rows[0]["spa_shell_detected"], rows[0]["framework_hint"], rows[0]["renders_without_js"]) == (True, "#root", False)
    assert not rows[1]["spa_shell_detected"] and rows[1]["renders_without_js"] and rows[1]["word_count"] > 100
    assert not rows[2]["spa_shell_detected"]


def test_hreflang(spark):
    link = lambda code, href: f'<link rel="alternate" hreflang="{code}" href="{href}">'
    html = "<head>" + link("es", "/es/") + link("en-US", "https://example.com/") + link("x-default", "/") + link("english", "/e") + "</head>"
    alts = hreflang.alternates(pages(spark, html, "<head>" + link("en", "/a") + link("EN", "/b") + "</head>"))
    first = alts.where("page_id = 0").orderBy("pos").collect()
    assert [r["valid_code"] for r in first] == [True, True, True, False] and [r["is_self"] for r in first] == [False, True, True, False]
    assert [(r["page_id"], r["code"], r["n"]) for r in hreflang.duplicate_codes(alts).collect()] == [(1, "en", 2)]


def test_reciprocity(spark):
    link = lambda code, href: f'<link rel="alternate" hreflang="{code}" href="{href}">'
    rows = [(0, "https://a.example/", link("de", "https://a.example/de") + link("fr", "https://a.example/fr") + link("it", "https://a.example/it")), (1, "https://a.example/de/", link("en", "https://a.example/")), (2, "https://a.example/fr", "")]
    parsed = src.parse(src.with_http_defaults(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = {(r["page_id"], r["hreflang"]): r["reciprocates"] for r in hreflang.reciprocity(hreflang.alternates(parsed), parsed).collect()}
    assert got == {(0, "de"): True, (0, "fr"): False, (0, "it"): None, (1, "en"): True}


def test_structured_data(spark):
    htmls = [
        ld('{"@graph": [{"@type": "Organization", "name": "A"}, {"@type": "WebSite", "name": "B", "url": "x"}]}'), ld('{"@type": "Event", "name": "x"}'), ld("{bad"),
        ld('{"@type": "AccountingService", "name": "x", "address": "y"}'), ld('{"@type": ["https://schema.org/Person"], "name": "x"}'), ld('[{"@type": "Person", "name": "a"}, {"@type": "Person", "name": "b"}]'), ld(" "), ld('{"name": 1}'),
        '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">x</span><b itemprop="name">y</b></div><i typeof="x"></i>',
    ]
    rows = {r["page_id"]: r for r in structured_data.structured_data(pages(spark, *htmls)).collect()}
    assert rows[0]["item_count"] == 2 and rows[0]["has_organization"] and rows[0]["has_website"]
    assert rows[1]["items"][0]["missing_required"] == ["startDate", "location"] and not rows[1]["items"][0]["valid"]
    assert rows[2]["parse_errors"] == ["invalid_1"] and rows[2]["item_count"] == 0
    assert rows[3]["has_organization"] and not rows[3]["has_person"]
    assert rows[4]["has_person"] and not rows[4]["has_organization"]
    assert rows[5]["item_count"] == 2 and rows[6]["parse_errors"] == ["empty_1"] and rows[7]["parse_errors"] == ["untyped_1"]
    assert rows[8]["items"][0]["format"] == "microdata" and rows[8]["items"][0]["properties"] == ["name"] and rows[8]["rdfa_items"] == 1


def test_headings(spark):
    rows = onpage.headings(pages(spark, "<h1>a</h1><h2>b</h2><h4>c</h4>", "<h2>What is it</h2><h2>Plain</h2><h2>cómo hacer</h2><h2>Whatever it takes</h2>", "<h1>t</h1><h2> </h2>")).collect()
    by = {r["page_id"]: r for r in rows}
    assert (by[0]["level_skips"], by[0]["h1_count"]) == (1, 1) and by[0]["outline"] == "H1 a\n  H2 b\n      H4 c"
    assert by[1]["question_headings"] == ["What is it", "cómo hacer"]
    assert by[2]["empty_headings"] == 1 and len(by[2]["headings"]) == 1


def test_social_and_images(spark):
    html = (
        '<head><meta property="og:title" content="a"><meta property="OG:Title" content="b"><meta property="og:image" content="/i.png"><meta name="twitter:card" content="summary"></head>'
        '<body><img src="/a.webp" alt="" width=1 height=1 loading=lazy><img data-src="b.jpg"><img src=""><picture><source type="image/avif"><img src="c.png" alt="c"></picture></body>'
    )
    row = onpage.images(onpage.social(pages(spark, html), spark.createDataFrame([("https://example.com/i.png", 200)], "url string, status int"))).first()
    assert row["open_graph"] == {"og:title": "a", "og:image": "/i.png"} and row["og_image_url"] == "https://example.com/i.png" and row["social_score"] == 20 + 25 + 10 + 5
    assert "image_relative" in [f["code"] for f in row["social_findings"]]
    assert (row["total_images"], row["missing_alt"], row["decorative_alt"], row["missing_dimensions"], row["lazy_loaded"], row["modern_format"]) == (3, 1, 1, 2, 1, 1)
    assert row["image_score"] == 30 + 8 + 20 + 10


def test_links(spark):
    html = '<a href="/x">Read  more</a><a href="https://www.example.com/">w</a><a href="mailto:a@b">m</a><a href="#t">t</a><a href="/i"><img alt="pic"></a><a href="/e"></a><a href="/x" rel="nofollow ugc">again</a>'
    parsed = onpage.links(pages(spark, html))
    row = parsed.first()
    assert (row["total_links"], row["internal_links"], row["external_links"], row["empty_anchor_text"], row["generic_anchor_text"], row["nofollow_links"], row["ugc_links"]) == (5, 4, 1, 1, ["Read  more".replace("  ", " ")], 1, 1)
    sample = onpage.link_sample(parsed).orderBy("pos").collect()
    assert [r["href"] for r in sample] == ["https://example.com/x", "https://www.example.com/", "https://example.com/i", "https://example.com/e"]
    fetches = spark.createDataFrame([("https://example.com/x", 404), ("https://example.com/i", 403)], "url string, status int")
    status = onpage.link_status(onpage.link_sample(parsed), fetches).first()
    assert (status["checked_count"], status["broken_count"]) == (2, 1)
    assert [(r["domain"], r["count"]) for r in onpage.external_domains(parsed).collect()] == [("www.example.com", 1)]


def test_meta(spark):
    html = '<html lang="en"><head><meta charset=utf-8><title>  A title of a fitting length, no more  </title><meta name=Description content="' + "d" * 100 + '"><link rel=canonical href="https://EXAMPLE.com:443/#x"><meta name=robots content="NOINDEX, follow"><meta name=viewport content=w><link rel="shortcut icon" href=f></head></html>'
    row = onpage.meta_tags(pages(spark, html)).first()
    assert row["title_length"] == 36 and row["canonical_is_self"] and not row["indexable"] and row["followable"] and row["favicon"] == "f"
    assert row["meta_score"] == 25 + 20 + 15 + 8 + 7 + 10


def test_geo_attribution(spark):
    filler = "<p>word</p>"
    entity = ld('{"@type": "AccountingService", "name": "x", "address": "y", "sameAs": ["z"]}').replace("<p>x</p>", filler)
    article = ld('{"@type": "BlogPosting", "headline": "x"}')
    both = audits.geo_audit(audits.with_site(audits.analysed(src.with_http_defaults(spark.createDataFrame([(0, "https://example.com/", entity), (1, "https://example.com/", article)], "page_id long, url string, html string"))), None))
    earned = {r["page_id"]: {s["id"]: s["earned"] for s in r["signals"]}["attribution"] for r in both.select("page_id", "signals").collect()}
    assert earned[0] == 10 and earned[1] < 10


def test_url_functions(spark):
    from crawlgauge.functions.urls import admit_one, private_host, resolve_one

    for host in "localhost 127.0.0.1 10.1.2.3 172.16.0.1 192.168.1.1 169.254.169.254 0.0.0.0 100.64.0.1 [::1] ::1 fe80::1 fc00::1 ::ffff:127.0.0.1 2130706433 0x7f.1 127.1 224.0.0.1 192.88.99.1 printer.local db.internal".split():
        assert private_host(host), host
    for host in ("example.com", "8.8.8.8", "1.1.1.1", "2606:4700:4700::1111"):
        assert not private_host(host), host
    for bad in ("ftp://example.com", "javascript:alert(1)", "http://localhost/x", "http://2130706433/", ""):
        assert admit_one(bad) is None, bad
    assert admit_one("example.com/page") == "https://example.com/page"
    assert resolve_one("https://a.example/x/y?q", "../für?ü") == "https://a.example/f%C3%BCr?%C3%BC"
    rows = spark.createDataFrame([("https://Example.com:443/path/#s",), ("https://example.com/path",), ("http://example.com?x=1",)], "u string")
    assert [r[0] for r in rows.select(urls.normalised(F.col("u"))).collect()] == ["https://example.com/path", "https://example.com/path", "http://example.com/?x=1"]
    status = spark.createDataFrame([(s,) for s in (200, 301, 401, 403, 429, 999, 400, 404, 410, 500, 502, 503)], "s int")
    assert [r[0] for r in status.select(urls.broken(F.col("s"))).collect()] == [False] * 6 + [True] * 6


def test_text_functions(spark):
    samples = {"table": 1, "the": 1, "naïve": 1, "123": 0, "create": 1, "queue": 1, "rhythms": 1, "nth": 1, "banane": 2, "Águae": 2, "ñ": 1, "be": 1, "the table, 123 create": 3}
    rows = spark.createDataFrame(list(samples.items()), "w string, n int")
    assert rows.where(text.syllables(F.split("w", " ")) != F.col("n")).collect() == []
    one = spark.createDataFrame([("Hi 😀. One? two",)], "t string").select(text.utf16_length(F.col("t")), text.sentence_count(F.col("t")), F.size(text.words(F.col("t"))), text.round_half_up(F.lit(-0.5))).first()
    assert tuple(one) == (15, 3, 3, 0)


def test_gates_and_output(spark):
    rows = spark.createDataFrame([(404, "text/html", "x"), (200, "image/png", "x"), (200, "", " <!DOCTYPE html>"), (200, None, "plain")], "status int, content_type string, html string")
    assert [r["error"] for r in src.loadable(rows).collect()] == ["http_404", "not_html", None, "not_html"]
    lists = spark.createDataFrame([(list(range(1000)), list(range(500)), [1])], "a array<int>, b array<int>, c array<int>")
    cut = audits.capped(lists).first()
    assert (len(cut["a"]), len(cut["b"]), len(cut["c"]), cut["lists_cut"]) == (200, 200, 1, 2)
    found = spark.createDataFrame([([("a", "info"), ("b", "pass"), ("c", "fail"), ("d", "warn"), ("e", "fail")],)], "f array<struct<code:string,severity:string>>")
    assert found.select(audits.rendered(F.col("f"))).first()[0] == "x c\nx e\n! d\n+ b\nx a"
    assert found.select(audits.issues(F.col("f"))).first()[0] == ["c", "e", "d"]
    kinds = spark.createDataFrame([("request timed out",), ("getaddrinfo ENOTFOUND x",), ("http_404",), (None,)], "m string")
    assert [r[0] for r in kinds.select(audits.error_kind(F.col("m"))).collect()] == ["timeout", "unknown_host", "not_found", "other"]


def test_json_has_no_nan():
    from crawlgauge.operators.structured_data import read_block

    assert read_block('{"@type": "Thing", "x": NaN}') == ([], "invalid") and read_block('{"@type": "Thing", "x": -Infinity}') == ([], "invalid")


def test_responses_become_pages(spark):
    h = lambda *pairs: list(pairs)
    rows = [
        (1, "https://a.example/", None, 200, h(("Content-Type", "text/html"), ("X-Tag", "a"), ("x-tag", " b "), (None, "c"), ("d", None)), bytearray(b"\xef\xbb\xbf<p>\xc3\xa9")),
        (2, "https://a.example/", "https://b.example/", 200, None, bytearray("ééé".encode())), (3, "https://a.example/", None, 204, h(), None),
        (4, "u", None, 200, h(("Set-Cookie", "a"), ("SET-COOKIE", "b")), bytearray(b"\xf0\x9f\x98\xff\xed\xa0\x80|")),
    ]
    log = spark.createDataFrame(rows, "page_id int, url string, final_url string, status int, headers array<struct<name:string,value:string>>, body binary")
    got = {r["page_id"]: r for r in src.from_responses(log, 9).collect()}
    assert (got[1]["html"], got[1]["bytes"], got[1]["truncated"], got[1]["content_type"], got[1]["headers"]) == ("<p>é", 8, False, "text/html", {"content-type": "text/html", "x-tag": "a, b"})
    cut = {r["page_id"]: r for r in src.from_responses(log, 5).collect()}
    assert (cut[2]["html"], cut[2]["bytes"], cut[2]["truncated"], cut[2]["final_url"], cut[2]["headers"]) == ("éé\ufffd", 5, True, "https://b.example/", {})
    assert (got[3]["html"], got[3]["bytes"], got[3]["truncated"], got[3]["content_type"], got[3]["final_url"]) == ("", 0, False, None, "https://a.example/")
    assert got[4]["html"] == b"\xf0\x9f\x98\xff\xed\xa0\x80|".decode(errors="replace") and got[4]["headers"] == {"set-cookie": "b"}


def test_lists_are_cut_at_every_depth(spark):
    kind = "id int, findings array<struct<code:string,severity:string>>, top struct<name:string,entries:array<struct<tags:array<int>,m:map<string,array<int>>>>>, `a.b` array<array<array<int>>>"
    found = lambda n: [(f"f{i}", "warn") for i in range(n)]
    entry = ([1, 2, 3, 4], {"x": [1, 2, 3, 4, 5], "y": [1], "z": None})
    rows = [
        (1, found(1), ("n", [entry, ([1], {}), (None, None), entry]), [[[1] * 4], [[1]] * 4, [None]]),  # entries, a.b's inner ones, and two lists of the first entry; the last entry is cut off
        (2, found(5), ("n", []), [[[]]]), (3, found(3), None, None), (4, None, ("n", [entry]), []),
    ]
    got = {r["id"]: r for r in audits.capped(spark.createDataFrame(rows, kind), 3, "findings").collect()}
    assert [got[i]["lists_cut"] for i in (1, 2, 3, 4)] == [5, 1, 0, 2]
    one = got[1].asDict(recursive=True)
    assert one["top"] == {"name": "n", "entries": [{"tags": [1, 2, 3], "m": {"x": [1, 2, 3], "y": [1], "z": None}}, {"tags": [1], "m": {}}, {"tags": None, "m": None}]}
    assert one["a.b"] == [[[1, 1, 1]], [[1], [1], [1]], [None]]
    assert [tuple(f) for f in got[1]["findings"]] == [("f0", "warn"), ("lists_cut", "info")] and [f["code"] for f in got[2]["findings"]] == ["f0", "f1", "f2", "lists_cut"]
    assert len(got[3]["findings"]) == 3 and got[3]["top"] is None and got[3]["a.b"] is None and got[4]["findings"] is None


def test_local_addresses_and_html_signs(spark):
    local = ["::7f00:1", "64:ff9b:1::1", "fec0::1", "127.1", "2130706433", "localhost", "a.local", "x.internal", "::ffff:10.0.0.1", "[fd00::2]"]
    assert all(urls.private_host(h) for h in local) and not any(urls.private_host(h) for h in ("example.com", "box.lan", "intranet", "93.184.216.34", "2606:4700::1"))
    rows = [("text/html; charset=x", "", True), ("application/xhtml+xml", "", True), ("", "<!DOCTYPE  html>", True), ("text/plain", "see <body tag", False), (None, "<HTML lang=x>", True), ("text/plain", "<htmlx>", False), ("image/png", "<html>", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, body string, expected boolean")
    assert df.where(src.looks_like_html(F.col("kind"), F.col("body")) != F.col("expected")).collect() == []


def test_error_kinds(spark):
    told = {"read ECONNRESET": "reset", "write EPIPE": "reset", "socket hang up": "reset", "getaddrinfo EAI_AGAIN h": "unknown_host", "connect ECONNREFUSED": "refused", "self signed": "certificate", "operation timed out": "timeout", "odd": "other"}
    df = spark.createDataFrame(list(told.items()), "m string, expected string")
    assert df.where(audits.error_kind(F.col("m")) != F.col("expected")).collect() == []


def test_silent_ends_take_linear_time(spark):
    words = ["make", "the", "agree", "tree", "possible", "queue", "e", "be", "ße", "caféte", "a" + "b" * 40_000, "é", "axee", "aye", "rhythme"]
    rows = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "i int, w array<string>")
    got = [r[1] for r in sorted(rows.select("i", text.syllables(F.col("w"))).collect())]
    assert got == [1, 1, 2, 1, 2, 1, 1, 1, 1, 2, 1, 1, 2, 1, 1]


def test_hreflang_report(spark):
    link = lambda code, href: f'<link rel="alternate" hreflang="{code}" href="{href}">'
    heads = [link("en", "/") + link("de", "/de") + link("DE", "/de2") + link("x-default", "/"), link("english", "/e"), ""]
    rows = pages(spark, *[f"<head>{h}</head><body>x</body>" for h in heads])
    out = {r["page_id"]: r for r in hreflang.page_report(rows, hreflang.alternates(rows)).collect()}
    codes = {i: [f["code"] for f in r["hreflang_findings"]] for i, r in out.items()}
    assert codes[0] == ["hreflang_found", "self_reference", "x_default", "duplicate_codes"] and out[0]["duplicate_codes"] == ["de"]
    assert codes[1] == ["hreflang_found", "self_reference_missing", "x_default_missing", "invalid_codes"] and codes[2] == ["hreflang_none"]
    checked = {r["page_id"]: r for r in hreflang.page_report(rows, hreflang.reciprocity(hreflang.alternates(rows), rows)).collect()}
    assert checked[2]["hreflang_findings"][0]["severity"] == "info"
