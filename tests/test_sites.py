import gzip

from pyspark.sql import functions as F

from crawlgauge.operators import llms_txt, redirects, sitemaps
from crawlgauge.streaming import grades

XML = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/?x=1&amp;y=2</loc><lastmod>2024-01-02</lastmod></url><url><loc> http://b.example/ </loc><lastmod>soon</lastmod></url></urlset>'


def test_gunzip(spark):
    raw = XML.encode()
    assert sitemaps.gunzip_one(gzip.compress(raw)) == (raw, False) and sitemaps.gunzip_one(raw) == (raw, False)
    assert sitemaps.gunzip_one(gzip.compress(b" " * 2048), 1024) == (b"", True)
    rows = spark.createDataFrame([(bytearray(gzip.compress(raw)),), (None,)], "raw binary").select(sitemaps.gunzipped(F.col("raw")).alias("g")).select("g.*").collect()
    assert bytes(rows[0]["data"]) == raw and rows[1]["data"] is None


def test_sitemap(spark):
    maps = spark.createDataFrame([("https://a.example/sitemap.xml", XML), ("i", "<sitemapindex><sitemap><loc>https://a.example/sitemap.xml</loc></sitemap></sitemapindex>"), ("e", "<sitemapindex></sitemapindex>"), ("u", "<rss/>"), ("n", None)], "sitemap_url string, xml string")
    parsed = sitemaps.parsed(maps)
    assert {r["sitemap_url"]: r["kind"] for r in parsed.collect()} == {"https://a.example/sitemap.xml": "urlset", "i": "index", "e": "index", "u": "unknown", "n": "unknown"}
    entries = sitemaps.with_children(parsed, parsed)
    assert entries.where("sitemap_url = 'i'").count() == 2
    sites = spark.createDataFrame([("https://a.example/sitemap.xml", "urlset", "robots.txt"), ("u", "unknown", "convention")], "sitemap_url string, kind string, via string")
    by = {r["sitemap_url"]: r for r in sitemaps.report(entries, sites).collect()}
    row = by["https://a.example/sitemap.xml"]
    assert (row["url_count"], row["with_lastmod"], row["invalid_lastmod"], row["off_origin"], row["non_https"]) == (2, 2, 1, 1, 1)
    assert row["sitemap_score"] == 40 + 10 + 15 + 20 and by["u"]["sitemap_score"] == 15
    named = spark.createDataFrame([("https://a.example", 3, "https://a.example/s.xml")], "origin string, pos int, url string")
    origins = spark.createDataFrame([("https://a.example",), ("https://b.example",), ("https://c.example",)], "origin string")
    fetches = spark.createDataFrame([("https://b.example/sitemap_index.xml", 200), ("https://b.example/sitemap.xml", 404)], "url string, status int")
    found = {r["origin"]: (r["sitemap_url"], r["via"]) for r in sitemaps.discovered(origins, named, fetches).collect()}
    assert found == {"https://a.example": ("https://a.example/s.xml", "robots.txt"), "https://b.example": ("https://b.example/sitemap_index.xml", "convention")}


def test_sitemap_xml():
    assert sitemaps.parse_one('<s:urlset xmlns:s="x"><s:url><s:loc><![CDATA[https://a.example/?p=1&q]]></s:loc><s:priority>0.5</s:priority></s:url></s:urlset>')[:2] == (
        "urlset", [{"loc": "https://a.example/?p=1&q", "lastmod": None, "changefreq": None, "priority": "0.5"}])
    assert sitemaps.parse_one("<urlset><url><loc>https://a.example/&#233;</loc><loc>second</loc></url></urlset>")[1][0]["loc"] == "https://a.example/é"
    assert sitemaps.parse_one("<urlset></urlset>") == ("unknown", [], []) and sitemaps.parse_one("<sitemapindex></sitemapindex>")[0] == "index"
    assert sitemaps.parse_one('<!DOCTYPE u [<!ENTITY e "ee">]><urlset><url><loc>&e;</loc></url></urlset>') == ("unknown", [], [])
    assert sitemaps.parse_one("<urlset><url><loc>https://a.example/1</loc></url><url><loc>https://a.")[1] == [{"loc": "https://a.example/1", "lastmod": None, "changefreq": None, "priority": None}]


def test_sitemap_from_raw_bytes_and_explicit_discovery(spark):
    raw = [("z", bytearray(gzip.compress(XML.encode()))), ("n", None), ("x", bytearray(b"\x1f\x8bbroken"))]
    got = {r["sitemap_url"]: (r["kind"], len(r["entries"])) for r in sitemaps.from_raw(spark.createDataFrame(raw, "sitemap_url string, raw binary")).collect()}
    assert got == {"z": ("urlset", 2), "n": ("unknown", 0), "x": ("unknown", 0)}
    origins = spark.createDataFrame([("https://a.example",)], "origin string")
    named = spark.createDataFrame([("https://a.example", 3, "https://a.example/s.xml")], "origin string, pos int, url string")
    fetches = spark.createDataFrame([("https://a.example/sitemap.xml", 200)], "url string, status int")
    own = spark.createDataFrame([("https://a.example", "https://a.example/own.xml")], "origin string, sitemap_url string")
    assert sitemaps.discovered(origins, named, fetches, own).first()[1:] == ("https://a.example/own.xml", "explicit")


SCHEMA = "url string, final_url string, status int, redirects array<struct<url:string,status:int,location:string>>"


def test_redirects(spark):
    hop = lambda u, s, to: (u, s, to)
    rows = [("http://a.example/in", "http://a.example/in#top", 200, [hop("http://a.example/in", 301, "/out"), hop("http://a.example/out", 302, "/in#top")]), ("http://b.example/", "https://b.example/", 200, [hop("http://b.example/", 302, "https://b.example/")])]
    by = {r["url"]: r for r in redirects.trace(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by["http://a.example/in"]["has_loop"] and by["http://a.example/in"]["hop_count"] == 2
    assert not by["http://b.example/"]["has_loop"] and by["http://b.example/"]["https_upgrade"] and by["http://b.example/"]["has_temporary_redirect"]


def test_canonical_host(spark):
    end = "https://a.example/"
    rows = [(v, end, 200, [] if v == end else [(v, 301, end)]) for v in ("http://a.example/", "https://a.example/", "http://www.a.example/", "https://www.a.example/")]
    rows += [("http://b.example/", "http://b.example/", 200, [])]
    domains = spark.createDataFrame([("a.example",), ("www.b.example",), ("c.example",)], "domain string")
    by = {r["domain"]: r for r in redirects.canonical_host(domains, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by["a.example"]["host_score"] == 100 and by["a.example"]["converges"]
    assert by["www.b.example"]["host_score"] == 70 and not by["www.b.example"]["forces_https"]
    assert by["c.example"]["host_score"] == 0 and by["c.example"]["unreachable"] == 4


def test_llms(spark):
    body = "# Name\n> What it is\n## Docs\n- [a](https://a.example/a)\n## Optional\n* [b](/b)\n"
    files = spark.createDataFrame([("a", 200, body, 200), ("b", 404, "x", None)], "origin string, status int, body string, full_status int")
    by = {r["origin"]: r for r in llms_txt.llms_txt(files).collect()}
    assert (by["a"]["title"], by["a"]["summary"], by["a"]["sections"], by["a"]["link_count"], by["a"]["has_optional"], by["a"]["full_variant_found"]) == ("Name", "What it is", ["Docs", "Optional"], 2, True, True)
    assert not by["b"]["found"] and by["b"]["link_count"] == 0


def test_streaming_grades(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'u1' AS url, 'A' AS grade UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'u2', 'A' UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'u3', 'B'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = grades.grade_counts(stream).writeStream.format("memory").queryName("grades").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["grade"], r["pages"]) for r in spark.table("grades").collect()} == {("A", 2), ("B", 1)}
