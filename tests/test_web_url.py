import random

from pyspark.sql import functions as F

from crawlgauge.functions import urls, web_url

BASE = "https://user:pw@host.example:8443/a/b/c?q=1#f"
AT = "https://user:pw@host.example:8443"
#: reference, what a browser makes of it at BASE (None: no URL). Own cases, from the text of the standard.
READ = [
    # relative references
    ("", AT + "/a/b/c?q=1"), ("#", AT + "/a/b/c?q=1#"), ("#x y`", AT + "/a/b/c?q=1#x%20y%60"), ("?", AT + "/a/b/c?"), ("?z", AT + "/a/b/c?z"), ("d", AT + "/a/b/d"), ("./d", AT + "/a/b/d"), ("../d", AT + "/a/d"), ("../../../../d", AT + "/d"),
    (".", AT + "/a/b/"), ("..", AT + "/a/"), ("%2e%2E/d", AT + "/a/d"), (".%2e", AT + "/a/"), ("d/%2E", AT + "/a/b/d/"), ("/", AT + "/"), ("/d//e/../f", AT + "/d//f"), ("/d/..", AT + "/"), ("/..//d", AT + "//d"), ("...", AT + "/a/b/..."),
    # backslashes: slashes in a path, nothing else in a query or fragment
    ("\\d\\e", AT + "/d/e"), ("d\\..\\e", AT + "/a/b/e"), ("\\\\other.example\\x", "https://other.example/x"), ("?a\\b", AT + "/a/b/c?a\\b"), ("#a\\b", AT + "/a/b/c?q=1#a\\b"),
    # what each component encodes
    ("/ \"<>^`{}|[]'", AT + "/%20%22%3C%3E%5E%60%7B%7D|[]'"), ("? \"<>^`{}|[]'", AT + "/a/b/c?%20%22%3C%3E^`{}|[]%27"), ("#\"<>^`{}|[]'", AT + "/a/b/c?q=1#%22%3C%3E^%60{}|[]'"), ("/%zz%4", AT + "/%zz%4"), ("/é?é#é", AT + "/%C3%A9?%C3%A9#%C3%A9"), ("/\x01\x7f/", AT + "/%01%7F/"),
    # white space and controls around, tabs and line breaks within
    (" \t/d\n", AT + "/d"), ("/d\te\nf\r", AT + "/def"), ("\x00/d\x1f", AT + "/d"), ("ht\ntps://x.example", "https://x.example/"), ("\u00a0d", AT + "/a/b/%C2%A0d"),
    # schemes
    ("//other.example", "https://other.example/"), ("https:d", AT + "/a/b/d"), ("https:/d", AT + "/d"), ("HTTPS://Other.Example:443/", "https://other.example/"), ("http:d", "http://d/"), ("http:/d/e", "http://d/e"), ("http:////d", "http://d/"), ("http://x.example:443", "http://x.example:443/"),
    ("mailto:A B@x?s=é#t", "mailto:A B@x?s=%C3%A9#t"), ("javascript:void('/../')", "javascript:void('/../')"), ("tel:+1", "tel:+1"), ("data:,a b", "data:,a b"), ("foo://H/a/../b", "foo://H/b"), ("foo:/a/../b", "foo:/b"), ("foo:/..//b", "foo:/.//b"), ("foo://", "foo://"), ("foo://h?q'", "foo://h?q'"), ("foo://h\\x", None), ("file:///a/../b", "file:///b"), ("file://LocalHost/b", "file:///b"), ("file:b", "file:///b"),
    # authorities
    ("//a:b:c@x.example", "https://a:b%3Ac@x.example/"), ("//a@b@x.example", "https://a%40b@x.example/"), ("//@x.example", "https://x.example/"), ("//:@x.example", "https://x.example/"), ("//a'{|}@x.example", "https://a'%7B%7C%7D@x.example/"), ("//x.example:", "https://x.example/"), ("//x.example:00080", "https://x.example:80/"), ("//x.example:65535", "https://x.example:65535/"),
    ("//x.example:65536", None), ("//x.example:8a", None), ("//x.example:1:2", None), ("//:80", None), ("//a@", None), ("//a@:80", None), ("//", None), ("https://", None), ("foo://:80", None), ("//x.example?q@y", "https://x.example/?q@y"),
    # names
    ("//MÜNCHEN.example", "https://xn--mnchen-3ya.example/"), ("//straße.example", "https://xn--strae-oqa.example/"), ("//ｅｘ．example", "https://ex.example/"), ("//e%78%2e example", None), ("//e%78%2Eexample", "https://ex.example/"), ("//a\u00adb.example", "https://ab.example/"), ("//a_b.example", "https://a_b.example/"), ("//xn--mnchen-3ya.example", "https://xn--mnchen-3ya.example/"), ("//xn--.example", None), ("//xn--a.example", None),
    ("//a<b", None), ("//a%00b", None), ("//a%b", None), ("//%ff", None), ("//\u00ad", None), ("//\u0301a", None), ("//a..b.", "https://a..b./"), ("foo://a%b é", None), ("foo://a%bé", "foo://a%b%C3%A9"), ("//" + "a" * 300, "https://" + "a" * 300 + "/"),
    # addresses
    ("//127.1", "https://127.0.0.1/"), ("//0x7F.1.", "https://127.0.0.1/"), ("//2130706433", "https://127.0.0.1/"), ("//１２７.1", "https://127.0.0.1/"), ("//256.1.1.1", None), ("//1.2.3.4.5", None), ("//a.08", None), ("//a.0x", None), ("//0x.a", "https://0x.a/"), ("//1.2.3.4..", "https://1.2.3.4../"), ("foo://127.1", "foo://127.1"),
    ("//[::1]:443", "https://[::1]/"), ("//[1:0:0:2:0:0:0:3]", "https://[1:0:0:2::3]/"), ("//[1:0:0:2:3:0:0:4]", "https://[1::2:3:0:0:4]/"), ("//[1:0:2:3:4:5:6:7]", "https://[1:0:2:3:4:5:6:7]/"), ("//[::FFFF:1.2.3.4]", "https://[::ffff:102:304]/"), ("//[::1", None), ("//[::1]x", None), ("//[::1%25eth0]", None), ("//[1.2.3.4]", None), ("//::1", None),
]


def test_references_against_a_base(spark):
    for text, expected in READ:
        assert urls.resolve_one(BASE, text) == expected, text
    rows = spark.createDataFrame([(BASE, [t for t, _ in READ]), (None, ["x"]), (BASE, None), ("x", ["y"])], "base string, hrefs array<string>")
    got = [r["out"] for r in rows.select(urls.resolve_all("base", "hrefs").alias("out")).collect()]
    assert got == [[e for _, e in READ], [None], None, [None]]


def test_other_bases():
    for base, text, expected in [
        ("mailto:x", "#y", "mailto:x#y"), ("mailto:x", "y", None), ("mailto:x", "", None), ("mailto:x", "https:y", "https://y/"), ("foo://h/a/b", "../c", "foo://h/c"), ("foo://h", "c", "foo://h/c"), ("foo://h/a", "\\c", "foo://h/\\c"), ("foo:/a/b", "//h/c", "foo://h/c"),
        ("http://h", "x", "http://h/x"), ("http://h/a/", "x", "http://h/a/x"), ("http://h/a/", "https:x", "https://x/"), ("file:///a/b", "c", "file:///a/c"), ("file:///a/b", "//h/c", "file://h/c"), ("not a url", "https://x", None),
    ]:
        assert web_url.resolve(base, text) == expected, (base, text)


def test_what_is_written_reads_the_same():
    rng = random.Random(5)
    pieces = ["http:", "https:", "foo:", "//", "/", "\\", ".", "..", "%2e", "a", "é", "?", "#", "@", ":", "80", "[::1]", "1.2", "^", "'", " ", "\t", "xn--", "%", "ß", "A.b"]
    read = 0
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        once = urls.resolve_one("https://h.example/p/q", text)
        if once is not None:
            read += 1
            assert urls.resolve_one("foo:x", once) == once, text
            assert urls.resolve_one("https://h.example/p/q", once) == once, text
    assert read > 5000


def test_admission():
    for text, expected in [
        ("example.com:8080/x", "https://example.com:8080/x"), ("EXAMPLE.com/%7e", "https://example.com/%7e"), ("http://2130706433", None), ("http://[::1]", None), ("ftp://example.com", None), ("http://1.1.1.1.", "http://1.1.1.1/"), ("https://münchen.de/ä b", "https://xn--mnchen-3ya.de/%C3%A4%20b"), ("https://exa mple.com", None),
    ]:
        assert urls.admit_one(text) == expected, text
