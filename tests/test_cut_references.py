"""Page queries against their SQL on titles that were cut within a character reference."""

import duckdb
import pytest

from crawlgauge import plans
from crawlgauge.sources import html_tree

from .test_oracles import norm

CUTS = ["Token = &quot", "Token = &quo", "One &amp;&amp;&amp", "One &am", "One &", "One &copy", "One &quotTwo", "One &quot;two&quot; &amp;quot; &middot; three"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Each title stands before a short and a long text, as its heading too."""
    page = '<!DOCTYPE html><html lang="{}"><head><meta charset="utf-8"><title>{}</title></head><body><article><h1>{}</h1><p><b>{}</b></p></article></body></html>'
    texts = ["Token of the reader stands here.", "Ofen rests, and under every other line the paper turns. " * 6]
    rows = [(i * 2 + k, f"https://a.example/{i}/{k}", page.format("en" if k else "de", title, title, text)) for i, title in enumerate(CUTS) for k, text in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["term_stopword_anti_join", "page_title_length", "heading_outline", "json_results", "capped_lists", "reading_ease", "flesch_by_lang", "top_terms", "text_html_ratio"])
def test_cut_references_equal_sql(spark, cut, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{cut}/pages.parquet/*.parquet')")
    df = plans.QUERIES[name](spark, cut)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(repr([norm(v) for v in r]) for r in con.execute(f"SELECT {listed} FROM ({plans.SQL[name]})").fetchall())


def test_closed_references():
    read = {"&quot": "&quot", "&quot;": '"', "&quotx;": "&quotx;", "&amp": "&", "&ampx": "&x", "&amp;quot;": "&quot;", "&#65; &#x41;": "A A", "&#65": "&#65", "&copy &copy;": "&copy ©", "&none; &": "&none; &"}
    assert {k: html_tree.unescape_closed(k) for k in read} == read
    assert html_tree.build("<p>&quot</p>")[1][4] == '"'  # a parse for itself reads as browsers do
    assert html_tree.build(list(html_tree.tokens("<title>&quot</title><p>&quot &amp", html_tree.unescape_closed)))[-1][4] == "&quot &"
