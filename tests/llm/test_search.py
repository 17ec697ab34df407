"""Lexical search, language identification and the fill-in-the-middle transformation against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlgauge.llm import fill_in_middle, language_id, lexical_search

from . import helpers as H

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the formula, every document for every item."""
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c, n) in enumerate(counts):
            m = 10 + 90 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(TERM.findall((text or "").translate(FOLD))) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


@pytest.mark.parametrize("many", [False, True])
def test_search_is_exact(spark, monkeypatch, many):
    """Skewed terms, ties, repeats and documents of no terms; also with queries in blocks, lists in slices and nothing broadcast that can grow."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "x9"]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.15)), 61)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 5, 30, 200]))) for i in range(400)]
    docs += [(i + 400, docs[i][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[9][1]), (900, None), (901, " ,;"), (902, "rare only here"), (903, "W1-w2_W3\x00w4")]
    items = [(i, pick(8)) for i in range(25)] + [(25, "rare"), (26, "nowhere"), (27, None), (28, "w0 W0"), (29, " ".join(vocabulary)), (3, "rare w1")]
    if many:
        for name, value in (("BLOCK_TERMS", 100), ("SLICE", 20), ("BROADCAST_ROWS", 5), ("CHUNK", 300)):
            monkeypatch.setattr(lexical_search, name, value)
    got = rows_of(lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(got, key=repr) == sorted(ranked(docs, items), key=repr)


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "spam One"), (2, H.words(60, 2))], "item_id long, text string")
    docs = [(r[0], r[1]) for r in H.edge_rows()]
    got = rows_of(lexical_search.search(H.edge(spark), items))
    assert sorted(got, key=repr) == sorted(ranked(docs, items.collect()), key=repr)
    assert lexical_search.search(H.empty(spark), items).count() == 0
    assert lexical_search.search(H.edge(spark), items.limit(0)).count() == 0


def test_messages_equal_all_paths():
    """Marginals and expected moves against the sum over all labellings."""
    rng = np.random.default_rng(1)
    field = language_id.Field(["a", "b", "c"], {}, np.zeros((0, 3)))
    field.moves = rng.normal(size=(3, 3))
    scores, lengths = rng.normal(size=(2, 5, 3)), np.array([5, 3])
    marginals, moves = field.messages(scores, lengths, pairs=True)
    expected, both = np.zeros((2, 5, 3)), np.zeros((3, 3))
    for i, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = np.array([math.exp(sum(scores[i, t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weights / weights.sum(), strict=True):
            for t, y in enumerate(p):
                expected[i, t, y] += w
            for a, b in zip(p, p[1:]):
                both[a, b] += w
        assert np.allclose(marginals[i, :n], expected[i, :n])
    assert np.allclose(moves, both)


@pytest.fixture(scope="module")
def field(spark):
    return language_id.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang"), documents=400)


def test_language_held_out(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict(docs, field).where((language_id.fold(F.col("row.doc_id")) == language_id.HELD_OUT) & F.col("row.lang").isNotNull()).collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["row"]["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words(spark, field):
    """A text of a German and a Spanish half: nearly all words are labelled by their half."""
    halves = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(language_id.fold(F.col("doc_id")) == 1).orderBy("doc_id").collect():
        words = language_id.words_of(r["text"])
        if r["lang"] in ("de", "es") and len(words) >= 150:
            halves.setdefault(r["lang"], " ".join(words[:150]))
    text = halves["de"] + ". " + halves["es"]
    (row,) = language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
    right = sum(max(0, min(s["first"] + s["words"], hi) - max(s["first"], lo)) for s in row["spans"] for lo, hi, lang in ((0, 150, "de"), (150, 300, "es")) if s["lang"] == lang)
    assert right >= 285 and row["n_words"] == 300 and len(row["spans"]) <= 8 and 0.4 < row["score"] < 0.6


def test_language_edges(spark, field):
    rows = language_id.predict(H.edge(spark), field).collect()
    by = {(r["row"]["doc_id"], r["row"]["text"]): r for r in rows}
    assert len(rows) == len(H.edge_rows()) and {by[k]["lang_pred"] for k in ((1, ""), (2, None), (3, " \n\t "), (None, None))} == {"und"}
    assert by[2, None]["score"] == 0 and by[2, None]["spans"] == [] and all(sum(s["words"] for s in r["spans"]) == r["n_words"] for r in rows)
    assert language_id.predict(spark.createDataFrame([(1, "12 34 ² _")], "doc_id long, text string"), field).first()["lang_pred"] == "und"
    assert language_id.learn(H.empty(spark)) is None and language_id.predict(H.empty(spark), field).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(H.edge(spark), None).collect()} == {"und"}
    small = language_id.learn(H.edge(spark))
    assert small.labels == ["de", "en"] and language_id.predict(H.edge(spark), small).count() == len(rows)


def fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rule, in plain Python."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(3)
    extra = [(i, "".join(rng.choice(["a", "Zé", " ", "\n", "\x1f", "\x85", " ", "<", "<S", "P>", ">", "\U0001f600", "\0"]) for _ in range(rng.randint(0, 40)))) for i in range(20, 320)]
    extra += [(321, "a <P> b"), (322, "x<M>"), (323, "<S>"), (324, "   "), (325, "<S < S> <P")]
    docs = H.edge(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = fill_in_middle.transform(docs).collect()
    assert len(rows) == len(H.edge_rows()) + len(extra) and {"plain", "spm", "psm"} == {r["form"] for r in rows}
    for r in rows:
        doc_id, text = r["row"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim(doc_id, text)
        assert r["restored"] == (text or "") and r["output_sha256"] == H.sha(r["output"]) and r["restored_sha256"] == H.sha(text or "")
    carried = fill_in_middle.transform(H.edge(spark), digests_only=True)
    assert carried.first()["row"].asDict().keys() == set(H.edge(spark).columns) and "output" not in carried.columns
    assert fill_in_middle.transform(H.empty(spark)).count() == 0


def test_statement_on_tables():
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    rows = con.execute(f"SELECT d.doc_id, d.text, x.* EXCLUDE (doc_id) FROM documents d JOIN ({fill_in_middle.statement('documents')}) x USING (doc_id)").fetchall()
    assert len(rows) >= 200 and all(tuple(r[2:7]) == fim(r[0], r[1]) for r in rows)
