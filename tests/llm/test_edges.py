"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, and an empty table."""

import public_tokenizers
import pytest

from crawlgauge.llm import byte_bpe, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup

from . import helpers as H

TIK, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
N = len(H.edge_rows())


@pytest.fixture(scope="module")
def docs(spark):
    return H.edge(spark)


def test_quality_rules(spark, docs):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == N
    by = {(r["row"]["doc_id"], r["row"]["text"]): r for r in rows}
    assert by[2, None]["base_failed"] and not by[2, None]["kept"] and by[1, ""]["n_words"] == 0
    spam = by[14, ("spam " * 4000).strip()]
    assert spam["n_repeat_words"] == 4000 and spam["base_failed"]
    assert by[10, "ONE two\vthree\ffour"]["n_words"] == 4
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judge(H.empty(spark)).count() == 0


def test_license_scan(spark, docs):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 and r["labels"] == "" for r in rows)
    assert rows[0]["row"].asDict().keys() == set(docs.columns) and next(r for r in rows if r["row"]["doc_id"] == 4)["n_words"] == 60_000
    assert license_scan.scan(H.empty(spark)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert len(rows) == N and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in range(8))
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {1} and {r["text_crc32"] for r in rows if r["doc_id"] == 2} == {0}
    assert sharding.shard_documents(H.empty(spark)).count() == 0


def test_byte_bpe(spark, docs):
    rows = byte_bpe.with_ids(docs, TIK, public_tokenizers.PATTERN).collect()
    assert len(rows) == N and all(bytes(r["decoded"]) == (r["row"]["text"] or "").encode() for r in rows)
    assert byte_bpe.with_ids(H.empty(spark), TIK, public_tokenizers.PATTERN).count() == 0


def test_packing(spark, docs):
    pieces = packing.pack(docs, JSON, with_ids=True).collect()
    assert sum(p["length"] for p in pieces if p["start"] + p["length"] == p["doc_tokens"]) > 0
    assert sum(p["start"] == 0 for p in pieces) == N
    assert packing.pack(H.empty(spark), JSON).count() == 0


def test_ngram_join(spark, docs):
    groups = H.jaccard_components([r[1] for r in H.edge_rows()])
    rows = ngram_join.with_component_id(ngram_join.join(docs)).collect()
    assert len(rows) == N
    least = {}
    for r in H.edge_rows():
        if r[1] in groups and r[0] is not None:
            least[groups[r[1]]] = min(least.get(groups[r[1]], r[0]), r[0])
    expected = sorted([(r[0], len(H.shingles(r[1])), least.get(groups[r[1]]) if r[1] in groups else r[0]) for r in H.edge_rows()], key=str)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows], key=str) == expected
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    blank = sum(not H.shingles(r[1]) for r in H.edge_rows())
    assert kept.count() == blank + len(set(groups.values()))
    assert ngram_join.join(H.empty(spark)).count() == 0 and ngram_join.keep_one(H.empty(spark)).count() == 0


def _by_document(rows, value):
    return {(r["row"]["doc_id"], r["row"]["text"]): value(r) for r in rows}


def test_suffix_dedup(spark, docs):
    rows = suffix_dedup.dedup_bytes(docs).collect()
    assert len(rows) == N
    got = _by_document(rows, lambda r: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    unique = [d for d in H.order(H.edge_rows()) if d[0] not in (4, 5, 6)]
    # the order of documents of equal doc_id is the operator's own, so those two are checked by what they keep together
    alone = H.repeated_bytes([(d[1] or "").encode() for d in unique if d[0] is not None])
    for d, e in zip([d for d in unique if d[0] is not None], alone, strict=True):
        assert got[d] == e, d[0]
    long = next(t for i, t in ((r[0], r[1]) for r in H.edge_rows()) if i == 4)
    assert got[4, long][1] == 0 and got[5, long + " tail"][3] == b""[:0] + (long + " tail").encode()[len(long.encode()) :]
    passage = next(r[1] for r in H.edge_rows() if r[0] == 6)
    assert got[None, passage][3] == b""
    assert suffix_dedup.dedup_bytes(H.empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == N
    got = _by_document(rows, lambda r: r["text"])
    ordered = [d for d in H.order(H.edge_rows()) if d[0] not in (6, None)]
    for d, e in zip(ordered, H.repeated_lines([d[1] for d in ordered]), strict=True):
        assert (got[d] or "") == e, d[0]
    assert got[2, None] is None and line_dedup.dedup_lines(H.empty(spark)).count() == 0


def test_quality_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (9, None), (99, 1), (4, 1)], "doc_id long, quality int")
    plain = docs.select("doc_id", "text")
    model, prior = quality_classifier.fit(plain, labels)
    rows = quality_classifier.score(docs, model).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 for r in rows) and 0 < prior < 1
    none, _ = quality_classifier.fit(plain, labels.where("quality = 0"))
    assert none is None and {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.fit(H.empty(spark).select("doc_id", "text"), labels)[0] is None and quality_classifier.score(H.empty(spark), none).count() == 0
