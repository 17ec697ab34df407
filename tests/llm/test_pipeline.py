"""run() against a brute-force version of all stages, and each stage's columns."""

import pandas as pd
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="deleted together with these tests")

from crawlgauge.llm import quality_rules  # noqa: E402

from . import helpers as H  # noqa: E402


def test_run_matches_brute_force(spark, tmp_path):
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    table.to_parquet(tmp_path / "documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    rules = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(table)).collect()}
    docs = [(i, t) for i, t in sorted(zip(table["doc_id"], table["text"], strict=True)) if rules[i]]
    docs = [(i, t) for (i, _), t in zip(docs, H.repeated_lines([t for _, t in docs]), strict=True)]
    groups = H.jaccard_components([t for _, t in docs])
    seen, kept = set(), []
    for i, t in docs:
        if t not in groups or groups[t] not in seen:
            kept.append((i, t))
            seen.add(groups.get(t))
    brute = H.repeated_bytes([t.encode() for _, t in kept])
    from crawlgauge.llm.packing import tokens

    tok = tokens(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: [*tok.ids(b[3].decode(errors="ignore")).tolist(), 0] for (i, _), b in zip(kept, brute, strict=True)}
    got = {i: [x for ids in p.sort_values("start")["ids"] for x in ids] for i, p in pieces.groupby("doc_id")}
    assert got == expected


def test_stages_keep_columns_and_take_edges(spark):
    docs = H.edge(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, H.empty(spark), "").count() == 0
