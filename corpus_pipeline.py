"""A corpus pipeline: documents in, packed token windows out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``; a stage that changes texts sets n_chars anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from crawlgauge.llm.common import drop, scratch, scratch_tables, table


def _with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """rows' ``row`` as columns, with another text."""
    changed = rows.select("row.*", text.alias("_new_text")) if "_new_text" not in docs.columns else rows.select(F.col("row").dropFields("_new_text").alias("row"), text.alias("_new_text")).select("row.*", "_new_text")
    new = {"text": F.col("_new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.coalesce("_new_text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return changed.withColumns(new).select(*[c for c in docs.columns if c != "_new_text"])


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, with their host's record, reject go."""
    return quality_rules.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document that loses all its lines stays, with an empty text."""
    out = line_dedup.dedup_lines(docs)
    return _with_text(out.withColumnRenamed("text", "left"), docs, F.col("left"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar, directly or through others, the one of smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of byte strings go; a null text stays null."""
    out = suffix_dedup.dedup_bytes(docs)
    return _with_text(out, docs, F.coalesce(suffix_dedup.kept_text(F.when(F.col("n_removed") > 0, F.col("kept"))), F.col("row.text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: the pieces of each, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", drop_rejected),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("suffix_array_dedup", drop_repeated_bytes),
    ("packing", pack),
]

#: The last stage's ids come from a tokenizer, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's scratch tables go when its result is written, and that when the next one's is; the last table of documents stays, as the result is read from it lazily."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        with scratch_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
