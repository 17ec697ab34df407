"""Fill-in-the-middle transformation, in DuckDB inside mapInArrow.

Each Arrow batch is registered as a view of an in-process DuckDB and one SQL statement cuts
the texts (``regexp_extract_all``, ``list_slice``, ``array_to_string``), draws from ``sha256``
and takes the output apart again. Python only hands batches over; no value is touched by it.

A text is cut into tokens: white space with the word after it, or white space alone. A hash
of seed and doc_id draws two cuts, whether the text is transformed, and the order: prefix,
suffix, middle (psm) or suffix, prefix, middle (spm), each after its mark.

Edge cases: a null text is an empty one and stays plain; a text that holds a mark stays plain,
so that every output can be taken apart; a null doc_id draws as an empty string does; rows
equal in doc_id and text get the same output each; white space alone is one token; very long
texts are cut whole; columns of any name are carried in ``row``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, small_batches, table

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

#: Columns of the transformation; restored is the text as rebuilt from output and form alone.
COLUMNS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"), ("restored", "string"), ("output_sha256", "string"), ("restored_sha256", "string")]


def statement(source: str, seed: int = SEED, rate: int = RATE, spm: int = SPM, key: str = "doc_id") -> str:
    """DuckDB SQL of the transformation over source(doc_id, text): its rows' ``key`` and COLUMNS. rate, spm: percent transformed, and of these suffix first."""
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i - 7}, 8) AS UBIGINT)"
    return f"""
WITH texts AS (SELECT {key}, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {source}),
tokens AS (SELECT *, regexp_extract_all(t, '{TOKEN}') AS w FROM texts),
drawn AS (
  SELECT {key}, t, w, len(w) AS n, {draw(1)} % (len(w) + 1) AS x, {draw(2)} % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(3)} % 100 >= {rate} THEN 'plain'
      WHEN {draw(4)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM tokens),
cut AS (
  SELECT {key}, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(w, 1, least(x, y)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(w, least(x, y) + 1, greatest(x, y)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(w, greatest(x, y) + 1, n), '') END AS suffix FROM drawn),
put AS (
  SELECT {key}, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
    CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
      ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM cut),
parts AS (
  SELECT *, CASE form WHEN 'plain' THEN [output] ELSE list_concat(
      string_split(split_part(substr(output, 4), '{MIDDLE}', 1), CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END), [split_part(output, '{MIDDLE}', 2)]) END AS p FROM put),
rebuilt AS (SELECT *, CASE form WHEN 'plain' THEN p[1] WHEN 'psm' THEN p[1] || p[3] || p[2] ELSE p[2] || p[3] || p[1] END AS restored FROM parts)
SELECT {key}, n, form, prefix_chars, middle_chars, output, restored, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM rebuilt"""


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, digests_only: bool = False) -> DataFrame:
    """row (docs' columns) and COLUMNS of each row. digests_only leaves the texts output and restored out, which then never leave DuckDB."""
    small_batches(docs.sparkSession)
    wanted = [(name, kind) for name, kind in COLUMNS if not (digests_only and name in ("output", "restored"))]
    arrow = {"long": pa.int64(), "string": pa.string()}
    sql = f"SELECT {', '.join(name for name, _ in wanted)} FROM ({statement('batch', seed, rate, spm, key='i')}) ORDER BY i"
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(name, T.LongType() if kind == "long" else T.StringType()) for name, kind in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        try:
            for batch in batches:
                ids = pa.array(range(batch.num_rows), pa.int64())
                con.register("batch", pa.table({"i": ids, "doc_id": batch.column("doc_id"), "text": batch.column("text")}))
                out = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                columns = [pa.concat_arrays([pa.array([], arrow[kind]), *out.column(name).cast(arrow[kind]).chunks]) for name, kind in wanted]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(name for name, _ in wanted)])
        finally:
            con.close()

    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"), digests_only=True)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({statement('documents')})"
