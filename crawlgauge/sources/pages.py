"""Page snapshots: HTTP defaults, admission gates, and the one parse stage that all on-page analyses share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from . import html_tree

MAX_HTML_BYTES = 2_000_000

NODES = "array<struct<id:int,parent:int,last:int,tag:string,attrs:map<string,string>,text:string,url:string>>"
_NODE = pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("url", pa.string())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_http_defaults(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as fetches that went well: the columns that a crawl log would bring."""
    return pages.select(
        "page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"), F.lit("text/html").alias("content_type"),
        F.octet_length("html").cast("long").alias("bytes"), "html",
    )


def headers_map(names_and_values: Column) -> Column:
    """array<struct<name,value>> to a map with lower-case names. Values of a repeated name are joined by a comma, of cookies the last stays; headers without a name or value are left out."""
    folded = F.transform(F.filter(names_and_values, lambda h: h["name"].isNotNull() & h["value"].isNotNull()), lambda h: F.struct(F.lower(h["name"]).alias("name"), F.btrim(h["value"], F.lit(" \t\r\n")).alias("value")))
    of = lambda name: F.transform(F.filter(folded, lambda h: h["name"] == name), lambda h: h["value"])
    names = F.array_distinct(F.transform(folded, lambda h: h["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(n == "set-cookie", F.element_at(of(n), -1)).otherwise(F.array_join(of(n), ", "))))


def looks_like_html(content_type: Column, body: Column) -> Column:
    """An HTML content type, or none (or plain text) and HTML near the start of the body."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.substring(body, 1, 2000)
    return kind.rlike(r"text/html|application/xhtml\+xml") | (((kind == "") | kind.contains("text/plain")) & head.rlike(r"(?i)<html[\s>]|<!doctype\s+html"))


def capped(body: Column, limit: int = MAX_HTML_BYTES) -> Column:
    """struct(data, bytes, truncated) of a binary body read up to limit bytes."""
    return F.struct(F.substring(body, 1, limit).alias("data"), F.least(F.octet_length(body), F.lit(limit)).alias("bytes"), (F.octet_length(body) > limit).alias("truncated"))


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 text, as browsers decode them: no byte-order mark, U+FFFD for what is broken."""
    marked = F.substring(data, 1, 3) == F.lit(bytearray(b"\xef\xbb\xbf"))
    return F.make_valid_utf8(F.when(marked, F.substring(data, F.lit(4), F.octet_length(data))).otherwise(data).cast("string"))


def from_responses(log: DataFrame, limit: int = MAX_HTML_BYTES) -> DataFrame:
    """log(page_id, url, final_url, status, headers array<struct<name,value>>, body binary) as pages for load() and parse().

    Headers become a map, the body is read up to ``limit`` bytes and decoded; ``bytes`` and
    ``truncated`` tell of what was read. A response without a body has an empty text, one
    without a final URL ended where it began. The cap is applied to the bytes in the JVM, so
    that no longer body reaches the parse stage.
    """
    headers = F.coalesce(headers_map(F.col("headers")), F.create_map().cast("map<string,string>"))
    read = log.withColumns({"_headers": headers, "_read": capped(F.coalesce("body", F.lit(bytearray())), limit)})
    return read.select(
        "page_id", "url", F.coalesce("final_url", "url").alias("final_url"), "status", F.col("_headers").alias("headers"), F.element_at("_headers", F.lit("content-type")).alias("content_type"),
        F.col("_read.bytes").cast("long").alias("bytes"), "_read.truncated", decoded(F.col("_read.data")).alias("html"),
    )


def loadable(pages: DataFrame) -> DataFrame:
    """pages with ``error``: null where the page passes the status, type and size gates."""
    return pages.withColumn(
        "error",
        F.when((F.col("status") < 200) | (F.col("status") >= 300), F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(~looks_like_html(F.col("content_type"), F.col("html")), F.lit("not_html"))
        .when(F.col("html").isNull(), F.lit("no_body")),
    )


def causes(pages: DataFrame) -> Column:
    """Codes of all gates that a page fails, in the order in which they are tried."""
    there = F.col("html").isNotNull()
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("http_"), F.coalesce(F.col("status").cast("string"), F.lit("none")))),
        F.when(there & ~F.coalesce(looks_like_html(F.col("content_type"), F.col("html")), F.lit(False)), F.lit("not_html")),
        F.when(~there, F.lit("no_body")),
    ))


def load(pages: DataFrame, counts: Observation | None = None) -> DataFrame:
    """pages parsed, with ``causes``: why a page is rejected, all gates in order; empty where it is accepted. A rejected page has no nodes.

    counts, an Observation, tells after an action on the result how many pages, accepted and too_deep there were.
    """
    gated = pages.withColumn("causes", causes(pages)).withColumn("html", F.when(F.size("causes") == 0, F.col("html")))
    out = parse(gated).withColumn("causes", F.when(F.col("too_deep"), F.array(F.lit("too_deep"))).otherwise(F.col("causes")))
    if counts is not None:
        out = out.observe(counts, F.count("*").alias("pages"), F.count_if(F.size("causes") == 0).alias("accepted"), F.count_if("too_deep").alias("too_deep"))
    return out


def load_both(pages: DataFrame, path: str, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): one pass over pages writes both under path; rejected has page_id, url and causes."""
    out = load(pages, counts).withColumn("rejected", F.size("causes") > 0)
    out.write.partitionBy("rejected").parquet(path)
    both = pages.sparkSession.read.schema(out.schema).parquet(path)
    return both.where("not rejected").drop("rejected", "causes"), both.where("rejected").select("page_id", "url", "causes")


def referred(tag: str, attrs: dict[str, str]) -> str | None:
    """What an element refers to, as it stands."""
    if tag in ("a", "link"):
        return attrs.get("href")
    if tag == "img":
        return attrs.get("src", attrs.get("data-src"))
    if tag == "meta" and (attrs.get("property", "").lower() == "og:image" or attrs.get("name", "").lower() == "twitter:image"):
        return attrs.get("content")
    return None


def parse(pages: DataFrame, references: Callable[[str], str] = unescape) -> DataFrame:
    """pages' columns and, from html: nodes, main_text, landmark, too_deep. One pass over each page in Arrow batches.

    A node's url is what it refers to (href of links and anchors, src of images, content of a
    preview image), absolute, against the page's final_url. references: see html_tree.tokens.
    """
    keep = [c for c in pages.columns if c != "html"]
    out_fields = [(f.name, f.dataType.simpleString()) for f in pages.select(*keep).schema.fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in out_fields) + f", nodes {NODES}, main_text string, landmark boolean, too_deep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"nodes": [], "main_text": [], "landmark": [], "too_deep": []}
            bases = batch.column("final_url").to_pylist() if "final_url" in keep else [None] * batch.num_rows
            for html, base in zip(batch.column("html").to_pylist(), bases, strict=True):
                read = list(html_tree.tokens(html or "", references))
                deep = html_tree.too_deep(read)
                nodes = [] if deep or html is None else html_tree.build(read)
                text, landmark = html_tree.main_text(nodes)
                out = []
                for i, (parent, last, tag, attrs, own) in enumerate(nodes):
                    if tag in html_tree.TEXT_OF or attrs.get("id") in html_tree.ROOT_IDS or "data-reactroot" in attrs:
                        own = html_tree.subtree_text(nodes, i, frozenset())
                    if tag != "#text":
                        out.append({"id": i, "parent": parent, "last": last, "tag": tag, "attrs": list(attrs.items()), "text": own, "url": urls.resolve_one(base, referred(tag, attrs))})
                for name, value in zip(rows, (out, text, landmark, deep), strict=True):
                    rows[name].append(value)
            arrays = [batch.column(c) for c in keep]
            arrays += [
                pa.array(rows["nodes"], pa.list_(_NODE)), pa.array(rows["main_text"], pa.string()),
                pa.array(rows["landmark"], pa.bool_()), pa.array(rows["too_deep"], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "nodes", "main_text", "landmark", "too_deep"])

    return pages.mapInArrow(run, schema)
