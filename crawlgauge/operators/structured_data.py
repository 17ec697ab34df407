"""schema.org items: JSON-LD (any nesting of arrays and @graph), microdata and RDFa counts; scored against the type rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from . import nodes as N

_PREFIX = re.compile(r"^https?://schema\.org/", re.I)
_STRINGS = T.ArrayType(T.StringType())
_ITEMS = T.ArrayType(T.StructType([T.StructField("types", _STRINGS), T.StructField("properties", _STRINGS)]))
_FOUND = T.ArrayType(T.StructType([T.StructField("items", _ITEMS), T.StructField("error", T.StringType())]))


def _types(value) -> list[str]:
    return [t for v in value for t in _types(v)] if isinstance(value, list) else [_PREFIX.sub("", value)] if isinstance(value, str) else []


def walk(value) -> Iterator[dict]:
    """Nodes with a type: arrays and @graph are entered, other nested objects are not; a graph's nodes come before their holder."""
    if isinstance(value, list):
        for v in value:
            yield from walk(v)
    elif isinstance(value, dict):
        if "@graph" in value:
            yield from walk(value["@graph"])
        if _types(value.get("@type")):
            yield value


def _no_number(name: str):
    raise ValueError(name)


def read_block(block: str) -> tuple[list[dict], str | None]:
    if not block.strip():
        return [], "empty"
    try:
        value = json.loads(block, parse_constant=_no_number)  # JSON has no NaN or Infinity
        items = [{"types": _types(n["@type"]), "properties": [k for k in n if not k.startswith("@")]} for n in walk(value)]
    except (ValueError, RecursionError):
        return [], "invalid"
    return items, None if items else "untyped"


@F.pandas_udf(_FOUND)
def json_ld(blocks: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("items", "error"), read_block(b or ""), strict=True)) for b in (row if row is not None else [])] for row in blocks], dtype=object)


def _rule_map(i: int) -> Column:
    """type to its required (0) or recommended (1) properties, as one literal."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    return F.expr("map(" + ", ".join(f"'{t}', cast(array({quoted(r[i])}) as array<string>)" for t, r in fixed.SCHEMA_RULES.items()) + ")")


def _evaluate(types: Column, properties: Column, kind: str) -> Column:
    required, recommended = _rule_map(0), _rule_map(1)
    ruled = F.get(F.filter(types, lambda t: F.map_contains_key(required, t)), F.lit(0))
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce(F.element_at(required, ruled), none), properties)
    return F.struct(
        F.lit(kind).alias("format"), F.coalesce(F.get(types, F.lit(0)), F.lit("Unknown")).alias("type"), types.alias("all_types"), properties.alias("properties"),
        missing.alias("missing_required"), F.array_except(F.coalesce(F.element_at(recommended, ruled), none), properties).alias("missing_recommended"), (F.size(missing) == 0).alias("valid"),
    )


def structured_data(pages: DataFrame) -> DataFrame:
    """items array, parse_errors, types_found, which families are there; schema_score."""
    scripts = N.where(lambda n: (n["tag"] == "script") & (text.trimmed(N.lower_attr(n, "type")) == "application/ld+json"))
    scopes = N.where(lambda n: F.map_contains_key(n["attrs"], "itemscope") & F.map_contains_key(n["attrs"], "itemtype"))
    props = N.where(lambda n: F.map_contains_key(n["attrs"], "itemprop"))
    out = pages.withColumns({"ld": json_ld(F.transform(scripts, lambda n: F.coalesce(n["text"], F.lit("")))), "scopes": scopes, "props": props})
    from_ld = F.transform(F.flatten(F.transform("ld", lambda b: b["items"])), lambda i: _evaluate(i["types"], i["properties"], "json-ld"))
    micro = F.transform(
        "scopes",
        lambda s: _evaluate(
            F.array(F.regexp_replace(text.trimmed(N.attr(s, "itemtype")), r"(?i)^https?://schema\.org/", "")),
            F.array_distinct(F.transform(F.filter("props", lambda p: N.inside(p, s)), lambda p: N.attr(p, "itemprop"))),
            "microdata",
        ),
    )
    errors = F.filter(F.transform("ld", lambda b, i: F.when(b["error"].isNotNull(), F.concat(b["error"], F.lit("_"), (i + 1).cast("string")))), lambda e: e.isNotNull())
    out = out.withColumns({"items": F.concat(from_ld, micro), "parse_errors": errors, "json_ld_blocks": F.size("ld"), "microdata_items": F.size("scopes"), "rdfa_items": F.size(N.where(lambda n: F.map_contains_key(n["attrs"], "typeof")))})
    types = F.array_distinct(F.flatten(F.transform("items", lambda i: i["all_types"])))
    out = out.withColumn("types_found", types)
    has = lambda family: F.exists("types_found", lambda t: F.lower(t).isin(family))
    any_ = lambda *names: F.exists("types_found", lambda t: t.isin(*names))
    out = out.withColumns({
        "has_organization": has(fixed.ORGANIZATION_TYPES), "has_person": any_("Person"), "has_website": any_("WebSite"), "has_breadcrumb": any_("BreadcrumbList"),
        "has_article": has(fixed.ARTICLE_TYPES), "has_faq": any_("FAQPage", "QAPage"), "item_count": F.size("items"),
        "valid_items": F.size(F.filter("items", lambda i: i["valid"])), "lacking_items": F.size(F.filter("items", lambda i: F.size(i["missing_recommended"]) > 0)),
    }).drop("ld", "scopes", "props")
    n, valid, lacking = F.col("item_count"), F.col("valid_items"), F.col("lacking_items")
    entity = F.col("has_organization") | F.col("has_person")
    score = F.when(n == 0, 0).otherwise(
        35 + F.when(valid == n, 25).otherwise(0) + F.when(lacking == 0, 10).otherwise(0) + F.when(entity, 10).otherwise(0)
        + F.when(F.col("has_breadcrumb"), 10).otherwise(0) + F.when(F.col("has_website"), 5).otherwise(0) + F.when(F.col("has_article"), 5).otherwise(0)
    )
    found = N.findings(
        N.finding("schema_none", "fail", n == 0), N.finding("schema_found", "pass", n > 0), N.finding("items_invalid", "fail", valid < n), N.finding("items_valid", "pass", (n > 0) & (valid == n)),
        N.finding("recommended_missing", "warn", lacking > 0), N.finding("blocks_broken", "fail", F.size("parse_errors") > 0),
        N.finding("publisher_organization", "pass", F.col("has_organization")), N.finding("publisher_person", "pass", ~F.col("has_organization") & F.col("has_person")), N.finding("publisher_none", "warn", ~entity),
        N.finding("breadcrumb_present", "pass", F.col("has_breadcrumb")), N.finding("breadcrumb_absent", "info", ~F.col("has_breadcrumb")),
    )
    return out.withColumns({"schema_score": text.clamp(score), "schema_grade": text.grade(score), "schema_findings": found})
