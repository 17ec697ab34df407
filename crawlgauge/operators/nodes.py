"""Selections over a page's flat node array, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

NODES = "nodes"


def where(test) -> Column:
    return F.filter(NODES, test)


def tag(*names: str) -> Column:
    return where(lambda n: n["tag"].isin(*names))


def attr(n: Column, name: str) -> Column:
    return F.element_at(n["attrs"], F.lit(name))


def lower_attr(n: Column, name: str) -> Column:
    return F.lower(F.coalesce(attr(n, name), F.lit("")))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def meta(name: str) -> Column:
    """Content of the first meta of that name, trimmed; null if empty."""
    content = attr(first(where(lambda n: (n["tag"] == "meta") & (lower_attr(n, "name") == name))), "content")
    return F.nullif(text.trimmed(content), F.lit(""))


def tokens(value: Column) -> Column:
    return F.split(text.trimmed(value), r"\s+")


def has_token(n: Column, name: str, token: str) -> Column:
    return F.array_contains(tokens(lower_attr(n, name)), token)


def inside(n: Column, outer: Column) -> Column:
    return (n["id"] > outer["id"]) & (n["id"] <= outer["last"])


def finding(code: str, severity: str | Column, *when: Column) -> Column:
    """struct(code, severity), or null where the condition does not hold."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    found = F.struct(F.lit(code).alias("code"), level.alias("severity"))
    return F.when(when[0], found) if when else found


def findings(*each: Column) -> Column:
    return F.array_compact(F.array(*each))
