"""URL functions: native expressions where SQL strings suffice, Arrow functions for resolution and address checks."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import addresses, web_url

def visit_key(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """host with a port that is not the scheme's own, lower case."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(scheme(url) == "https", F.regexp_replace(authority, ":443$", "")).otherwise(F.regexp_replace(authority, ":80$", ""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def path(url: Column) -> Column:
    """The path without query and fragment; / for a bare origin."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def normalised(url: Column) -> Column:
    """For comparison: no fragment, lower-case host, no default port, no slashes at the end of a path other than /; the query stays."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(visit_key(url), r"(\?.*)$", 1)
    return F.concat(origin(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed), query)


def apex(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def valid_hreflang(code: Column) -> Column:
    return code.rlike("(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$") | (F.lower(code) == "x-default")


def broken(status: Column) -> Column:
    return (status >= 400) & ~status.isin(401, 403, 429, 999)


def resolve_one(base: str | None, href: str | None) -> str | None:
    """href against base as a browser writes it; None if it cannot be."""
    return None if base is None or href is None else web_url.resolve(base, href)


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolve_all(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else [resolve_one(b, x) for x in h] for b, h in zip(base, hrefs, strict=True)], dtype=object)


_RANGES = {version: addresses.pairs(version) for version in (4, 6)}


def private_host(name: str | None) -> bool | None:
    """Whether a host is local by name or not a public address, for use inside a task; addresses.is_private is its column expression."""
    if name is None:
        return None
    name = name.strip().lower().strip("[]").rstrip(".")
    if name == "localhost" or name.endswith(tuple(addresses.LOCAL_ENDS)) or not name:
        return True
    try:
        address = web_url.ipv4(name) or ipaddress.ip_address(name.split("%")[0])
    except ValueError:
        return False
    mapped = getattr(address, "ipv4_mapped", None)
    address = mapped or address
    ranges = _RANGES[address.version]
    at = bisect_right(ranges, int(address), key=lambda r: r[0]) - 1
    return at >= 0 and int(address) <= ranges[at][1]


def admit_one(url: str | None) -> str | None:
    """An admitted absolute http(s) URL, or None: other schemes, hosts that cannot be, private hosts."""
    if url is None or not url.strip() or len(url) > 2048:
        return None
    url = url.strip()
    if not re.match(r"(?i)https?://", url):
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?!\d+(?:[/?#]|$))", url):
            return None
        url = "https://" + url
    read = web_url.parse(url)
    out, name = (read.href, read.host) if read else (None, None)
    if not name or (private_host(name) or "." not in name and ":" not in name):
        return None
    return out


@F.pandas_udf(T.StringType())
def admitted(urls: pd.Series) -> pd.Series:
    return urls.map(admit_one)
