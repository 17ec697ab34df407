"""Address literals in host names and the ranges that are not public, as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address ranges that are not public.
NOT_PUBLIC = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "::/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
]
#: Ends of names that are local.
LOCAL_ENDS = [".localhost", ".local", ".internal", ".home.arpa"]


def pairs(version: int) -> list[tuple[int, int]]:
    """First and last address of each range of a version, sorted; ranges that touch are one."""
    nets = [n for n in map(ipaddress.ip_network, NOT_PUBLIC) if n.version == version]
    out: list[tuple[int, int]] = []
    for first, last in sorted((int(n.network_address), int(n.broadcast_address)) for n in nets):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def bare(host: Column) -> Column:
    """Lower case, without brackets, white space at the ends and dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\[+|\]+$", ""), r"\.+$", "")


def _number(part: Column) -> Column:
    """A decimal, octal (0...) or hexadecimal (0x...) number up to 32 bits or so; null if it is none or longer."""
    digits = lambda pattern: F.regexp_extract(part, pattern, 1)
    read = lambda s, base, most: F.when(F.length(s) <= most, F.conv(F.when(s == "", F.lit("0")).otherwise(s), base, 10).cast("long"))
    return (
        F.when(part.rlike("^0x[0-9a-f]*$"), read(digits("^0x0*([0-9a-f]*)$"), 16, 8))
        .when(part.rlike("^0[0-7]*$"), read(digits("^0+([0-7]*)$"), 8, 11))
        .when(part.rlike("^[1-9][0-9]*$"), read(part, 10, 10))
    )


def _with(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv4(name: Column) -> Column:
    """The number of an IPv4 address as browsers read one, such as 127.1, 0x7f.1 or 2130706433; null for other names.

    One to four numbers; all but the last below 256, the last fills what bytes are left.
    """

    def joined(numbers: Column) -> Column:
        before, last, n = F.slice(numbers, F.lit(1), F.size(numbers) - 1), F.element_at(numbers, -1), F.size(numbers)
        whole = F.aggregate(before, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        left = F.get(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n - 1)
        return F.when(F.forall(before, lambda x: x < 256) & (last < left), whole * left + last)

    able = (F.length(name) <= 255) & name.rlike(r"^(?:[0-9][0-9a-fx]*\.){0,3}[0-9][0-9a-fx]*$")
    return F.when(able, _with(F.transform(F.split(name, r"\.", -1), _number), joined))


def _hextets(octets: Column) -> Column:
    """Four octets as two groups of an IPv6 address; null if one is no number below 256."""
    pair = lambda i: F.lower(F.hex((F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))).cast("long")))
    return F.when(F.forall(octets, lambda o: o < 256), F.concat(pair(0), F.lit(":"), pair(2)))


def ipv6(name: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null for other names. A dotted IPv4 address may stand at its end."""
    none = F.array().cast("array<string>")
    groups = lambda s: F.when(s == "", none).otherwise(F.split(s, ":", -1))

    def undotted(name: Column) -> Column:
        dotted = F.regexp_extract(name, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
        octets = F.transform(F.split(dotted, r"\.", -1), lambda p: F.when(p.rlike("^(?:0|[1-9][0-9]*)$"), p.cast("int")))
        return F.when(dotted == "", name).otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(dotted)), _with(octets, _hextets)))

    def filled(ends: Column) -> Column:
        """ends: the groups before and after a ``::``, or all groups."""
        first, rest, given = F.get(ends, F.lit(0)), F.get(ends, F.lit(1)), F.size(F.flatten(ends))
        return F.when((F.size(ends) == 1) & (given == 8), first).when((F.size(ends) == 2) & (given <= 7), F.concat(first, F.array_repeat(F.lit("0"), 8 - given), rest))

    def digits(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    ends = F.transform(F.split(_with(name, undotted), "::", -1), groups)
    return F.when((F.length(name) <= 64) & name.contains(":"), _with(_with(ends, filled), digits))


def not_public_ipv4(number: Column) -> Column:
    return _with(number, lambda x: reduce(lambda a, b: a | b, [x.between(first, last) for first, last in pairs(4)]))


def not_public_ipv6(digits: Column) -> Column:
    """An IPv4 address that is mapped into IPv6 is judged as such."""

    def judged(d: Column) -> Column:
        inside = reduce(lambda a, b: a | b, [d.between(f"{first:032x}", f"{last:032x}") for first, last in pairs(6)])
        return F.when(d.startswith("0" * 20 + "ffff"), not_public_ipv4(F.conv(F.substring(d, 25, 8), 16, 10).cast("long"))).otherwise(inside)

    return _with(digits, judged)


def is_private(host: Column) -> Column:
    """Whether a host is local by name or an address that is not public; null for null. Runs in the JVM."""

    def judged(name: Column) -> Column:
        zoneless = F.substring_index(name, "%", 1)
        local = (name == "") | (name == "localhost") | reduce(lambda a, b: a | b, [name.endswith(e) for e in LOCAL_ENDS])
        return F.when(local, True).otherwise(F.coalesce(not_public_ipv4(ipv4(zoneless)), not_public_ipv6(ipv6(zoneless)), F.when(name.isNotNull(), False)))

    return _with(bare(host), judged)
