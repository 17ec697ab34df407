import ipaddress
import random

from pyspark.sql import functions as F

from crawlgauge.functions import addresses as A
from crawlgauge.functions import urls, web_url

NETS = [ipaddress.ip_network(n) for n in A.NOT_PUBLIC]
#: host, number of the IPv4 address that it is read as.
SPELLED = [
    ("127.0.0.1", 2130706433), ("127.1", 2130706433), ("0x7f.1", 2130706433), ("0177.0.0.01", 2130706433), ("2130706433", 2130706433), ("0x7F000001", 2130706433), ("1.2.3", 16908291), ("0", 0), ("0x", 0), ("255.255.255.255", 2**32 - 1), ("4294967295", 2**32 - 1),
    ("00000000000000000001.0x0000000000000000000002", 16777218), ("4294967296", None), ("256.1", None), ("1.256.1", None), ("1.2.3.256", None), ("1.2.65536", None), ("08.1", None), ("1.2.3.4.5", None), ("1..2", None), ("", None), ("a.1", None), ("0xg", None), ("99999999999999999999999999", None), ("0xfffffffffffffffffffff", None), (None, None),
]


def brute(host):
    address = ipaddress.ip_address(host)
    address = getattr(address, "ipv4_mapped", None) or address
    return any(address in n for n in NETS if n.version == address.version)


def test_ranges_are_sorted_apart_and_whole():
    for version in (4, 6):
        got = A.pairs(version)
        assert all(a[1] + 1 < b[0] for a, b in zip(got, got[1:]))
        nets = [n for n in NETS if n.version == version]
        for first, last in got:
            for x, inside in ((first - 1, False), (first, True), (last, True), (last + 1, False)):
                if 0 <= x < 2 ** (32 if version == 4 else 128):
                    assert any(int(n.network_address) <= x <= int(n.broadcast_address) for n in nets) == inside


def test_spellings_of_ipv4(spark):
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(SPELLED)], "i int, host string, expected long")
    assert rows.withColumn("got", A.ipv4(A.bare(F.col("host")))).where("not (got <=> expected)").collect() == []
    for host, number in SPELLED:
        if host:
            got = web_url.ipv4(host.lower())
            assert (None if got is None else int(got)) == number, host


def test_addresses_against_brute_force(spark):
    rng = random.Random(3)
    hosts = []
    for net in NETS:
        for x in (int(net.network_address), int(net.broadcast_address), int(net.network_address) - 1, int(net.broadcast_address) + 1, int(net.network_address) + rng.randrange(net.num_addresses)):
            if 0 <= x < 2**net.max_prefixlen:
                a = ipaddress.ip_address(x) if net.version == 4 else ipaddress.IPv6Address(x)
                hosts += [str(a), a.exploded.upper()] + ([f"::ffff:{a}", f"::ffff:{x >> 16:x}:{x & 0xFFFF:x}"] if net.version == 4 else [])
    hosts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(100)]
    rows = spark.createDataFrame([(h, brute(h)) for h in hosts], "host string, expected boolean")
    out = rows.withColumns({"got": A.is_private(F.col("host")), "bracketed": A.is_private(F.concat(F.lit("["), F.col("host"), F.lit("]")))})
    assert out.where("not (got <=> expected and bracketed <=> expected)").collect() == [] and len(hosts) > 300
    assert all(urls.private_host(h) == brute(h) for h in hosts)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()


def test_what_is_no_address(spark):
    hosts = {"": True, "localhost": True, "LOCALHOST.": True, "a.localhost": True, "x.internal.": True, "localhost.example": False, "1::2::3": False, "1:2:3:4:5:6:7": False, "1:2:3:4:5:6:7:8:9": False, "::fffff": False, "1:2:3:4:5:6:7::": False, ":::": False, "::1.2.3.256": False, "fe80::1%eth0": True, "é.example": False, "x" * 5000: False, ":" * 5000: False}
    rows = spark.createDataFrame([*hosts.items(), (None, None)], "host string, expected boolean")
    assert rows.withColumn("got", A.is_private(F.col("host"))).where("not (got <=> expected)").collect() == []
