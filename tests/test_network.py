"""Longest prefixes against a scan of all prefixes, both families, text that is no address."""

import ipaddress
import random

from pyspark.sql import functions as F

from agentlake.operators import network as N


def number(a):
    ip = ipaddress.ip_address(a)
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def test_keys(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "::", "::1", "1::", "2001:db8::ff:1", "2001:0DB8:0:0:1:2:3:4", "::ffff:10.1.2.3", "64:ff9b::1.2.3.4", " 9.8.7.6 "]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", N.address_key(F.col("a")).alias("k")).collect()
    assert {r["a"]: r["k"] for r in rows} == {t: f"{number(t.strip()):032x}" for t in texts}


def test_no_address(spark):
    texts = [None, "", "1.2.3", "1.2.3.256", "1.2.3.4.5", "01.2.3.4", "::1::", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8", "g::", "12345::", "host", "1.2.3.4:80"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", N.address_key(F.col("a")).alias("k")).collect()
    assert {r["a"]: r["k"] for r in rows} == dict.fromkeys(texts)


def test_longest_prefix(spark):
    rnd = random.Random(3)
    nets = {"0.0.0.0/0", "::/0", "10.0.0.0/8", "10.0.0.0/7", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "10.128.0.0/9", "2000::/3", "2001:db8::/32", "2001:db8::/48", "2001:db8:0:1::/64", "fe80::/10"}
    for _ in range(120):
        b = rnd.randrange(3, 33)
        nets.add(str(ipaddress.ip_network((rnd.getrandbits(32) >> 32 - b << 32 - b, b))))
        b = rnd.randrange(2, 65)
        nets.add(str(ipaddress.ip_network((rnd.choice([0x20010DB8 << 96, 0x2A02 << 112, 0]) | rnd.getrandbits(90) >> 128 - b - 20 << 128 - b if b > 58 else rnd.getrandbits(128) >> 128 - b << 128 - b, b))))
    nets = sorted(nets)
    parsed = [(ipaddress.ip_network(n), n) for n in nets]
    addresses = [str(x[rnd.choice([0, -1])]) for x, _ in parsed]
    addresses += [str(ipaddress.ip_address(rnd.getrandbits(32))) for _ in range(300)] + [str(ipaddress.ip_address(rnd.getrandbits(128))) for _ in range(100)]
    addresses += [f"10.1.{rnd.randrange(4)}.{rnd.randrange(5)}" for _ in range(40)] + [f"2001:db8:0:{rnd.randrange(3)}::{rnd.randrange(9)}" for _ in range(40)]
    want = {}
    for a in addresses:
        ip = ipaddress.ip_address(a)
        over = [(x.prefixlen, n) for x, n in parsed if x.version == ip.version and ip in x]
        want[a] = max(over)[1] if over else None
    rows = spark.createDataFrame([(a, 7) for a in addresses] + [("none", 7), (None, 7)], "ip string, value int")
    got = N.with_network(rows, "ip", spark.createDataFrame([(n, n) for n in nets], "cidr string, value string"), "net").collect()
    assert len(got) == len(addresses) + 2 and {r["ip"]: r["net"] for r in got} == want | {"none": None, None: None}


def test_repeated_and_bad_prefixes(spark):
    table = spark.createDataFrame([("10.0.0.0/8", "b"), ("10.0.0.0/8", "a"), ("10.9.9.9/8", "c"), ("x/8", "d"), ("10.0.0.0", "e"), ("1.0.0.0/40", "f")], "cidr string, value string")
    rows = spark.createDataFrame([("10.1.1.1",), ("11.0.0.0",)], "ip string")
    assert {r["ip"]: r["v"] for r in N.with_network(rows, "ip", table, "v").collect()} == {"10.1.1.1": "a", "11.0.0.0": None}
