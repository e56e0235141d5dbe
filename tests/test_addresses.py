"""Numeric addresses and blocks against Python's own, and pages by hand."""

import ipaddress
import random

import pytest

from cohortlens.functions import addresses
from pyspark.sql import functions as F

ODD = ["", None, "1.2.3", "256.1.1.1", "01.2.3.4", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", ":1", "1:", "g::", "::", "::1", "1::", "::ffff:10.0.0.1", "[::1]", "1:2:3:4:5:6:1.2.3.4", "host.name", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":::"]


def test_bits(spark):
    rng = random.Random(1)
    texts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)] + ODD
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", addresses.address_bits(F.col("t")).alias("b")).collect()
    for r in rows:
        text = texts[r["i"]]
        try:
            a = ipaddress.ip_address((text or "").strip("[]"))
            expected = f"{int(a):0128b}" if a.version == 6 else "0" * 80 + "1" * 16 + f"{int(a):032b}"
        except ValueError:
            expected = None
        assert r["b"] == expected, text


def test_blocks(spark):
    rng = random.Random(2)
    nets = [ipaddress.ip_network(b) for b in [*addresses.NOT_PUBLIC, *addresses.PUBLIC_INSIDE]]
    texts = [str(n[rng.randrange(min(n.num_addresses, 2**60))]) for n in nets for _ in range(6)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(100)] + ["2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8"]

    def kind(text):
        a = ipaddress.ip_address(text)
        a = getattr(a, "ipv4_mapped", None) or a
        hit = [(n.prefixlen, "not_public" if str(n) in addresses.NOT_PUBLIC else "public") for n in nets if n.version == a.version and a in n]
        return max(hit)[1] if hit else None

    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).withColumn("b", addresses.address_bits(F.col("t")))
    found = addresses.located(df, "b", addresses.blocks(spark)).collect()
    assert len(found) == len(texts) and all(r["kind"] == kind(r["t"]) for r in found)
    assert addresses.located(df, "b", addresses.blocks(spark).limit(0)).where("kind is not null").count() == 0


def test_blocks_that_are_dealt_out(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["10.0.0.1", "10.0.0.1", "8.8.8.8", "192.0.0.9", "x", None])], "i int, t string").withColumn("b", addresses.address_bits(F.col("t")))
    got = {r["i"]: r["kind"] for r in addresses.located(df, "b", addresses.blocks(spark), sent=0).collect()}
    assert got == {0: "not_public", 1: "not_public", 2: None, 3: "public", 4: None, 5: None}


def test_plan_of_bits_is_small(spark):
    """A plan in which each value is written out at each use takes the driver's memory, however few rows there are."""
    df = spark.range(1).select(addresses.address_bits(F.col("id").cast("string")).alias("b"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 5_000


@pytest.mark.parametrize(
    ("url", "expected", "problem"),
    [
        (" https://Example.ORG. ", "https://example.org/", None), ("https://example.org:443/a/b?q=1", "https://example.org/a/b?q=1", None), ("HTTPS://example.org?x", "https://example.org/?x", None), ("https://example.org/#", "https://example.org/", None),
        ("http://example.org", None, "not_https"), ("https:///x", None, "not_https"), ("example.org", None, "not_https"), ("https://u:p@example.org/", None, "credentials"), ("https://example.org/#a", None, "fragment"),
        ("https://example.org:8443/", None, "port"), ("https://localhost/", None, "local"), ("https://a.localhost./", None, "local"), ("https://127.0.0.1/", None, "numeric_host"), ("https://2130706433/", None, "numeric_host"), ("https://0x7f.1/", None, "numeric_host"),
        ("https://a.010/", None, "numeric_host"), ("https://%6cocalhost/", None, "percent_host"), ("https://[::1]/", None, "not_public"), ("https://[fe80::1]/x", None, "not_public"), ("https://[2606:4700::1111]/x", "https://[2606:4700::1111]/x", None),
        ("https://[::ffff:10.0.0.1]/", None, "not_public"), ("https://[zz]/", None, "not_https"), ("", None, "no_address"), (None, None, "no_address"),
    ],
)
def test_pages(pages, url, expected, problem):
    assert pages[url] == (expected, problem)


@pytest.fixture(scope="module")
def pages(spark, request):
    urls = [a[0] for m in test_pages.pytestmark for a in m.args[1]]
    found = addresses.checked_pages(spark.createDataFrame([(u,) for u in urls], "u string"), "u").collect()
    return {r["u"]: (r["page"]["url"], r["page"]["problem"]) for r in found}
