"""Which public pages may be asked for: addresses in one form or the reason why not, and blocks of numeric hosts.

A numeric address is 128 bits, written as text of 0 and 1; IPv4 addresses are the mapped ones of IPv6. A block is a prefix of bits, so
the blocks that hold an address are found by equality of prefixes, one for each length that the blocks have, and not by comparing
ranges: an equi-join of a few keys a row, whatever the number of blocks. The longest prefix decides.

Defined results: null and empty addresses are ``no_address``; what is no numeric address has null bits and is in no block.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Blocks that aren't public, and the public ones inside these.
NOT_PUBLIC = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "255.255.255.255/32 ::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 fc00::/7 fe80::/10"
).split()
PUBLIC_INSIDE = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_MAPPED = "0" * 80 + "1" * 16


def block_bits(block: str) -> str:
    """The prefix of a block, of mapped IPv4 blocks too."""
    network = ipaddress.ip_network(block)
    bits = f"{int(network.network_address):0{network.max_prefixlen}b}"[: network.prefixlen]
    return bits if network.version == 6 else _MAPPED + bits


def _binary(c: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(c, base, 2), width, "0")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value named: written out at each use, values that are made of others double the plan again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_bits(c: Column) -> Column:
    """128 bits of a numeric address, with or without brackets; null for anything else."""
    octets = lambda a, octet: F.array_join(F.transform(F.split(a, r"\."), octet), "")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def expanded(plain: Column, tail: Column) -> Column:
        """A dotted tail of an IPv6 address is its last two groups."""
        hexed = octets(tail, lambda x: F.lpad(F.lower(F.conv(x, 10, 16)), 2, "0"))
        return F.when(tail.rlike(_V4), F.concat(F.substr(plain, F.lit(1), F.length(plain) - F.length(tail)), F.substring(hexed, 1, 4), F.lit(":"), F.substring(hexed, 5, 4))).otherwise(plain)

    def v6(long: Column) -> Column:
        short = F.instr(long, "::") > 0
        sides = F.struct(groups(F.substring_index(long, "::", 1)).alias("l"), groups(F.when(short, F.substring_index(long, "::", -1)).otherwise("")).alias("r"))
        shaped = long.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")

        def filled(of: Column) -> Column:
            fill = 8 - F.size(of["l"]) - F.size(of["r"])
            all_ = F.concat(of["l"], F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), of["r"])
            return F.when(F.when(short, fill >= 1).otherwise(fill == 0), F.array_join(F.transform(all_, lambda g: _binary(g, 16, 16)), ""))

        return F.when(shaped, _let(sides, filled))

    def bits(plain: Column) -> Column:
        long = _let(F.regexp_extract(plain, r"([^:]*)$", 1), lambda tail: expanded(plain, tail))
        v4 = F.concat(F.lit(_MAPPED), octets(plain, lambda x: _binary(x, 10, 8)))
        return F.when(plain.rlike(_V4), v4).when(F.instr(plain, ":") > 0, _let(long, v6))

    return _let(F.regexp_replace(F.lower(F.trim(c)), r"^\[|\]$", ""), bits)


def blocks(spark: SparkSession, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """``(bits, kind)`` of blocks by their kind."""
    kinds = kinds or {"not_public": NOT_PUBLIC, "public": PUBLIC_INSIDE}
    return spark.createDataFrame([(block_bits(b), kind) for kind, found in kinds.items() for b in found], "bits string, kind string")


#: Blocks that are sent to all tasks; more of them are dealt out and joined.
SENT_BLOCKS = 100_000


def located(df: DataFrame, bits: str, table: DataFrame, name: str = "kind", sent: int = SENT_BLOCKS) -> DataFrame:
    """``df`` with the kind of the longest block that holds the address; null where none does. Blocks that come twice must agree, else the smaller kind counts.

    The prefixes are those of each address once, however many rows have it.
    """
    lengths = {r[0]: r[1] for r in table.where("bits is not null").groupBy(F.length("bits")).count().collect()}  # 129 at most
    one = table.groupBy(F.col("bits").alias("_prefix")).agg(F.min("kind").alias("_kind"))
    found = df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("_located")).distinct()
    prefixes = found.select("_located", F.explode(F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: F.substr("_located", F.lit(1), n))).alias("_prefix"))
    held = prefixes.join(F.broadcast(one) if sum(lengths.values()) <= sent else one, "_prefix")
    best = held.groupBy("_located").agg(F.max(F.struct(F.length("_prefix").alias("n"), "_kind"))["_kind"].alias(name))
    return df.join(best, F.col(bits) == F.col("_located"), "left").drop("_located")


def page_address(c: Column) -> Column:
    """``(url, host, problem)`` of a page's address: https alone, no credentials, fragments, other ports or hosts that read as numbers. A numeric host is left to :func:`located`."""
    url = F.trim(c)
    part = lambda i: F.regexp_extract(url, _URL, i)
    netloc, scheme = part(2), F.lower(part(1))
    server = F.regexp_extract(netloc, r"^(?:.*@)?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    labels = F.split(host, r"\.")
    numeric = F.forall(labels, lambda x: x.rlike(r"^\d+$")) | F.exists(labels, lambda x: x.rlike(r"^0x|^0\d+$"))
    problem = (
        F.when(F.coalesce(url, F.lit("")) == "", "no_address").when(F.contains(netloc, F.lit("%")), "percent_host").when((scheme != "https") | (host == ""), "not_https").when(F.contains(netloc, F.lit("@")), "credentials")
        .when(F.length(part(5)) > 1, "fragment").when(~port.isin("", "443"), "port").when((host == "localhost") | host.endswith(".localhost"), "local").when(numeric, "numeric_host")
    )
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.struct(F.when(problem.isNull(), F.concat(F.lit("https://"), host, path, query)).alias("url"), host.alias("host"), problem.alias("problem"))


def checked_pages(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``page`` (url, host, problem): numeric hosts in a block that isn't public are ``not_public`` too."""
    found = df.withColumn("_page", page_address(F.col(url))).withColumn("_bits", address_bits(F.col("_page.host")))
    found = located(found, "_bits", blocks(df.sparkSession), "_kind")
    bad = F.col("_page.problem").isNull() & (F.col("_kind") == "not_public")
    odd = F.col("_page.problem").isNull() & F.col("_page.host").startswith("[") & F.col("_bits").isNull()
    problem = F.when(bad, "not_public").when(odd, "not_https").otherwise(F.col("_page.problem"))
    return found.select(*df.columns, F.struct(F.when(problem.isNull(), F.col("_page.url")).alias("url"), F.col("_page.host").alias("host"), problem.alias("problem")).alias("page"))
