"""Private networks as integer and text comparisons."""

from __future__ import annotations

from ipaddress import IPv4Network, ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import any_of, let

#: Loopback, private use, link-local, this network, broadcast, unique local.
PRIVATE = ("127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "fe80::/10", "0.0.0.0/8", "255.255.255.255/32", "fc00::/7")

_V4 = r"\A([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\z"


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octets = F.transform(F.split(F.when(ip.rlike(_V4), ip), r"\."), lambda o: o.cast("long"))
    number = lambda o: F.when(F.array_max(o) < 256, o[0] * (1 << 24) + o[1] * (1 << 16) + o[2] * (1 << 8) + o[3])
    return let(octets, number)


def ipv6_digits(ip: Column) -> Column:
    """An IPv6 address as its 32 hexadecimal digits; null for anything else."""
    halves = F.split(F.lower(ip), "::", -1)
    groups = lambda text: F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ":", -1))
    left, right = groups(F.get(halves, 0)), F.when(F.size(halves) > 1, groups(F.get(halves, 1))).otherwise(F.expr("cast(array() as array<string>)"))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    digits = F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(ip.contains(":") & (F.size(halves) <= 2) & digits.rlike(r"\A[0-9a-f]{32}\z"), digits)


def in_networks(ip: Column, networks: tuple[str, ...] = PRIVATE) -> Column:
    """Whether an address lies in one of the networks; null for what is no address."""
    parsed = [ip_network(n) for n in networks]
    in4 = lambda v: any_of([v.between(int(n.network_address), int(n.broadcast_address)) for n in parsed if isinstance(n, IPv4Network)])
    in6 = lambda v: any_of([v.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in parsed if not isinstance(n, IPv4Network)])
    # each form is read once, and only addresses that are not IPv4 are looked at as IPv6
    return let(ipv4_number(ip), lambda v: F.when(v.isNotNull(), in4(v)).otherwise(let(F.when(ip.contains(":"), ipv6_digits(ip)), lambda w: F.when(w.isNotNull(), in6(w)))))
