"""Address rules: which addresses a fetcher may reach."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published behaviour for right results.
BLOCKED_RANGES = (
    ("127.0.0.0", 8),
    ("10.0.0.0", 8),
    ("172.16.0.0", 12),
    ("192.168.0.0", 16),
    ("169.254.0.0", 16),
    ("100.64.0.0", 10),
    ("0.0.0.0", 8),
    ("::1", 128),
    ("fc00::", 7),
    ("fe80::", 10),
)
_DOTTED = r"^(?:::[fF]{4}:)?([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def blocked_ipv4_bounds() -> list[tuple[str, int, int]]:
    """(range, first, last) as integers, for the range table and the predicate."""
    out = []
    for base, prefix in BLOCKED_RANGES:
        net = ipaddress.ip_network(f"{base}/{prefix}")
        if net.version == 4:
            out.append((str(net), int(net.network_address), int(net.broadcast_address)))
    return out


def ipv4_number(address: Column) -> Column:
    """A dotted address, plain or wrapped in ``::ffff:``, as a bigint; null when it is neither."""
    octets = [F.regexp_extract(address, _DOTTED, n) for n in range(1, 5)]
    numbers = [octet.try_cast("bigint") for octet in octets]
    valid = address.rlike(_DOTTED)
    for octet, number in zip(octets, numbers):
        # a leading zero is not a dotted-decimal address
        valid = valid & (number <= 255) & ((octet == "0") | ~octet.startswith("0"))
    return F.when(valid, ((numbers[0] * 256 + numbers[1]) * 256 + numbers[2]) * 256 + numbers[3])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: through an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address in any spelling, a zone left off; null when it is none."""

    def spelled_in_hex(plain: Column) -> Column:
        # a dotted tail stands for two groups
        tail = F.regexp_extract(plain, r":([0-9.]+)$", 1)
        head = F.substring(plain, 1, F.length(plain) - F.length(tail))
        two = lambda low: F.concat(head, F.hex(F.shiftright(low, 16)), F.lit(":"), F.hex(low.bitwiseAND(0xFFFF)))
        return F.when(tail.contains("."), _let(ipv4_number(tail), two)).otherwise(plain)

    def filled(text: Column) -> Column:
        side = lambda n: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(n)), ":", -1), lambda g: g != "")
        # the gap is at least one group
        both = lambda halves: F.concat(
            halves["left"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(halves["left"]) - F.size(halves["right"]), F.lit(1))), halves["right"]
        )
        short = _let(F.struct(side(1).alias("left"), side(2).alias("right")), both)
        # a gap of nothing, two gaps or a colon at an end are no address
        return F.when(text.rlike(":::|::.*::|^:[^:]|[^:]:$"), None).when(text.contains("::"), short).otherwise(F.split(text, ":", -1))

    def numbers(groups: Column) -> Column:
        valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        return F.when(valid, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint")))

    plain = F.split_part(address, F.lit("%"), F.lit(1))
    return _let(_let(_let(plain, spelled_in_hex), filled), numbers)


def is_public_ipv6(address: Column) -> Column:
    """True for an IPv6 address outside every blocked range; IPv4 addresses in it, however spelled, count as such."""
    return F.coalesce(_let(ipv6_groups(address), _groups_public), F.lit(False))


def _groups_public(groups: Column) -> Column:
    whole = lambda n: F.get(groups, F.lit(n))
    mapped = F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (whole(5) == 0xFFFF)
    blocked = F.lit(False)
    for base, prefix in BLOCKED_RANGES:
        if ":" in base:
            network = ipaddress.ip_network(f"{base}/{prefix}")
            want = int(network.network_address)
            inside = F.lit(True)
            for n in range(-(-prefix // 16)):
                bits = min(16, prefix - 16 * n)
                mask = 0xFFFF << (16 - bits) & 0xFFFF
                inside = inside & (whole(n).bitwiseAND(mask) == (want >> (112 - 16 * n) & mask))
            blocked = blocked | inside
    return F.when(mapped, _number_public(whole(6) * 65536 + whole(7))).otherwise(~blocked)


def _number_public(number: Column) -> Column:
    inside = F.lit(False)
    for _, first, last in blocked_ipv4_bounds():
        inside = inside | number.between(first, last)
    return ~inside


def is_public_ipv4(address: Column) -> Column:
    """JVM-only form: true for a dotted address (wrapped or not) outside every blocked range."""
    return F.coalesce(_let(ipv4_number(address), _number_public), F.lit(False))


def is_public_address(address: Column) -> Column:
    """True for an address outside every blocked range; text that is no address is never public."""
    four = lambda number: F.when(number.isNotNull(), _number_public(number))
    return F.coalesce(_let(ipv4_number(address), four), is_public_ipv6(address))
