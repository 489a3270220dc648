"""IP addresses as strings of bits.

An address becomes 32 or 128 characters of 0/1 and a CIDR block the first bits of that
text, so "is in the block" is an equality of prefixes.  That turns the range join into
an ordinary hash join.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _bin(text: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(text, base, 2), width, "0")


def is_v4(ip: Column) -> Column:
    return ip.rlike(_V4)


def _v4_bits(ip: Column) -> Column:
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o: _bin(o, 10, 8)), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def _undotted(text: Column) -> Column:
    """A dotted tail (::ffff:1.2.3.4) rewritten as the two groups it stands for."""

    def rewrite(parts):
        octet = lambda i: F.lpad(F.conv(F.try_element_at(parts, F.lit(i)), 10, 16), 2, "0")
        tail = F.concat(octet(1), octet(2), F.lit(":"), octet(3), octet(4))
        return F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.lower(tail))

    tail = F.regexp_extract(text, r":([0-9.]+)$", 1)
    return F.when(~text.contains("."), text).when(
        tail.rlike(_V4), _let(F.split(tail, r"\."), rewrite)
    )


def _expanded(text: Column) -> Column:
    """The groups of a well-formed text, with '::' filled up to eight."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    head = groups(F.substring_index(text, "::", 1))
    rest = F.when(text.contains("::"), groups(F.substring_index(text, "::", -1))).otherwise(
        F.array().cast("array<string>")
    )

    def fill(sides):
        used = F.size(sides["head"]) + F.size(sides["rest"])
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - used, F.lit(0)))
        full = F.when(text.contains("::"), used <= 7).otherwise(used == 8)
        return F.when(full, F.concat(sides["head"], gap, sides["rest"]))

    side = r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)"
    well_formed = text.rlike(rf"^(?:{side}|{side}?::{side}?)$")
    return F.when(well_formed, _let(F.struct(head.alias("head"), rest.alias("rest")), fill))


def v6_groups(ip: Column) -> Column:
    """The eight 4-digit groups of an IPv6 text, or NULL if it is not one."""
    bare = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    groups = _let(bare, lambda t: _let(_undotted(t), _expanded))
    return F.transform(groups, lambda g: F.lpad(g, 4, "0"))


def address_bits(ip: Column) -> Column:
    """32 or 128 characters of 0/1; NULL for a text that is no address."""
    v6 = F.array_join(F.transform(v6_groups(ip), lambda g: _bin(g, 16, 16)), "")
    return F.when(is_v4(ip), _v4_bits(ip)).when(ip.contains(":"), v6)


def block_prefix(cidr: Column) -> Column:
    """First bits shared by a CIDR block (host bits ignored); NULL if malformed.

    A bare address is a block of one.
    """
    plen = F.regexp_extract(cidr, r"^[^/]+/([0-9]{1,3})$", 1).try_cast("int")

    def cut(bits):
        return F.when(~cidr.contains("/"), bits).when(
            plen <= F.length(bits), F.substring(bits, F.lit(1), plen)
        )

    return _let(address_bits(F.substring_index(cidr, "/", 1)), cut)


def mask_ip(ip: Column) -> Column:
    """Hide the last IPv4 octet, or all but three IPv6 groups; 'x' for anything else."""
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".x"))
    v6 = F.concat(F.array_join(F.slice(v6_groups(ip), 1, 3), ":"), F.lit(":x"))
    return F.when(is_v4(ip), v4).when(ip.contains(":"), F.coalesce(v6, F.lit("x"))).otherwise("x")
