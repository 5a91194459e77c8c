"""IP addresses as strings: sortable keys, ranges, and the predicates that detections use.

An address's *key* is its 128-bit value as 32 hexadecimal digits; IPv4 addresses map to
``::ffff:a.b.c.d``. Keys compare like addresses, so CIDR containment is a range predicate, and a
masked key is an equi-join key. All of it is expressions; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let

# Prefixes of internal addresses, as strings.
PRIVATE_PREFIXES = (
    "10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.", "172.22.", "172.23.", "172.24.",
    "172.25.", "172.26.", "172.27.", "172.28.", "172.29.", "172.30.", "172.31.", "127.", "169.254.", "fe80:",
)
# Destinations of content networks, whose keepalives look like beacons.
CDN_PREFIXES = (
    "104.16.", "104.17.", "104.18.", "104.19.", "104.20.", "104.21.", "104.22.", "104.23.", "104.24.", "104.25.", "104.26.", "104.27.",
    "172.64.", "172.65.", "172.66.", "172.67.", "172.68.", "172.69.", "172.70.", "172.71.", "2606:4700",
    "151.101.", "146.75.", "199.232.", "2a04:4e42",
    "142.250.", "142.251.", "172.217.", "216.58.", "172.253.", "74.125.", "2607:f8b0",
    "17.", "2620:149",
    "23.32.", "23.33.", "23.34.", "23.35.", "23.192.", "23.193.", "2.16.", "2.17.",
)
# Special-purpose registries (IANA) as the standard library's is_private has them.
PRIVATE_NETS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "100::/64", "2001::/23", "2001:db8::/32", "3fff::/20", "fc00::/7", "fe80::/10",
)
PRIVATE_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
SHARED_NET = "100.64.0.0/10"

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = f"^{_OCTET}(\\.{_OCTET}){{3}}$"


def is_v4(ip: Column) -> Column:
    return ip.rlike(V4)


def _hex(number: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(number), width, "0"))


def _v4_hex(ip: Column) -> Column:
    return let(F.split(ip, "\\."), lambda p: F.concat(*[_hex(F.get(p, F.lit(i)).try_cast("long"), 2) for i in range(4)]))


def _v6_groups(s: Column) -> Column:
    """The eight groups of a lower-case IPv6 string without dots, or null."""
    groups = lambda h: F.filter(F.split(h, ":", -1), lambda x: x != "")

    def whole(halves: Column) -> Column:
        left = groups(F.get(halves, F.lit(0)))
        right = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        gap = lambda p: F.when(F.size(halves) == 2, F.greatest(F.lit(8) - F.size(p["l"]) - F.size(p["r"]), F.lit(0))).otherwise(F.lit(0))
        parts = let(F.struct(left.alias("l"), right.alias("r")), lambda p: F.concat(p["l"], F.array_repeat(F.lit("0"), gap(p)), p["r"]))
        # '::' stands for one group at least
        full = F.when(F.size(halves) == 2, F.size(groups(s)) < 8).otherwise(True)
        return F.when((F.size(halves) <= 2) & full, parts)

    good = s.contains(":") & ~s.rlike(":::|^:[^:]|[^:]:$")
    found = let(F.split(s, "::", -1), whole)
    return let(found, lambda g: F.when(good & (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), g))


def key(ip: Column) -> Column:
    """The address's key, or null if the string is no address."""

    def six(s: Column) -> Column:
        tail = F.regexp_extract(s, "^.*:([0-9.]+)$", 1)
        # a dotted tail becomes two groups
        plain = let(_v4_hex(tail), lambda h: F.concat(F.regexp_extract(s, "^(.*:)[0-9.]+$", 1), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        text = F.when(s.contains(".") & is_v4(tail), plain).otherwise(s)
        return let(text, lambda t: F.array_join(F.transform(_v6_groups(t), lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(is_v4(ip), F.concat(F.lit("00000000000000000000ffff"), _v4_hex(ip))).when(ip.contains(":"), let(F.lower(ip), six))


def canonical(ip: Column) -> Column:
    """The address in its compressed form (RFC 5952); other strings as they are."""

    def compressed(joined: Column) -> Column:
        # the longest run of at least two zero groups, the first of equally long ones
        out = joined
        for n in range(2, 9):
            run = ":".join(["0"] * n)
            short = F.regexp_replace(F.regexp_replace(joined, f"^(.*?)(^|:){run}(:|$)(.*)$", "$1::$4"), ":::+", "::")
            out = F.when(joined.rlike(f"(^|:){run}(:|$)"), short).otherwise(out)
        return out

    def form(k: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(k, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        return F.when(k.isNotNull(), let(F.array_join(parts, ":"), compressed)).otherwise(ip)

    return F.when(is_v4(ip), ip).otherwise(let(key(ip), form))


def _bounds(net: str) -> tuple[str, str]:
    import ipaddress

    n = ipaddress.ip_network(net, strict=False)
    if n.version == 4:
        return tuple(f"00000000000000000000ffff{int(a):08x}" for a in (n.network_address, n.broadcast_address))
    return tuple(f"{int(a):032x}" for a in (n.network_address, n.broadcast_address))


def _inside(k: Column, nets: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for net in nets:
        low, high = _bounds(net)
        hit = hit | k.between(low, high)
    return F.coalesce(hit, F.lit(False))


def in_nets(ip: Column, nets: tuple[str, ...]) -> Column:
    """Whether an address lies in one of a few given networks; false for other strings."""
    return let(key(ip), lambda k: _inside(k, nets))


def _starts(ip: Column, prefixes: tuple[str, ...]) -> Column:
    return ip.rlike("^(" + "|".join(p.replace(".", "\\.") for p in prefixes) + ")") if prefixes else F.lit(False)


def is_multicast(ip: Column) -> Column:
    """IPv4 224-239 and 255 by first octet, IPv6 ff00::/8 by prefix; malformed addresses are not."""
    first = F.get(F.split(ip, "\\."), F.lit(0)).try_cast("int")
    return F.coalesce(F.lower(F.substring(ip, 1, 2)) == "ff", F.lit(False)) | F.coalesce(first.between(224, 239) | (first == 255), F.lit(False))


def is_external(ip: Column, extra: tuple[str, ...] = ()) -> Column:
    """Not empty, not multicast, no internal string prefix; IPv6 neither private nor link-local.

    A string with a colon that is no address is not external; other malformed strings are, as
    they have no internal prefix.
    """
    v6 = let(key(ip), lambda k: k.isNotNull() & (~_inside(k, PRIVATE_NETS) | _inside(k, PRIVATE_EXCEPT)))
    out = ~is_multicast(ip) & ~_starts(ip, PRIVATE_PREFIXES + extra) & F.when(ip.contains(":"), v6).otherwise(True)
    return F.coalesce((ip != "") & out, F.lit(False))


def _internal_key(k: Column) -> Column:
    return _inside(k, PRIVATE_NETS) & ~_inside(k, PRIVATE_EXCEPT)


def is_internal(ip: Column) -> Column:
    """Private or link-local by address registries, documentation and benchmark nets included. Not the complement of is_external."""
    return let(key(ip), _internal_key)


def is_global(ip: Column) -> Column:
    """A valid address outside all private nets and outside 100.64.0.0/10."""
    return let(key(ip), lambda k: k.isNotNull() & ~_internal_key(k) & ~_inside(k, (SHARED_NET,)))


def is_beacon_noise(ip: Column, allow: tuple[str, ...] = ()) -> Column:
    """Multicast, allowed resolvers and content networks."""
    return is_multicast(ip) | F.coalesce(ip.isin(*allow) if allow else F.lit(False), F.lit(False)) | F.coalesce(_starts(ip, CDN_PREFIXES), F.lit(False))


def subnet(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /64 of an IPv6 one, as a key prefix."""
    return let(key(ip), lambda k: F.when(is_v4(ip), F.substring(k, 1, 30)).otherwise(F.substring(k, 1, 16)))


def mask(k: Column, length: Column) -> Column:
    """A key cut to its first ``length`` bits (on the 128-bit scale): a string to join on."""
    full = (length / 4).cast("int")
    rest = length % 4
    digit = F.conv(F.substring(k, full + 1, F.lit(1)), 16, 10).cast("int")
    top = F.call_function("shiftright", digit, (F.lit(4) - rest).cast("int"))
    return F.concat(F.substring(k, F.lit(1), full), F.when(rest > 0, F.concat(F.lit("/"), top.cast("string"))).otherwise(F.lit("")))


def net_length(cidr: Column) -> Column:
    """Prefix length of a network or address string, on the 128-bit scale; null if it is neither."""
    base = F.get(F.split(cidr, "/"), F.lit(0))
    given = F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int")
    v4 = is_v4(base)
    most = F.when(v4, 32).otherwise(128)
    n = F.when(~cidr.contains("/"), most).when(given.between(0, most), given)
    return F.when(key(base).isNotNull(), n + F.when(v4, 96).otherwise(0))
