"""Strings: entropy, domain names, generated-domain score, normal forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let

# Two-level public suffixes for grouping subdomains.
TWO_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "com.cn", "com.mx", "co.za", "co.in", "co.kr",
)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty or null string."""
    n = F.length(s)
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    # summed in order of share, so that the last digits do not depend on the order of characters
    shares = F.array_sort(F.transform(chars, share))
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def _labels(name: Column) -> Column:
    return F.split(F.lower(F.rtrim(F.coalesce(name, F.lit("")), F.lit("."))), "\\.", -1)


def registered_parent(name: Column, suffixes: tuple[str, ...] = TWO_LEVEL_SUFFIXES) -> Column:
    """The registered domain: the last two labels, or three under a two-level suffix; a single label as it is."""

    def parent(parts: Column) -> Column:
        n = F.size(parts)
        last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
        return F.when(n < 2, F.coalesce(name, F.lit(""))).when((n >= 3) & last(2).isin(*suffixes), last(3)).otherwise(last(2))

    return let(_labels(name), parent)


def registered_label(name: Column) -> Column:
    """The last label but one, empty labels left out; '' if there are fewer than two."""
    parts = F.filter(F.split(F.coalesce(name, F.lit("")), "\\."), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) >= 2, F.get(p, F.size(p) - 2)).otherwise(F.lit("")))


def dga_score(name: Column) -> Column:
    """0 to 1: how much the registered label looks generated; 0 under eight characters.

    35 % entropy (of 4 bits), 25 % longest run of consonants (of 6), 20 % lack of vowels (under
    30 %), 20 % digits (of 30 %). Consonants are ASCII letters.
    """

    def score(label: Column) -> Column:
        n = F.length(label)
        part = lambda pattern: F.length(F.regexp_replace(label, f"[^{pattern}]", "")) / n
        runs = F.transform(F.regexp_extract_all(label, F.lit("([B-DF-HJ-NP-TV-Zb-df-hj-np-tv-zAEIOU]+)"), F.lit(1)), F.length)
        run = F.coalesce(F.array_max(runs), F.lit(0))
        total = (
            0.35 * F.least(entropy(label) / 4.0, F.lit(1.0)) + 0.25 * F.least(run / 6.0, F.lit(1.0))
            + 0.20 * (1.0 - F.least(part("aeiou") / 0.30, F.lit(1.0))) + 0.20 * F.least(part("0-9") / 0.30, F.lit(1.0))
        )
        return F.when(n < 8, F.lit(0.0)).otherwise(F.round(F.least(total, F.lit(1.0)), 3))

    return let(registered_label(name), score)


def squashed(s: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), "\\s+", " "))


def first_hit(s: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words``, in their order, that a string contains (case-insensitive), or null."""
    low = F.lower(s)
    return F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in words])


def contains_any(s: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(first_hit(s, words).isNotNull(), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, the rest as it is; strings without both as they are."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 2)
    user = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)", 1)
    rest = F.substring(url, F.length(scheme) + 4 + F.length(user) + F.length(host), F.length(url))
    return F.when((scheme != "") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), user, F.lower(host), rest)).otherwise(url)


def cef_header(s: Column) -> Column:
    """Escapes backslash and pipe, as CEF headers need."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "\\\\", "\\\\\\\\"), "\\|", "\\\\|")


def cef_value(s: Column) -> Column:
    """Escapes backslash, equals sign and line ends, as CEF extension values need."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "\\\\", "\\\\\\\\"), "=", "\\\\=")
    return F.regexp_replace(F.regexp_replace(s, "\r", ""), "\n", "\\\\n")
