"""Identities: stable numbers and digests from entity values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_number(*parts: Column) -> Column:
    """The first 15 hex digits of the SHA-1 of the parts (null as ''), joined by '|', modulo 10^10."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.pmod(F.conv(F.substring(F.sha1(joined), 1, 15), 16, 10).cast("long"), F.lit(10_000_000_000))


def finding_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), stable_number(*parts).cast("string"))


def observation_id(*parts: Column) -> Column:
    """obs: and the SHA-256 of the parts as a compact JSON array."""
    return F.concat(F.lit("obs:"), F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))


def set_digest(ids: Column) -> Column:
    """SHA-256 over an array's sorted members: equal for equal multisets, in any order."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)
