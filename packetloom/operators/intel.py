"""Threat intelligence: provenance, effective fields, revocation, matching, hunting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ip as ips, rules, text
from .joins import cidr_join

# Sharing levels from open to closed.
TLP = ("clear", "green", "amber", "amber+strict", "red")


def normal_indicator(kind: Column, value: Column) -> Column:
    """The key by which an indicator is stored and looked up: canonical address, URL with lower-case host, else lower case."""
    v = F.trim(value)
    return F.when(kind == "ip", ips.canonical(v)).when(kind == "url", text.canonical_url(v)).otherwise(F.lower(v))


def tlp_rank(tlp: Column) -> Column:
    return rules.lookup({t: i for i, t in enumerate(TLP)}, tlp)


def tlp_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TLP]), rank)


def assertions(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest assertion per indicator, source and feed: a refresh replaces what its source said before."""
    from .latest import current

    return current(records, [*key, "source", "feed"], [order])


def revoke(said: DataFrame, revocations: DataFrame, key: list[str]) -> DataFrame:
    """Assertions whose source and feed have not withdrawn them; an indicator without any left is gone."""
    return said.join(revocations.select(*key, "source", "feed").distinct(), [*key, "source", "feed"], "left_anti")


def effective(said: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Per indicator: score, source and trust of the best assertion now valid (else of the best), the latest
    expiry, the most restrictive sharing level, first and last sighting, and disposition.

    said: key, source, feed, score, trust, tlp, first_seen, last_seen, expiry.
    """
    valid = F.col("expiry") > now
    best = F.max(F.struct(valid.alias("valid"), F.col("trust"), F.col("score"), F.col("source"), F.col("feed"))).alias("_b")
    one = said.groupBy(*key).agg(
        best, F.max("expiry").alias("expiry"), F.max(tlp_rank(F.col("tlp"))).alias("_tlp"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("n_sources"),
    )
    return one.select(
        *key, "_b.source", "_b.feed", "_b.score", "_b.trust", "expiry", tlp_name(F.col("_tlp")).alias("tlp"), "first_seen", "last_seen", "n_sources",
        F.when(F.col("_b.valid"), F.lit("active")).otherwise(F.lit("expired")).alias("disposition"),
    )


def exportable(intel: DataFrame) -> DataFrame:
    """Indicators that may leave the platform: not red."""
    return intel.filter(F.coalesce(F.col("tlp") != "red", F.lit(True)))


def unsuppressed(hits: DataFrame, suppressions: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Hits without a live suppression of their indicator."""
    live = suppressions.filter(F.col("expires_at") > now).select(*key).distinct()
    return hits.join(live, key, "left_anti")


def match(observed: DataFrame, intel: DataFrame, on: list[str] = ("tenant",)) -> DataFrame:
    """Observed (kind, value) with the active indicators they meet: equal by normal form, or by network for addresses.

    Each observation and indicator pair counts once, however both ways it matches.
    """
    on = list(on)
    seen = observed.withColumn("_norm", normal_indicator(F.col("kind"), F.col("value")))
    live = intel.filter(F.col("disposition") == "active")
    exact = live.select(*on, F.col("kind").alias("_kind"), normal_indicator(F.col("kind"), F.col("indicator")).alias("_ind"), *[c for c in live.columns if c not in on and c != "kind"])
    cond = (F.col("kind") == F.col("_kind")) & (F.col("_norm") == F.col("_ind"))
    for c in on:
        cond = cond & seen[c].eqNullSafe(exact[c])
    hit = seen.join(exact, cond).drop(*[exact[c] for c in on]).drop("_kind", "_ind")
    nets = live.filter((F.col("kind") == "ip") & F.col("indicator").contains("/")).drop("kind")
    inside = cidr_join(seen.filter(F.col("kind") == "ip"), "_norm", nets, "indicator", on)
    return hit.unionByName(inside).drop("_norm").dropDuplicates([c for c in observed.columns if dict(observed.dtypes)[c] != "map"] + ["indicator"])


def static_match(df: DataFrame, address: str, ja3: str, cert: str, feeds: dict[str, DataFrame]) -> DataFrame:
    """``df`` with matched_on: ip, ja3 or cert, the strongest first; feeds has one-column tables by these names."""
    out = df
    for name, column in (("ip", address), ("ja3", ja3), ("cert", cert)):
        f = feeds[name]
        known = f.select(F.lower(F.trim(F.col(f.columns[0]))).alias(f"_{name}")).distinct()
        out = out.join(known, F.lower(F.col(column)) == F.col(f"_{name}"), "left")
    hit = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in ("ip", "ja3", "cert")])
    return out.withColumn("matched_on", hit).drop("_ip", "_ja3", "_cert")


def dimensions(eve: DataFrame) -> DataFrame:
    """``eve`` exploded to the indicator values its records supply: kind, field, value. Schemes and hashes are never inferred."""

    def one(kind: str, field: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), value.cast("string").alias("value"))

    has = {f.name: f.dataType.simpleString() for f in eve.schema.fields}
    out = [one("ip", c, F.col(c)) for c in ("src_ip", "dest_ip") if c in has]
    if "tls" in has:
        fields = (("domain", "sni"), ("ja3", "ja3"), ("ja3", "ja3s"), ("ja4", "ja4"), ("ja4", "ja4s"), ("cert", "fingerprint"))
        out += [one(k, f"tls.{f}", F.col(f"tls.{f}")) for k, f in fields if f"{f}:" in has["tls"]]
    if "dns" in has:
        out.append(one("domain", "dns.rrname", F.col("dns.rrname")))
    if "http" in has:
        out.append(one("domain", "http.hostname", F.col("http.hostname")))
        out.append(one("url", "http.url", F.when(F.col("http.url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.col("http.url"))))
    if "fileinfo" in has:
        out += [one("hash", f"fileinfo.{f}", F.col(f"fileinfo.{f}")) for f in ("sha256", "sha1", "md5") if f"{f}:" in has["fileinfo"]]
    rows = eve.withColumn("_d", F.explode(F.array(*out))).filter(F.trim("_d.value") != "")
    listed = None
    for group in ("queries", "answers"):
        if "dns" in has and f"{group}:" in has["dns"]:
            e = eve.select("*", F.posexplode(F.col(f"dns.{group}")).alias("_i", "_e"))
            e = e.filter(F.trim("_e.rrname") != "").withColumn("_d", F.struct(F.lit("domain").alias("kind"), F.concat(F.lit(f"dns.{group}."), F.col("_i").cast("string"), F.lit(".rrname")).alias("field"), F.col("_e.rrname").alias("value")))
            listed = e.drop("_i", "_e") if listed is None else listed.unionByName(e.drop("_i", "_e"))
    rows = rows if listed is None else rows.unionByName(listed)
    return rows.select("*", "_d.kind", "_d.field", "_d.value").drop("_d")


def hunt(observed: DataFrame, intel: DataFrame, start: Column, end: Column, on: list[str] = ("tenant",)) -> DataFrame:
    """Matches among observations of a time range, flagged where the indicator was learned only afterwards; hit_id is content-derived."""
    inside = observed.filter((F.col("ts") >= start) & (F.col("ts") < end))
    hit = match(inside, intel, on)
    ident = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in on], "kind", "indicator", "field", "value", F.col("ts").cast("string")), 256)
    return hit.withColumn("learned_later", F.col("first_seen") > F.col("ts")).withColumn("hit_id", ident)
