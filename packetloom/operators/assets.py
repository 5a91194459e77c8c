"""Assets: evidence from ARP and DHCP, merged records, facts, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from .windows import fact_intervals, owner_at, ownership_intervals

# Strength and confidence of evidence.
SOURCE_RANK = {"dhcp": 3, "arp": 2, "flow": 1}
SOURCE_CONFIDENCE = {"dhcp": 0.9, "arp": 0.8, "flow": 0.4}


def leases(evidence: DataFrame) -> DataFrame:
    """Claims of addresses: tenant, ip, mac (lower case), start, expires (null without a lease), obs_id; replays count once."""
    start = F.col("ts").cast("timestamp")
    end = F.when(F.col("lease_seconds") > 0, start + F.make_dt_interval(secs=F.col("lease_seconds")))
    rows = evidence.filter((F.col("mac") != "") & (F.col("ip") != ""))
    return rows.select("tenant", "ip", F.lower("mac").alias("mac"), start.alias("start"), end.alias("expires"), F.coalesce("obs_id", F.lit("")).alias("obs_id")).distinct()


def ip_ownership(claims: DataFrame) -> DataFrame:
    """Who owned each address when: tenant, ip, mac, valid_from, valid_to; of claims with one start the smallest obs_id holds."""
    return ownership_intervals(claims, ["tenant", "ip"], "mac", "start", "expires", ["obs_id"])


def resolve(events: DataFrame, ownership: DataFrame, ip: str, ts: str, name: str) -> DataFrame:
    """``events`` with ``name``: mac:… of the owner of their address at their time, else ip:…."""
    owned = ownership.withColumnRenamed("ip", "_ip")
    at = owner_at(events.withColumn("_ip", F.col(ip)), owned, ["tenant", "_ip"], ts, "mac")
    return at.withColumn(name, F.coalesce(F.concat(F.lit("mac:"), F.col("mac")), F.concat(F.lit("ip:"), F.coalesce(F.col(ip), F.lit("unknown"))))).drop("mac", "_ip")


def merged(evidence: DataFrame) -> DataFrame:
    """Per tenant and asset: sets of addresses, hardware addresses, names and sources, first and last sighting, confidence."""
    members = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias
    return evidence.groupBy("tenant", "asset_key").agg(
        members(F.col("ip"))("ip_set"), members(F.lower("mac"))("mac_set"), members(F.col("hostname"))("hostname_set"), members(F.col("src"))("sources"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    ).withColumn("confidence", F.least(F.lit(1.0), 0.5 + 0.1 * F.size("sources")))


def facts(evidence: DataFrame) -> DataFrame:
    """Fact candidates of evidence rows: predicate hostname or mac with value, confidence, source; empty values give none."""
    conf = rules.lookup(SOURCE_CONFIDENCE, F.col("src"), F.lit(0.4))
    both = F.array(F.struct(F.lit("hostname").alias("predicate"), F.col("hostname").alias("value")), F.struct(F.lit("mac").alias("predicate"), F.lower("mac").alias("value")))
    out = evidence.select("tenant", F.col("asset_key").alias("subject"), F.explode(both).alias("_f"), "ts", "expires", "src", "obs_id")
    return out.select("tenant", "subject", "_f.*", "ts", "expires", "src", "obs_id").filter(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("confidence", conf)


def authority(src: str = "src", confidence: str = "confidence", value: str = "value", obs: str = "obs_id") -> list[Column]:
    """Order of facts that compete for one instant: strongest source, highest confidence, smallest value, source, observation."""
    return [-rules.lookup(SOURCE_RANK, F.col(src), F.lit(0)), -F.col(confidence), F.col(value), F.col(src), F.col(obs)]


def fact_history(candidates: DataFrame) -> DataFrame:
    """Intervals of each subject's facts."""
    return fact_intervals(candidates, ["tenant", "subject", "predicate"], "value", "ts", "expires", authority())


def relations(events: DataFrame, key: list[str], ts: str, evidence: str) -> DataFrame:
    """Edges of an entity graph with widened spans: first_seen, last_seen, n, and the latest evidence (ties: the largest)."""
    return events.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by(evidence, F.struct(ts, evidence)).alias("evidence"))


def directory_facts(devices: DataFrame) -> DataFrame:
    """Facts from an inventory (entity, owner, criticality): one for each value present; devices without an entity give none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("value")) for c in ("owner", "criticality")])
    out = devices.filter(F.coalesce(F.col("entity"), F.lit("")) != "").select("tenant", F.col("entity").alias("subject"), F.explode(pairs).alias("_f"), F.col("synced_at").alias("valid_from"))
    return out.select("tenant", "subject", "_f.*", "valid_from").filter(F.coalesce(F.col("value"), F.lit("")) != "")


def entity_of(findings: DataFrame, assets: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Findings with entity: the (smallest) asset that holds their address, else ip:…."""
    held = assets.select("tenant", "asset_key", F.explode("ip_set").alias("_ip")).groupBy("tenant", "_ip").agg(F.min("asset_key").alias("_asset"))
    held = held.withColumnRenamed("tenant", "_tenant")
    row = findings.join(held, (F.col("tenant") == F.col("_tenant")) & (F.col(ip) == F.col("_ip")), "left")
    return row.withColumn("entity", F.coalesce("_asset", F.concat(F.lit("ip:"), F.col(ip)))).drop("_tenant", "_ip", "_asset")
