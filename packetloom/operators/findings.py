"""Findings: lifecycle policy, correlation, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, stats, time
from .windows import rising_stages

# Kill-chain stage of a category.
STAGES = {"recon": 0, "malware": 1, "bruteforce": 1, "anomaly": 1, "c2": 2, "dns_tunnel": 2, "lateral": 3, "exfil": 4}
# Families of detectors that see one behaviour, and the risk a family adds at most.
FAMILIES = {
    "ja4_novelty": "fingerprint", "ja4_transition_burst": "fingerprint", "ja4_rarity": "fingerprint", "server_fp_rarity": "fingerprint",
    "beacon": "temporal", "beacon_fqdn": "temporal", "strobe": "temporal", "long_connection": "temporal", "long_connection_cumulative": "temporal",
    "exfil": "volume", "low_slow_exfil": "volume", "icmp_exfil": "volume",
    "dns_tunnel": "dns", "dns_exploded": "dns", "dga_domain": "dns", "nxdomain_burst": "dns",
    "rare_destination": "destination",
    "ids_signature": "signature", "threat_intel": "signature", "feodo": "signature", "zeek_notice": "signature",
}
FAMILY_CAPS = {"fingerprint": 6.67, "temporal": 10.0, "destination": 5.0, "volume": 5.0, "dns": 6.67, "signature": 10.0}
OTHER_CAP = 100.0
# Techniques of a category.
TECHNIQUES = {
    "recon": "T1046", "discovery": "T1046", "c2": "T1071", "dns_tunnel": "T1071.004", "lateral": "T1021", "exfil": "TA0010", "bruteforce": "T1110",
    "credential_access": "T1110", "defense_evasion": "T1571", "impact": "T1486",
}
CONFIRMED = ("ids_signature", "threat_intel", "file_malware_hash")
STRUCTURAL = ("recon", "discovery", "credential_access", "lateral", "impact", "defense_evasion")
CORRELATED = ("correlation_incident", "correlation_corroboration")
ML_DETECTORS = ("slips_ml",)


def enrichment_route(detector: Column, category: Column, confidence: Column) -> Column:
    """packets_needed or metadata_sufficient."""
    enough = category.isin(*STRUCTURAL) | detector.isin("low_slow_exfil", "ndpi_risk") | (F.coalesce(confidence, F.lit(0.0)) >= 0.9)
    return F.when(detector.isin(*CONFIRMED), F.lit("packets_needed")).when(F.coalesce(enough, F.lit(False)), F.lit("metadata_sufficient")).otherwise(F.lit("packets_needed"))


def is_suppressed(detector: Column, severity: Column, ceiling: int = 5) -> Column:
    """Low severity without a confirmed source: kept for correlation, not delivered. No or zero severity counts as 10."""
    level = F.coalesce(F.nullif(severity, F.lit(0)), F.lit(10))
    return ~F.coalesce(detector.isin(*CONFIRMED), F.lit(False)) & (level <= ceiling)


def build(candidates: DataFrame) -> DataFrame:
    """Candidates as findings of revision 1: mitre (their own or their category's), enrichment route, state.

    Structural findings are final or suppressed at once; the rest wait for packets, confirmed ones
    being delivered meanwhile.
    """
    own = F.col("mitre") if "mitre" in candidates.columns else F.lit(None).cast("array<string>")
    known = rules.lookup(TECHNIQUES, F.col("category"))
    mitre = F.when(F.size(own) > 0, own).when(known.isNotNull(), F.array(known)).otherwise(F.array().cast("array<string>"))
    route = enrichment_route(F.col("detector_id"), F.col("category"), F.col("confidence"))
    low = is_suppressed(F.col("detector_id"), F.col("severity"))
    state = (
        F.when(F.col("detector_id").isin(*CONFIRMED), F.lit("FINAL")).when((route == "packets_needed") & ~low, F.lit("CAPTURE_REQUESTED"))
        .when(low, F.lit("SUPPRESSED")).otherwise(F.lit("FINAL"))
    )
    return candidates.withColumns({"mitre": mitre, "enrichment_state": route, "state": state, "revision": F.lit(1)})


def apply_enrichment(findings: DataFrame, results: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings with their enrichment results merged: refs united, revision + 1, terminal state. Others as they are.

    A delivered finding stays delivered; another is suppressed or final by the same policy as any.
    results: key, refs (array).
    """
    r = results.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("_refs"))
    row = findings.join(r, key, "left")
    done = F.col("_refs").isNotNull()
    end = F.when(F.col("state") == "FINAL", F.lit("FINAL")).when(is_suppressed(F.col("detector_id"), F.col("severity")), F.lit("SUPPRESSED")).otherwise(F.lit("FINAL"))
    return row.withColumns({
        "evidence_refs": F.when(done, F.array_union("evidence_refs", "_refs")).otherwise(F.col("evidence_refs")),
        "revision": F.col("revision") + F.when(done, 1).otherwise(0),
        "state": F.when(done, end).otherwise(F.col("state")),
    }).drop("_refs")


def strongest(findings: DataFrame, key: list[str]) -> DataFrame:
    """Per key and detector the finding of the highest severity, the latest of equals."""
    f = findings.filter(~F.col("detector_id").isin(*CORRELATED))
    best = F.max(F.struct("severity", "ts")).alias("_b")
    return f.groupBy(*key, "detector_id").agg(best).select(*key, "detector_id", F.col("_b.severity").alias("severity"), F.col("_b.ts").alias("ts"))


def entity_risk(findings: DataFrame, key: list[str], now: Column, half_life: float = 3600.0) -> DataFrame:
    """Per key: risk, the sum over families of decayed severities of their detectors' strongest findings, capped by family."""
    s = strongest(findings, key)
    family = F.coalesce(rules.lookup(FAMILIES, F.col("detector_id")), F.col("detector_id"))
    points = stats.decayed(F.col("severity").cast("double"), time.epoch(now) - time.epoch(F.col("ts")), half_life)
    per = s.groupBy(*key, family.alias("family")).agg(F.sum(points).alias("raw"))
    cap = F.coalesce(rules.lookup(FAMILY_CAPS, F.col("family")), F.lit(OTHER_CAP))
    return per.groupBy(*key).agg(F.round(F.sum(F.least(F.col("raw"), cap)), 3).alias("risk"))


def incidents(findings: DataFrame, key: list[str], now: Column, risk: float = 12.0, min_tactics: int = 2, half_life: float = 3600.0) -> DataFrame:
    """Keys that warrant an incident: reason, severity, risk, n_findings, mitre."""
    f = findings.filter(~F.col("detector_id").isin(*CORRELATED)).withColumn("_stage", rules.lookup(STAGES, F.col("category")))
    base = f.groupBy(*key).agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("_stage").alias("n_tactics"), F.max("severity").alias("_most"), F.min("ts").alias("first_seen"))
    chain = rising_stages(f, key, "_stage", "ts").select(*key, "is_chain")
    row = base.join(chain, key, "left").join(entity_risk(findings, key, now, half_life), key)
    is_chain = F.coalesce("is_chain", F.lit(False))
    reason = (
        F.when(is_chain & (F.col("n_tactics") >= min_tactics), F.lit("kill-chain"))
        .when((F.col("n_tactics") >= min_tactics) & (F.col("n_findings") >= 2), F.lit("multi-tactic")).when(F.col("risk") >= risk, F.lit("risk-threshold"))
    )
    severity = F.greatest(F.lit(1), F.least(F.lit(10), F.col("_most").cast("int") + F.when(is_chain, 2).otherwise(1)))
    return row.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("severity", severity).drop("_most", "is_chain")


def corroborations(findings: DataFrame, key: list[str], ml: tuple[str, ...] = ML_DETECTORS) -> DataFrame:
    """Keys and categories on which a learned and a rule-based detector agree: detectors, severity."""
    s = findings.filter(~F.col("detector_id").isin(*CORRELATED) & (F.col("category") != "") & (F.col("detector_id") != ""))
    is_ml = F.col("detector_id").isin(*ml)
    one = s.groupBy(*key, "category").agg(F.bool_or(is_ml).alias("_ml"), F.bool_or(~is_ml).alias("_rule"), F.array_sort(F.collect_set("detector_id")).alias("detectors"), F.max("severity").alias("_most"))
    return one.filter("_ml AND _rule").withColumn("severity", F.least(F.lit(10), F.col("_most").cast("int") + 2)).drop("_ml", "_rule", "_most")
