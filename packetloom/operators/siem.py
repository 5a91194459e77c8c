"""Findings for SIEMs: pivots, renames, CEF lines, searches, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text

# Names of finding fields in other vocabularies.
CIM = {"src_ip": "src", "dest_ip": "dest", "category": "category", "severity": "severity_id", "detector_id": "signature", "finding_id": "id"}
ECS = {
    "src_ip": "source.ip", "dest_ip": "destination.ip", "category": "event.category", "severity": "event.severity", "detector_id": "rule.id",
    "finding_id": "event.id", "last_seen": "@timestamp",
}
SOURCE_ROLES = ("src", "source", "client", "attacker", "initiator")
TARGET_ROLES = ("dst", "peer", "server", "c2", "destination", "target", "scanner", "victim")


def entity_value(entities: Column, kind: str, roles: tuple[str, ...] = ()) -> Column:
    """The first entity of a type (and, if given, of a role), or null."""
    fits = (lambda e: (e["type"] == kind) & e["role"].isin(*roles)) if roles else (lambda e: e["type"] == kind)
    return F.get(F.filter(entities, fits), F.lit(0))["value"]


def pivots(findings: DataFrame) -> DataFrame:
    """Findings with the fields that searches pivot on: entity, src_ip, dest_ip, domain, fingerprint.

    entity is the entity entry, else the source, else the destination. entities: array of (type, role, value).
    """
    e = F.col("entities")
    src, dst = entity_value(e, "ip", SOURCE_ROLES), entity_value(e, "ip", TARGET_ROLES)
    return findings.withColumns({
        "src_ip": src, "dest_ip": dst, "domain": F.coalesce(entity_value(e, "domain"), entity_value(e, "sni"), entity_value(e, "dns")),
        "fingerprint": F.coalesce(entity_value(e, "ja4"), entity_value(e, "ja3"), entity_value(e, "fingerprint")),
        "entity": F.coalesce(entity_value(e, "entity"), src, dst),
    })


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their names in another vocabulary; others as they are."""
    return df.select([F.col(c).alias(names.get(c, c)) for c in df.columns])


def cef(findings: DataFrame, vendor: str = "packetloom", product: str = "analytics", version: str = "1.0") -> DataFrame:
    """Findings with cef, their line in Common Event Format: header and extension, escaped."""
    head = F.concat_ws("|", F.lit("CEF:0"), *[text.cef_header(F.lit(x)) for x in (vendor, product, version)], text.cef_header(F.col("detector_id")), text.cef_header(F.col("category")), F.col("severity").cast("string"))
    pairs = [("externalId", F.col("finding_id")), ("cat", F.col("category"))]
    pairs += [(k, F.col(c)) for k, c in (("src", "src_ip"), ("dst", "dest_ip"), ("dhost", "domain")) if c in findings.columns]
    ext = F.concat_ws(" ", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), text.cef_value(v))) for k, v in pairs])
    return findings.withColumn("cef", F.concat(head, F.lit("|"), ext))


def stats_by(findings: DataFrame, by: list[str], values: str) -> DataFrame:
    """stats count values(x) by …: n and the sorted distinct values."""
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(values)).alias("members"))


def timechart(findings: DataFrame, ts: str, width: str, by: str, values: list[str]) -> DataFrame:
    """timechart count by …: one row a window, one column a value; empty cells are 0."""
    w = F.window(F.col(ts).cast("timestamp"), width).start.alias("window_start")
    return findings.groupBy(w).pivot(by, values).count().fillna(0, subset=values)


def threshold(findings: DataFrame, by: list[str], ts: str, width: str, least: int) -> DataFrame:
    """Keys and windows with at least ``least`` findings: n."""
    w = F.window(F.col(ts).cast("timestamp"), width).start.alias("window_start")
    return findings.groupBy(*by, w).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def rate(findings: DataFrame, by: list[str], ts: str, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Findings per second over sliding windows."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    one = findings.groupBy(*by, F.window(F.col(ts).cast("timestamp"), width, slide).alias("w")).count()
    return one.select(*by, F.col("w.end").alias("window_end"), (F.col("count") / seconds).alias("rate"))


def actions(findings: DataFrame) -> DataFrame:
    """Findings with actions, the response steps that their category and severity call for, and priority (1 is highest)."""
    c, s = F.col("category"), F.col("severity")
    steps = F.array_compact(F.array(
        F.when(c.isin("c2", "exfil", "dns_tunnel") & (s >= 7), F.lit("block_destination")), F.when(c.isin("lateral", "impact") & (s >= 7), F.lit("isolate_host")),
        F.when(c == "credential_access", F.lit("reset_credentials")), F.when(s >= 9, F.lit("page_on_call")), F.lit("open_ticket"),
    ))
    return findings.withColumn("actions", steps).withColumn("priority", F.when(s >= 9, 1).when(s >= 7, 2).when(s >= 5, 3).otherwise(4))


def notices(df: DataFrame, note: str) -> DataFrame:
    """Analyser notices as findings: category and severity; operational ones are left out."""
    c = rules.notice_class(F.col(note))
    return df.filter(~rules.is_operational_notice(F.col(note))).withColumn("category", c["category"]).withColumn("severity", c["severity"])


# Severity of a threat level, category and techniques of an alert's first label, and detecting modules.
THREAT_LEVELS = {"info": 3, "low": 4, "medium": 6, "high": 8, "critical": 9}
ALERT_KINDS = {"Recon": "recon", "Attempt": "bruteforce", "Intrusion": "c2", "Malware": "c2", "Exfiltration": "exfil", "Anomaly": "anomaly"}
ALERT_TECHNIQUES = {"Recon": "T1046", "Attempt": "T1110", "Intrusion": "T1071", "Malware": "T1071", "Exfiltration": "TA0010"}
LOOKUP_MODULES = ("threatintel", "blacklist", "riskiq", "spamhaus", "abuse.ch", "cesnet", "urlhaus", "whitelist")
LEARNED_MODULES = ("flowml", "flowmldetection", "rnn_cc", "rnn", "cc_detection")


def idea_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts of a behavioural engine as candidates: detector by module provenance, severity by threat level.

    alerts: attacker, victim, threat_level, kind (first category), confidence, module. Without an attacker there is
    no candidate; an unknown level is info; a confidence of 0 stays, one that is missing or no number is 0.7.
    """
    level = F.lower(F.coalesce(F.col("threat_level"), F.lit("")))
    level = F.when(level.isin(*THREAT_LEVELS), level).otherwise(F.lit("info"))
    first = F.get(F.split(F.col("kind"), "\\."), F.lit(0))
    value = F.col("confidence").cast("string").try_cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    detector = F.when(text.contains_any(F.col("module"), LOOKUP_MODULES), F.lit("slips_intel")).when(text.contains_any(F.col("module"), LEARNED_MODULES), F.lit("slips_ml")).otherwise(F.lit("slips_alert"))
    technique = rules.lookup(ALERT_TECHNIQUES, first)
    return alerts.filter(F.coalesce(F.col("attacker"), F.lit("")) != "").withColumns({
        "detector_id": detector, "category": rules.lookup(ALERT_KINDS, first, F.lit("anomaly")), "severity": rules.lookup(THREAT_LEVELS, level),
        "confidence": F.when(sound, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.7),
        "mitre": F.when(technique.isNotNull(), F.array(technique)).otherwise(F.array().cast("array<string>")),
    })


# Deep-inspection risks as (category, severity or (low, high) band), tiers and confidences.
RISK_RULES = {
    "known proto on non std port": ("observation", 2, 2), "http susp user-agent": ("observation", 2, 2), "tls (probably) not carrying https": ("observation", 2, 2),
    "missing sni tls extn": ("observation", 2, 2), "tls fatal alert": ("observation", 2, 2), "susp entropy": ("observation", 2, 2),
    "unidirectional traffic": ("observation", 2, 2), "minor issues": ("observation", 2, 2),
    "smb insecure version": ("policy", 3, 3), "clear-text credentials": ("policy", 2, 5), "obsolete tls version (1.1 or older)": ("policy", 2, 5),
    "weak tls cipher": ("policy", 2, 5), "tls certificate expired": ("policy", 2, 5),
    "self-signed certificate": ("observation", 2, 2), "punycode idn": ("observation", 2, 2),
    "malicious ja3 fingerprint": ("anomaly", 3, 7), "malicious sha1 certificate": ("anomaly", 3, 7), "suspicious dga domain": ("anomaly", 3, 7),
    "possible exploit": ("exploit", 4, 8),
}
RISK_TIERS = {"low": 2, "medium": 4, "high": 6, "severe": 7, "critical": 8, "emergency": 9}
RISK_CONFIDENCE = {"policy": 0.80, "anomaly": 0.50, "exploit": 0.50, "observation": 0.20, "unclassified": 0.20}
HIGH_RISKS = (
    "malicious", "suspicious dga", "dga domain", "self-signed", "malformed", "clear-text credential", "cleartext", "known proto on non std port",
    "binary application transfer", "susp", "possible exploit", "obfuscated", "tls certificate expired", "tls suspicious", "punycode", "anonymous subscriber",
)


def parsed_risks(ndpi: Column, field: str = "$.flow_risk") -> Column:
    """Array of (id, name, severity, score) of a deep-inspection record (JSON), over the shapes that sensors send.

    An object of objects, an object of names, an object of flags (the key is the name), a list of either, or one name.
    A field that an entry lacks is null.
    """
    raw = F.get_json_object(ndpi, field)
    shape = "struct<id:string,name:string,severity:string,score:long>"
    none = F.array().cast(f"array<{shape}>")

    def one(key: Column, value: Column) -> Column:
        j = lambda p: F.get_json_object(value, p)
        nested = value.startswith("{")
        name = F.when(nested, F.coalesce(j("$.risk"), j("$.name"))).when(value.isin("true", "1"), key).otherwise(value)
        score = F.coalesce(j("$.risk_score.total"), j("$.score")).try_cast("long")
        return F.struct(key.alias("id"), name.alias("name"), F.when(nested, j("$.severity")).alias("severity"), F.when(nested, score).alias("score"))

    pairs = F.map_entries(F.from_json(raw, "map<string,string>"))
    items = F.from_json(raw, "array<string>")
    no_key = F.lit(None).cast("string")
    out = (
        F.when(raw.startswith("{"), F.transform(pairs, lambda kv: one(kv["key"], kv["value"])))
        .when(raw.startswith("["), F.transform(items, lambda v: one(no_key, v)))
        .when(F.coalesce(raw, F.lit("")) != "", F.array(one(no_key, raw)))
    )
    return F.coalesce(out.cast(f"array<{shape}>"), none)


def high_risks(risks: Column) -> Column:
    """Names of parsed risks whose name or severity contains one of the high-risk phrases."""
    hit = F.filter(risks, lambda r: text.contains_any(F.concat_ws(" ", r["name"], r["severity"]), HIGH_RISKS))
    return F.transform(hit, lambda r: F.coalesce(r["name"], r["id"], F.lit("")))


def classified_risk(name: Column, tier: Column) -> Column:
    """Struct (category, severity, confidence) of a risk: its rule's band, at the sensor's tier; unknown names are unclassified."""
    n = text.squashed(name)
    part = lambda i: rules.lookup({k: v[i] for k, v in RISK_RULES.items()}, n)
    category = F.coalesce(part(0), F.lit("unclassified"))
    level = F.coalesce(rules.lookup(RISK_TIERS, F.lower(tier)), part(1))
    severity = F.when(part(0).isNull(), 1).otherwise(F.greatest(part(1), F.least(part(2), level)))
    return F.struct(category.alias("category"), severity.cast("int").alias("severity"), rules.lookup(RISK_CONFIDENCE, category).alias("confidence"))


def risk_findings(flows: DataFrame, key: list[str], ndpi: str, most_evidence: int = 16) -> DataFrame:
    """Per flow and category of its classified risks: severity (of the worst), confidence, rules, evidence.

    Of the evidence the first ``most_evidence`` risks are listed; n_risks counts all, and truncated tells that there are more.
    """
    row = flows.select(*key, F.explode(parsed_risks(F.col(ndpi))).alias("r")).filter(F.coalesce(F.col("r.name"), F.lit("")) != "")
    row = row.withColumn("c", classified_risk(F.col("r.name"), F.col("r.severity")))
    return row.groupBy(*key, F.col("c.category").alias("category")).agg(
        F.max("c.severity").alias("severity"), F.max("c.confidence").alias("confidence"), F.array_sort(F.collect_set(text.squashed(F.col("r.name")))).alias("rules"),
        F.slice(F.array_sort(F.collect_list("r")), 1, most_evidence).alias("evidence"), F.count(F.lit(1)).alias("n_risks"), (F.count(F.lit(1)) > most_evidence).alias("truncated"),
    )
