"""Every detection over an event table, as rows of one finding schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, ip as ips, rules, time
from ..operators import assets, baseline, counts, findings, flows as flow_ops, health, intel as intel_ops, joins, novelty, siem, windows
from ..sources.config import Thresholds
from . import normalize

COLUMNS = ("finding_id", "tenant", "detector_id", "category", "severity", "confidence", "first_seen", "last_seen", "src_ip", "dest_ip", "detail")
WINDOW = 600


def finding(df: DataFrame, detector: str | Column, category: str | Column, severity, confidence, src: str = "src_ip", dst: str | None = "dest_ip", first: str = "event_time", last: str | None = None, detail: Column | None = None, bucket: int = WINDOW) -> DataFrame:
    """Rows as findings, one for each tenant, detector, category, pair of endpoints, detail and time bucket, whatever is replayed.

    The finding spans its rows and has the highest of their severities and confidences.
    """
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    d, why = c(detector), detail if detail is not None else F.lit("")
    to = F.col(dst) if dst else F.lit("")
    out = df.select(
        F.col("tenant"), d.alias("detector_id"), c(category).alias("category"), c(severity).cast("int").alias("severity"), c(confidence).cast("double").alias("confidence"),
        F.col(first).alias("first_seen"), F.col(last or first).alias("last_seen"), F.col(src).alias("src_ip"), to.alias("dest_ip"), why.cast("string").alias("detail"),
    )
    one = ["tenant", "detector_id", "category", "src_ip", "dest_ip", "detail"]
    out = out.withColumn("_bucket", time.bucket(F.col("first_seen"), bucket)).groupBy(*one, "_bucket").agg(
        F.max("severity").alias("severity"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    ident = F.concat(F.col("detector_id"), F.lit("-"), ids.stable_number(*map(F.col, one)).cast("string"), F.lit("-"), F.col("_bucket").cast("string"))
    return out.withColumn("finding_id", ident).select(*COLUMNS)


def _span(df: DataFrame, key: list[str], ts: str = "event_time") -> DataFrame:
    return df.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def context(f: DataFrame, intel: DataFrame | None = None) -> DataFrame:
    """Per pair what is known of its destination: breed and risky (of the latest inspected flow), listed (by an active indicator), n_sources."""
    key = ["tenant", "src_ip", "dest_ip"]
    risky = F.size(siem.high_risks(siem.parsed_risks(F.col("ndpi")))) > 0
    seen = F.max_by(F.struct(F.get_json_object("ndpi", "$.breed").alias("breed"), risky.alias("risky")), F.when(F.col("ndpi").isNotNull(), F.col("event_time"))).alias("_c")
    out = f.groupBy(*key).agg(seen).select(*key, "_c.*").join(flow_ops.prevalence(f, ["tenant", "dest_ip"], "src_ip"), ["tenant", "dest_ip"])
    if intel is None:
        return out.withColumn("listed", F.lit(False))
    known = intel_ops.match(out.select("tenant", F.lit("ip").alias("kind"), F.col("dest_ip").alias("value")).distinct(), intel)
    known = known.select("tenant", F.col("value").alias("dest_ip"), F.lit(True).alias("listed")).distinct()
    return out.join(known, ["tenant", "dest_ip"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def trailing(df: DataFrame, seconds: int = WINDOW) -> DataFrame:
    """Rows in both windows ``w`` of ``seconds`` that hold them; windows start every half of that, so what fits into half a window is whole in one."""
    at = time.bucket(F.col("event_time"), seconds // 2)
    return df.withColumn("w", F.explode(F.array(at, at - 1)))


def flow_detections(f: DataFrame, names: DataFrame, t: Thresholds = Thresholds(), intel: DataFrame | None = None) -> list[DataFrame]:
    """Over typed flows and (tenant, ip, domain, at) answers: beacons, strobes, volume, duration, new destinations.

    Pairs are judged within windows, so a result does not depend on how much history is loaded.
    """
    key = ["tenant", "src_ip", "dest_ip"]
    pair = [*key, "w"]
    out = f.filter(ips.is_external(F.col("dest_ip")) & (F.col("src_ip") != ""))
    quiet = out.filter(~ips.is_beacon_noise(F.col("dest_ip")))
    known, near, open_ = context(out, intel), trailing(out), trailing(quiet)
    span = _span(near, pair)
    severity = lambda base: flow_ops.gated_severity(F.lit(base), F.col("breed"), F.lit(False), F.col("risky"), F.col("n_sources"), F.col("listed"))
    gate = lambda df, base: df.join(known, key).join(span, pair).withColumn("_sev", severity(base))
    seen = lambda df, det, cat, base: finding(gate(df, base), det, cat, F.col("_sev"), F.col("score"), first="first_seen", last="last_seen")
    beacon = flow_ops.beacons(open_, pair, "event_time", "bytes_toserver", t.beacon_min_conns, t.beacon_score)
    auto = flow_ops.autocorr_beacons(open_.join(beacon.filter("is_beacon").select(*pair), pair, "left_anti"), pair, "event_time", "bytes_toserver", threshold=t.autocorr_score)
    hits = beacon.filter("is_beacon").select(*pair, "score").unionByName(auto.filter("is_beacon").select(*pair, "score"))
    window = out.withColumn("w", time.bucket(F.col("event_time"), WINDOW)).withColumn("flow", F.coalesce(F.nullif(F.col("flow_id"), F.lit("")), F.concat_ws("|", "src_port", "dest_port", "community_id")))
    wkey = [*key, "w"]
    total = flow_ops.volumes(window, wkey, ["flow"], "event_time", "bytes_toserver")
    exfil = flow_ops.exfil(total, t.exfil_bytes, t.low_exfil_bytes)
    ages = flow_ops.cumulative_connections(flow_ops.volumes(window, wkey, ["flow"], "event_time", "age", 0), t.cumulative_seconds)
    named = joins.asof_join(quiet.select("tenant", "src_ip", F.col("dest_ip").alias("ip"), "event_time", "bytes_toserver"), names, ["tenant", "ip"], "event_time", "at", ["domain"], within=WINDOW)
    named, whose = trailing(named), ["tenant", "src_ip", "w"]
    fqdn = flow_ops.fqdn_beacons(named, whose, "domain", "ip", "event_time", "bytes_toserver", t.fqdn_min_ips).filter("is_beacon")
    fqdn = fqdn.join(_span(named.filter("domain IS NOT NULL"), [*whose, "domain"]), [*whose, "domain"])
    at = lambda df: df.withColumn("event_time", F.timestamp_seconds(F.col("w") * WINDOW))
    rare = flow_ops.rare_destinations(out, ["tenant", "src_ip"], "dest_ip", "event_time", t.rare_history)
    return [
        seen(hits, "beacon", "c2", 7),
        finding(fqdn, "beacon_fqdn", "c2", 8, F.col("score"), dst=None, first="first_seen", last="last_seen", detail=F.col("domain")),
        seen(flow_ops.strobes(near, pair, hits.withColumn("is_beacon", F.lit(True)), t.strobe_min_conns), "strobe", "c2", 5),
        finding(at(exfil), F.col("detector_id"), "exfil", F.when(F.col("detector_id") == "exfil", 8).otherwise(6), F.col("score")),
        finding(flow_ops.long_connections(out, "age", t.long_connection_seconds), "long_connection", "c2", 5, F.col("score")),
        finding(at(ages), "long_connection_cumulative", "c2", 5, F.col("score")),
        finding(rare, "rare_destination", "anomaly", 4, 0.5, first="first_seen"),
        *protocol_flows(f),
    ]


def protocol_flows(f: DataFrame) -> list[DataFrame]:
    """Scans, fan-outs, mismatched protocols, ICMP volume, SSH bursts."""
    src = ["tenant", "src_ip"]
    inner = f.filter(ips.is_internal(F.col("src_ip")) & ips.is_internal(F.col("dest_ip"))).withColumn("w", time.bucket(F.col("event_time"), WINDOW))
    wide = f.withColumn("w", time.bucket(F.col("event_time"), 60)).withColumn("h", time.bucket(F.col("event_time"), WINDOW))
    at = lambda df, c, n: df.withColumn("event_time", F.timestamp_seconds(F.col(c) * n))
    scan = counts.internal_scans(inner, [*src, "w"], "dest_ip", "dest_port")
    pair = ["tenant", "src_ip", "dest_ip", "h"]
    mismatch = f.withColumn("why", rules.port_mismatch(F.col("app_proto"), F.col("dest_port"))).filter("why IS NOT NULL")
    return [
        finding(at(counts.fanout(wide, [*src, "w"], F.col("dest_ip"), 20), "w", 60), "horizontal_scan", "recon", 5, 0.7, dst=None, bucket=60),
        finding(at(counts.fanout(wide, [*src, "dest_ip", "w"], F.col("dest_port"), 30), "w", 60), "vertical_scan", "recon", 5, 0.7, bucket=60),
        finding(at(counts.lateral_fanout(inner, [*src, "w"], "dest_ip", "dest_port"), "w", WINDOW), "lateral_movement", "lateral", 7, 0.7, dst=None),
        finding(at(counts.rdp_fanout(inner, [*src, "w"], "dest_ip", "dest_port"), "w", WINDOW), "rdp_fanout", "lateral", 6, 0.6, dst=None),
        finding(at(scan, "w", WINDOW), "internal_scan", "discovery", 6, 0.6, dst=None, detail=F.col("kind")),
        finding(mismatch, "port_proto_mismatch", "defense_evasion", 4, 0.5, detail=F.col("why"), bucket=3600),
        finding(at(counts.event_bursts(wide, pair, F.col("dest_port") == 22, 15), "h", WINDOW), "ssh_bruteforce", "credential_access", 6, 0.6, bucket=3600),
        finding(at(counts.icmp_exfil(wide.filter(ips.is_external(F.col("dest_ip"))), pair, "proto", F.col("bytes_toserver") + F.col("bytes_toclient")), "h", WINDOW), "icmp_exfil", "exfil", 7, 0.6, bucket=3600),
    ]


def dns_detections(d: DataFrame, t: Thresholds = Thresholds()) -> list[DataFrame]:
    src = ["tenant", "src_ip", "w"]
    d = d.withColumn("w", time.bucket(F.col("event_time"), WINDOW))
    at = lambda df: df.withColumn("event_time", F.timestamp_seconds(F.col("w") * WINDOW))
    q = d.filter("rrname <> ''")
    return [
        finding(at(counts.dns_tunnels(q, src, "rrname", t.dns_min_queries)), "dns_tunnel", "dns_tunnel", 6, F.col("score"), dst=None),
        finding(at(counts.dns_exploded(q, src, "rrname", t.dns_min_subdomains)), "dns_exploded", "dns_tunnel", 6, F.col("score"), dst=None, detail=F.col("parent")),
        finding(counts.dga_domains(q, "rrname"), "dga_domain", "c2", 6, F.col("score"), dst=None, detail=F.col("rrname")),
        finding(at(counts.event_bursts(d, src, F.col("rcode") == "NXDOMAIN", 20)), "nxdomain_burst", "c2", 6, 0.6, dst=None),
        finding(at(counts.fanout(d, src, F.col("rrname"), 5, (F.col("src_port") == 5355) & (F.col("type").isin("answer", "response")))), "llmnr_poison", "credential_access", 7, 0.6, dst=None),
    ]


def http_detections(h: DataFrame) -> list[DataFrame]:
    hits = h.withColumn("r", F.explode(rules.http_rules(F.col("method"), F.col("url"))))
    agents = h.withColumn("why", rules.external_agent(F.col("user_agent"), F.col("dest_ip"))).filter("why IS NOT NULL")
    return [
        finding(hits, F.col("r.detector_id"), F.col("r.category"), F.col("r.severity"), 0.7, detail=F.col("url")),
        finding(agents, "suspicious_ua", "c2", 4, 0.5, detail=F.col("why"), bucket=3600),
    ]


def tls_detections(s: DataFrame, h: DataFrame) -> list[DataFrame]:
    """Names, certificates and fingerprints of TLS, and hosts that differ from the name on the same connection."""
    why = lambda c: s.withColumn("why", c).filter("why IS NOT NULL")
    rare = novelty.rare_values(s.withColumn("fp", F.coalesce(F.nullif("ja4", F.lit("")), F.nullif("ja3", F.lit("")))), ["tenant"], "fp", "event_time", 5, 86_400)
    server = novelty.rare_values(s.withColumn("fp", F.coalesce(F.nullif("ja4s", F.lit("")), F.nullif("ja3s", F.lit("")))), ["tenant"], "fp", "event_time", 5, 86_400)
    new = novelty.ja4_novelty(s, ["tenant"], "src_ip", "ja4", "event_time")
    burst = windows.trailing_distinct(s.filter(rules.ja4_valid(F.col("ja4"))), ["tenant", "src_ip"], "ja4", "event_time", WINDOW).filter("n_recent >= 5")
    names = s.filter("community_id <> ''").select("tenant", "community_id", F.col("event_time").alias("_at"), (F.col("event_time") + F.expr("INTERVAL 121 SECONDS")).alias("_until"), "sni")
    front = joins.interval_join(h.filter("community_id <> ''"), names, ["tenant", "community_id"], "event_time", "_at", "_until").filter(rules.host_sni_mismatch(F.col("sni"), F.col("hostname")))
    front = front.groupBy("tenant", "community_id", "event_time", "src_ip", "dest_ip", "hostname").agg(F.min_by("sni", "_at").alias("sni"))
    return [
        finding(why(rules.cloud_staging(F.col("sni"))), "cloud_staging", "exfil", 5, 0.5, detail=F.col("why"), bucket=3600),
        finding(why(rules.encrypted_dns(F.col("sni"), F.col("dest_port"))), "doh_detect", "defense_evasion", 4, 0.5, detail=F.col("why"), bucket=3600),
        finding(why(rules.cert_anomaly(F.col("subject"), F.col("issuer"), F.col("notbefore"), F.col("notafter"))), "tls_cert_anomaly", "c2", 5, 0.5, detail=F.col("why"), bucket=3600),
        finding(s.filter("ech"), "ech_sni_mismatch", "defense_evasion", 5, 0.5, detail=F.lit("ech"), bucket=3600),
        finding(front, "ech_sni_mismatch", "defense_evasion", 6, 0.6, detail=F.concat_ws("!=", "hostname", "sni"), bucket=3600),
        finding(rare, "ja4_rarity", "c2", 5, 0.5, detail=F.col("fp"), bucket=3600), finding(server, "server_fp_rarity", "c2", 5, 0.5, detail=F.col("fp"), bucket=3600),
        finding(new, "ja4_novelty", "c2", F.col("severity"), F.col("confidence"), detail=F.col("ja4"), bucket=3600),
        finding(burst, "ja4_transition_burst", "c2", 5, 0.5, dst=None, bucket=3600),
    ]


def east_west_detections(eve: DataFrame) -> list[DataFrame]:
    """Kerberos, SMB and DCERPC."""
    e = eve.withColumn("w", time.bucket(F.col("event_time"), WINDOW))
    src = ["tenant", "src_ip", "w"]
    at = lambda df: df.withColumn("event_time", F.timestamp_seconds(F.col("w") * WINDOW))
    krb, smb, rpc = (e.filter(F.col("event_type") == k) for k in ("krb5", "smb", "dcerpc"))
    tgs = krb.filter(F.upper("krb5.msg_type").contains("TGS")).select(*src, F.col("krb5.sname").alias("spn"), F.col("krb5.encryption").alias("etype"))
    failed_krb = krb.filter(F.upper("krb5.error_code").rlike("PREAUTH_FAILED|^24$|^0X18$")).select(*src, F.col("krb5.cname").alias("who"))
    failed_smb = smb.filter(F.upper("smb.command").contains("SESSION_SETUP") & ~F.upper(F.coalesce("smb.status", F.lit("STATUS_SUCCESS"))).contains("SUCCESS")).select(*src, F.col("smb.user").alias("who"))
    bare = krb.filter(F.upper("krb5.msg_type").contains("AS_REQ") & F.array_contains(F.json_object_keys(F.get_json_object("raw", "$.krb5")), "preauth") & F.coalesce(F.col("krb5.preauth"), F.lit("null")).isin("false", "null", "[]", ""))
    files = smb.filter("smb.filename IS NOT NULL").select(*src, F.col("smb.filename").alias("name"), F.upper("smb.command").rlike("WRITE|RENAME|CREATE").alias("write"))
    signals = smb.withColumn("s", rules.lateral_signals(F.array_compact(F.array(F.col("smb.named_pipe"), F.col("smb.filename"))), rules.dcerpc_interfaces(F.col("smb.dcerpc")), F.array().cast("array<string>"))).filter(F.size("s") > 0)
    calls = rpc.withColumn("u", F.explode(rules.dcerpc_interfaces(F.col("dcerpc")))).filter(F.col("u").isin(*rules.EXEC_INTERFACES))
    return [
        finding(at(counts.kerberoasting(tgs, src, "spn", "etype")), "kerberoasting", "credential_access", 8, 0.8, dst=None),
        finding(at(counts.fanout(failed_krb.unionByName(failed_smb), src, F.col("who"), 10)), "password_spraying", "credential_access", 7, 0.7, dst=None),
        finding(at(counts.fanout(bare, src, F.col("krb5.cname"), 3)), "as_rep_roasting", "credential_access", 7, 0.75, dst=None),
        finding(at(counts.smb_ransomware(files, src, "name", F.col("write"))), "ransomware_smb", "impact", 9, 0.8, dst=None),
        finding(signals, "lateral_exec", "lateral", 7, 0.75, detail=F.get("s", F.lit(0))),
        finding(calls, "dcerpc_lateral", "lateral", 7, 0.75, detail=F.col("u")),
    ]


def modbus_detections(eve: DataFrame, authorised: tuple[str, ...] = ()) -> list[DataFrame]:
    """Writes, programming, odd ports, new masters, enumeration and errors. A master is known once five others were seen before it."""
    m = eve.filter(F.col("event_type") == "modbus").withColumn("m", rules.modbus_fields(F.col("modbus"))).withColumn("w", time.bucket(F.col("event_time"), WINDOW))
    at = lambda df: df.withColumn("event_time", F.timestamp_seconds(F.col("w") * WINDOW))
    pinned = F.col("src_ip").isin(*authorised) if authorised else F.lit(False)
    new = novelty.rare_values(m.filter(~pinned), ["tenant", "dest_ip"], "src_ip", "event_time", 5, 7 * 86_400)
    stranger = m.join(new.select("tenant", "src_ip", "dest_ip").distinct(), ["tenant", "src_ip", "dest_ip"], "left_semi") if not authorised else m.filter(~pinned)
    src = ["tenant", "src_ip", "w"]
    flat = m.select(*src, F.col("m.fc").alias("fc"), F.col("m.unit_id").alias("unit"), F.col("m.is_error").alias("error"))
    return [
        finding(m.filter(rules.modbus_port(F.col("dest_port"))), "modbus_port_anomaly", "ics_control", 6, 0.6, detail=F.col("dest_port"), bucket=3600),
        finding(new, "new_master_pairing", "ics_control", 5, 0.5, bucket=3600),
        finding(stranger.filter(rules.modbus_write(F.col("m.fc"), F.col("m.access"))), "unauthorized_write", "ics_control", 8, 0.7, detail=F.col("m.fc"), bucket=3600),
        finding(stranger.filter(rules.modbus_program(F.col("m.fc"))), "program_download", "ics_control", 9, 0.8, detail=F.col("m.fc"), bucket=3600),
        finding(at(counts.modbus_enumeration(flat, src, "fc", "unit")), "fc_enumeration", "ics_control", 6, 0.6, dst=None, detail=F.col("why"), bucket=3600),
        finding(at(counts.event_bursts(flat, src, F.col("error"), 5)), "error_flag_spike", "ics_control", 5, 0.5, dst=None, bucket=3600),
    ]


def record_detections(eve: DataFrame) -> list[DataFrame]:
    """Alerts, anomalies, files, deep-inspection risks, sensor health."""
    alert = eve.filter((F.col("event_type") == "alert") & rules.is_threat_alert(F.col("alert.signature"), F.col("alert.severity"), F.get_json_object("alert.metadata", "$.signature_severity")))
    odd = eve.filter((F.col("event_type") == "anomaly") & rules.is_threat_anomaly(F.col("anomaly.type"), F.col("anomaly.event")))
    file = eve.filter((F.col("event_type") == "fileinfo") & F.lower("fileinfo.mime_type").isin(*rules.EXECUTABLE_TYPES))
    risk = siem.risk_findings(eve.filter("ndpi IS NOT NULL"), ["tenant", "src_ip", "dest_ip", "event_time"], "ndpi")
    st = eve.filter(F.col("event_type") == "stats")
    number = lambda p: F.get_json_object("stats", p).try_cast("long")
    st = st.select("tenant", "event_time", F.coalesce("sensor_id", "host", F.lit("")).alias("src_ip"), number("$.capture.kernel_packets").alias("kernel_packets"), number("$.capture.kernel_drops").alias("kernel_drops"), number("$.decoder.pkts").alias("decoder_packets"), F.from_json(F.get_json_object("stats", "$.app_layer.flow"), "map<string,long>").alias("flows"))
    sick = health.sensor_quality(st).filter(F.col("quality").isin("blind", "degraded"))
    check = eve.filter(F.col("event_type") == "anomaly").select("tenant", F.coalesce("sensor_id", "host", F.lit("")).alias("src_ip"), time.bucket(F.col("event_time"), WINDOW).alias("w"), F.col("anomaly.type").alias("k"), F.col("anomaly.event").alias("e"))
    sums = health.checksum_health(check, ["tenant", "src_ip", "w"], "k", "e").withColumn("event_time", F.timestamp_seconds(F.col("w") * WINDOW))
    return [
        finding(alert, "ids_signature", rules.alert_category(F.col("alert.category")), F.when(F.col("alert.severity").try_cast("int") <= 1, 9).otherwise(8), 0.9, detail=F.col("alert.signature"), bucket=300),
        finding(odd, "protocol_anomaly", "anomaly", 5, 0.5, detail=F.col("anomaly.event")),
        finding(file, "risky_file_delivery", "malware", 6, 0.5, detail=F.coalesce("fileinfo.sha256", "fileinfo.filename")),
        finding(risk, "ndpi_risk", F.col("category"), F.col("severity"), F.col("confidence"), detail=F.array_join("rules", ",")),
        finding(sick, "coverage_degraded", "coverage", 6, 0.8, dst=None, detail=F.col("quality")),
        finding(sums, "sensor_checksum_rejection", "sensor_health", 6, 0.6, dst=None, detail=F.col("verdict"), bucket=3600),
    ]


def passive_names(d: DataFrame) -> DataFrame:
    """(tenant, ip, domain, at): the registered domain that an address answered for."""
    from ..functions import text

    a = d.select("tenant", F.explode("answers").alias("ip"), text.registered_parent(F.col("rrname")).alias("domain"), F.col("event_time").alias("at"))
    return a.filter(ips.key(F.col("ip")).isNotNull() & (F.col("domain") != ""))


def intel_detections(eve: DataFrame, intel: DataFrame) -> list[DataFrame]:
    """Records that meet active indicators (tenant, kind, indicator, disposition, score 0 to 100, trust 0 to 1)."""
    hit = intel_ops.match(intel_ops.dimensions(eve).select("tenant", "src_ip", "dest_ip", "event_time", "kind", "field", "value"), intel)
    category = F.when(F.col("kind") == "hash", "malware").otherwise("c2")
    severity = F.greatest(F.lit(1), F.least(F.lit(10), F.round(F.col("score") / 10)))
    sure = F.col("score") / 100 * F.coalesce("trust", F.lit(1.0))
    return [finding(hit, "threat_intel", category, severity, sure, detail=F.concat_ws(":", "kind", "indicator"), bucket=3600)]


def outbound_detections(f: DataFrame) -> list[DataFrame]:
    """Sources that send far more than they and the others of their tenant did in the day before."""
    out = f.filter(ips.is_external(F.col("dest_ip")) & (F.col("src_ip") != ""))
    w = baseline.outbound_windows(out, ["tenant"], "src_ip", "event_time", "bytes_toserver", 300)
    odd = baseline.outbound_anomalies(w, ["tenant"], "src_ip").withColumn("event_time", F.timestamp_seconds("start"))
    return [finding(odd, "outbound_bytes_anomaly", "anomaly", 6, F.col("confidence"), dst=None, detail=F.col("mode"), bucket=300)]


def notice_detections(notices: DataFrame) -> list[DataFrame]:
    """Analyser notices: tenant, event_time, note, src_ip, dest_ip."""
    n = siem.notices(notices, "note")
    return [finding(n, "zeek_notice", F.col("category"), F.col("severity"), 0.8, detail=F.col("note"))]


def alert_detections(alerts: DataFrame) -> list[DataFrame]:
    """Alerts of a behavioural engine (see operators.siem.idea_alerts) with tenant and event_time."""
    a = siem.idea_alerts(alerts).withColumns({"src_ip": F.col("attacker"), "dest_ip": F.coalesce("victim", F.lit(""))})
    return [finding(a, F.col("detector_id"), F.col("category"), F.col("severity"), F.col("confidence"), detail=F.col("kind"))]


def correlated(found: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Incidents and corroborations of the findings of the ``seconds`` before ``now``, per tenant and source, as findings."""
    recent = found.filter((F.col("last_seen") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("last_seen") <= now))
    f = recent.select("tenant", "src_ip", "detector_id", "category", "severity", "confidence", F.col("last_seen").alias("ts"))
    key = ["tenant", "src_ip"]
    span = _span(f, key, "ts")
    case = findings.incidents(f, key, now).drop("first_seen").join(span, key)
    both = findings.corroborations(f, key).join(span, key)
    args = {"dst": None, "first": "first_seen", "last": "last_seen", "bucket": seconds}
    out = finding(case, "correlation_incident", "incident", F.col("severity"), 0.95, detail=F.col("reason"), **args)
    return out.unionByName(finding(both, "correlation_corroboration", F.col("category"), F.col("severity"), 0.9, detail=F.array_join("detectors", ","), **args))


def all_detections(eve: DataFrame, thresholds: Thresholds = Thresholds(), intel: DataFrame | None = None, notices: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Findings of every detection over parsed event records (see sources.eve.parse), and over what else is given.

    Every branch reads the records: hand in a table that sources.eve.staged wrote, from which each reads its event
    type only. ``correlated`` takes the findings on to incidents.
    """
    t = normalize.typed(eve)
    more = [*(intel_detections(eve, intel) if intel is not None else []), *(notice_detections(notices) if notices is not None else []), *(alert_detections(alerts) if alerts is not None else [])]
    parts = [
        *more, *outbound_detections(t["flow"]),
        *flow_detections(t["flow"], passive_names(t["dns"]), thresholds, intel), *dns_detections(t["dns"], thresholds), *http_detections(t["http"]), *tls_detections(t["tls"], t["http"]),
        *east_west_detections(eve), *modbus_detections(eve), *record_detections(eve),
    ]
    return reduce(DataFrame.unionByName, parts)


def identity_evidence(eve: DataFrame) -> DataFrame:
    """ARP and DHCP records as evidence of who holds an address: tenant, ip, mac, hostname, lease_seconds, src, ts, obs_id."""
    arp = eve.filter(F.col("event_type") == "arp").select("tenant", F.col("arp.src_ip").alias("ip"), F.lower("arp.src_mac").alias("mac"), F.lit("").alias("hostname"), F.lit(None).cast("long").alias("lease_seconds"), F.lit("arp").alias("src"), F.col("event_time").alias("ts"), F.sha2("raw", 256).alias("obs_id"))
    dhcp = eve.filter(F.col("event_type") == "dhcp").select("tenant", F.coalesce("dhcp.assigned_ip", "dhcp.client_ip").alias("ip"), F.lower("dhcp.client_mac").alias("mac"), F.coalesce("dhcp.hostname", F.lit("")).alias("hostname"), F.col("dhcp.lease_time").alias("lease_seconds"), F.lit("dhcp").alias("src"), F.col("event_time").alias("ts"), F.sha2("raw", 256).alias("obs_id"))
    return arp.unionByName(dhcp).filter(F.coalesce(F.col("ip"), F.lit("")) != "")


def communications(f: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges between assets that exchanged flows, both endpoints resolved to their owner at the flow's time."""
    owned = assets.ip_ownership(assets.leases(evidence))
    e = assets.resolve(assets.resolve(f, owned, "src_ip", "event_time", "from"), owned, "dest_ip", "event_time", "to")
    return assets.relations(e, ["tenant", "from", "to"], "event_time", "flow_id")
