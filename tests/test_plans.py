"""Sources, whole plans over event records, the read API, sinks and streams."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.plans import api, detections, normalize, queries
from packetloom.sources import config, eve, feeds, sinks, zeek
from packetloom.streaming import detect, run, stateful

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


def stamp(s):
    return (dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S+0000")


def record(kind, t, src="10.0.0.5", dst="198.51.100.66", **more):
    return {"timestamp": stamp(t), "event_type": kind, "src_ip": src, "dest_ip": dst, "tenant": "t1", "sensor_id": "s1", "flow_id": f"{kind}{t}{src}{dst}", **more}


def write(tmp_path, events, name="eve.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))
    return str(path)


def scenario():
    ev = [record("flow", 20 * i, flow={"bytes_toserver": 500, "bytes_toclient": 100, "age": 1.0}) for i in range(12)]
    ev += [record("flow", i, src="10.0.0.9", dst=f"10.0.1.{i}", dest_port=445, flow={"bytes_toserver": 1}) for i in range(30)]
    ev += [record("flow", 5, src="10.0.0.7", dst="198.51.100.9", flow={"bytes_toserver": 60_000_000, "age": 4000.0})]
    ev += [record("dns", i, src="10.0.0.8", dst="10.0.0.1", dns={"type": "query", "rrname": f"{i:045x}.t.evil.com", "rcode": "NXDOMAIN"}) for i in range(60)]
    ev += [record("dns", 0, dns={"type": "answer", "rrname": "x", "version": 2})]
    ev += [record("http", 1, http={"http_method": "GET", "url": "/a?id=1' or 1=1", "http_user_agent": "curl/8"}, community_id="c1")]
    ev += [record("tls", 0, tls={"sni": "front.example", "subject": "CN=a", "issuerdn": "CN=a", "ja3": {"hash": "abc", "string": "1"}}, community_id="c1")]
    ev += [record("http", 2, http={"hostname": "hidden.example", "http_method": "GET", "url": "/", "http_user_agent": "Mozilla"}, community_id="c1")]
    ev += [record("krb5", i, krb5={"msg_type": "KRB_TGS_REQ", "sname": f"svc{i}", "encryption": "rc4-hmac"}) for i in range(8)]
    ev += [record("smb", 3, dst="10.0.0.3", smb={"command": "SMB2_COMMAND_CREATE", "named_pipe": "\\PIPE\\svcctl"})]
    ev += [record("alert", 4, alert={"signature": "ET MALWARE X", "severity": 1, "category": "Misc Attack"})]
    ev += [record("alert", 5, alert={"signature": "ET INFO X", "severity": 1, "category": "Misc Attack"})]
    ev += [record("modbus", 6, dst="10.0.5.5", dest_port=503, modbus={"function": {"code": 3}})]
    ev += [record("stats", 7, stats={"capture": {"kernel_packets": 100, "kernel_drops": 10}, "decoder": {"pkts": 100}})]
    ev += [record("anomaly", 8, anomaly={"type": "applayer", "event": "x"})]
    ev += [record("fileinfo", 9, fileinfo={"filename": "a.exe", "mime_type": "application/x-dosexec", "state": "CLOSED", "gaps": False, "sha256": "a" * 64})]
    ev += [record("fileinfo", 9, fileinfo={"filename": "b", "sha256": "short"})]
    ev += ["{broken", record("dhcp", 0, dhcp={"assigned_ip": "10.0.0.5", "client_mac": "AA:BB", "hostname": "h5", "lease_time": 3600})]
    return ev


def test_detections_over_records(spark, tmp_path):
    df = eve.read_jsonl(spark, write(tmp_path, scenario())).cache()
    got = detections.all_detections(df.filter("_corrupt_record IS NULL")).collect()
    by = {}
    for f in got:
        by.setdefault(f.detector_id, []).append(f)
        assert 1 <= f.severity <= 10 and 0 <= f.confidence <= 1 and f.tenant == "t1"
    for d in ("beacon", "exfil", "long_connection", "horizontal_scan", "lateral_movement", "internal_scan", "dns_tunnel", "dns_exploded", "nxdomain_burst", "http_sqli", "suspicious_ua",
              "ech_sni_mismatch", "tls_cert_anomaly", "kerberoasting", "lateral_exec", "ids_signature", "modbus_port_anomaly", "coverage_degraded", "protocol_anomaly", "risky_file_delivery"):
        assert d in by, d
    assert [(f.src_ip, f.dest_ip) for f in by["beacon"]] == [("10.0.0.5", "198.51.100.66")]
    assert len(by["ids_signature"]) == 1 and by["kerberoasting"][0].src_ip == "10.0.0.5"
    again = detections.all_detections(df.unionByName(df).filter("_corrupt_record IS NULL")).filter(F.col("detector_id").isin("beacon", "exfil", "http_sqli", "ids_signature"))
    assert {f.finding_id for f in again.collect()} == {f.finding_id for d in ("beacon", "exfil", "http_sqli", "ids_signature") for f in by[d]}


def test_long_urls_are_findings_of_their_own(spark):
    rows = [("t", "10.0.0.1", "8.8.8.8", f"/{'x' * 300}{i}?q=1' or 1=1", "GET", "Mozilla/5.0") for i in range(3)]
    h = spark.createDataFrame(rows, "tenant string, src_ip string, dest_ip string, url string, method string, user_agent string").withColumn("event_time", F.timestamp_seconds(F.lit(0)))
    found = detections.http_detections(h)[0].collect()
    assert len(found) == 3 and len({f.finding_id for f in found}) == 3


def test_correlation_notices_and_intel(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    notes = spark.createDataFrame([("t", "Scan::Other", "10.0.0.1", "10.0.0.2"), ("t", "CaptureLoss::Too_Much_Loss", "a", "b"), ("t", "SSL::Weak_Key", "10.0.0.1", "10.0.0.3")], "tenant string, note string, src_ip string, dest_ip string").withColumn("event_time", at)
    found = detections.notice_detections(notes)[0]
    assert {(f.detector_id, f.category) for f in found.collect()} == {("zeek_notice", "recon"), ("zeek_notice", "c2")}
    alerts = spark.createDataFrame([("t", "10.0.0.1", "1.2.3.4", "high", "Intrusion.Botnet", "0.6", "rnn")], "tenant string, attacker string, victim string, threat_level string, kind string, confidence string, module string").withColumn("event_time", at)
    found = found.unionByName(detections.alert_detections(alerts)[0])
    got = {f.detector_id: f for f in detections.correlated(found, F.timestamp_seconds(F.lit(1_700_000_100))).collect()}
    assert set(got) == {"correlation_incident", "correlation_corroboration"} and got["correlation_corroboration"].category == "c2"
    assert detections.correlated(found, F.timestamp_seconds(F.lit(1_800_000_000))).count() == 0


def test_context_moves_severity(spark):
    rows = [("t", "10.0.0.1", "8.8.8.8", 1, None), ("t", "10.0.0.1", "8.8.8.8", 5, '{"breed": "Unsafe", "flow_risk": {"1": {"risk": "Malicious JA3 Fingerprint", "severity": "High"}}}'), ("t", "10.0.0.2", "9.9.9.9", 1, '{"breed": "Safe"}')]
    f = spark.createDataFrame(rows, "tenant string, src_ip string, dest_ip string, s long, ndpi string").withColumn("event_time", F.timestamp_seconds("s"))
    intel = spark.createDataFrame([("t", "ip", "9.9.9.0/24", "active")], "tenant string, kind string, indicator string, disposition string")
    got = {r.dest_ip: (r.breed, r.risky, r.listed, r.n_sources) for r in detections.context(f, intel).collect()}
    assert got == {"8.8.8.8": ("Unsafe", True, False, 1), "9.9.9.9": ("Safe", False, True, 1)}


def test_typed_tables_and_quarantine(spark, tmp_path):
    t = normalize.typed(eve.read_jsonl(spark, write(tmp_path, scenario())))
    assert t["flow"].count() == 43 and t["dns"].count() == 60 and t["tls"].first().ja3 == "abc" and t["file"].first()["mode"] == "hashes_only"
    assert sorted(r.reason for r in t["quarantine"].collect()) == ["dns version", "malformed", "malformed digest"]


def test_observations_and_read_api(spark, tmp_path):
    df = eve.read_jsonl(spark, write(tmp_path, scenario())).filter("_corrupt_record IS NULL")
    obs = normalize.observations(df, F.lit("topic"), F.lit(0), F.monotonically_increasing_id(), F.lit("2024-01-01T00:00:00Z"))
    obs.write.parquet(str(tmp_path / "observations"))
    found = detections.all_detections(df).withColumns({"revision": F.lit(1), "ingested_at": F.lit(0)})
    found.write.parquet(str(tmp_path / "findings"))
    e = api.Engine(spark, str(tmp_path), ["t1"])
    start = 1704067200
    page = e.observations("10.0.0.5", start, start + 3600, page=10).collect()
    assert len(page) == 11 and all("10.0.0.5" in r.entity_values for r in page)
    rest = e.observations("10.0.0.5", start, start + 3600, page=10, after=(page[9].ts, page[9].obs_id)).collect()
    assert rest[0].obs_id == page[10].obs_id
    assert e.findings("10.0.0.5", start, start + 3600).count() > 3
    assert api.Engine(spark, str(tmp_path), ["other"]).observations("10.0.0.5", start, start + 3600).count() == 0
    assert e.triage("10.0.0.5", start, start + 3600).first().verdict == "undetermined"
    with pytest.raises(ValueError, match="tenant"):
        api.Engine(spark, str(tmp_path), [])


def test_identity_and_edges(spark, tmp_path):
    df = eve.read_jsonl(spark, write(tmp_path, scenario())).filter("_corrupt_record IS NULL")
    edges = detections.communications(normalize.flows(df), detections.identity_evidence(df)).collect()
    assert ("mac:aa:bb", "ip:198.51.100.66") in {(x["from"], x["to"]) for x in edges}


def test_routing(spark, tmp_path):
    df = eve.routed(eve.read_jsonl(spark, write(tmp_path, scenario()[:1] + [{"event_type": "stats"}, {"event_type": "weird", "src_ip": ""}])), "mine", "s9")
    assert {(r.topic, r.key, r.tenant) for r in df.collect()} == {("suricata.flow.v1", "10.0.0.5", "mine"), ("suricata.stats.v1", "stats", "mine"), ("suricata.raw.v1", "unkeyed", "mine")}
    with pytest.raises(ValueError, match="offsets"):
        eve.kafka_options("h:1", ["a"], offsets="none")


def test_zeek_logs(spark, tmp_path):
    path = write(tmp_path, ["#separator \\x09", "#fields\tts\tid.resp_h\tquery\trcode_name", "1\t8.8.8.8\ta.com\tNXDOMAIN", "2\t8.8.8.8\t-", "#close"], "dns.log")
    rows = zeek.read_tsv(spark, path)
    assert [r.fields.get("query") for r in rows.orderBy("value").collect()] == ["a.com", None]
    assert zeek.summary(rows, "dns").first().n_nxdomain == 1


def test_feeds(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), ("1.2.3.4,x",), ("",), ("host.example",), ("d41d8cd98f00b204e9800998ecf8427e,f",), ("http://E.org/a,url,80",), ("bad value",)], "value string")
    assert [r.indicator for r in feeds.address_list(lines).collect()] == ["1.2.3.4"]
    assert [r.indicator for r in feeds.hash_list(lines).collect()] == ["d41d8cd98f00b204e9800998ecf8427e"]
    assert {(r.kind, r.indicator) for r in feeds.generic(lines).filter("kind <> 'x'").collect()} >= {("domain", "host.example"), ("url", "http://E.org/a")}
    bundle = {"objects": [
        {"type": "marking-definition", "id": "m1", "definition": {"tlp": "green"}},
        {"type": "indicator", "id": "i1", "pattern": "[domain-name:value = 'evil.com']", "valid_from": "2024-01-01T00:00:00Z", "object_marking_refs": ["m1"]},
        {"type": "indicator", "id": "i2", "pattern": "[ipv4-addr:value = '1.2.3.4'] AND [domain-name:value = 'x']", "object_marking_refs": []},
        {"type": "indicator", "id": "i3", "pattern": "[url:value = 'http://x/']", "revoked": True, "object_marking_refs": ["unknown"]},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    got = {r.id: (r.kind, r.indicator, r.revoked, r.tlp) for r in feeds.stix(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"i1": ("domain", "evil.com", False, "green"), "i3": ("url", "http://x/", True, "red")}
    ev = {"Event": {"id": "1", "Tag": [{"name": "tlp:amber"}], "Attribute": [{"type": "ip-dst", "value": "1.1.1.1", "to_ids": True, "timestamp": "1", "Tag": [{"name": "tlp:green"}]}, {"type": "comment", "value": "x"}]}}
    (tmp_path / "m.json").write_text(json.dumps(ev))
    assert [(r.kind, r.indicator, r.tlp) for r in feeds.misp(spark, str(tmp_path / "m.json")).collect()] == [("ip", "1.1.1.1", "amber")]


def test_thresholds():
    t = config.merged(config.Thresholds(), '{"beacon_min_conns": 9, "strobe_min_conns": "x", "exfil_bytes": 5, "unknown": 1, "rare_history": -1}')
    assert (t.beacon_min_conns, t.strobe_min_conns, t.exfil_bytes, t.rare_history) == (9, 90, 5.0, 15)
    assert config.merged(t, "{bad") == t


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", "e", 1)], "tenant string, entity string, n int")
    sinks.fan_out(sinks.to_parquet(str(tmp_path / "p")), sinks.to_jsonl(str(tmp_path / "j")))(df, 3)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert sinks.kafka_rows(df).first().key == "t|e"

    def broken(df, batch):
        raise OSError("down")

    with pytest.raises(ExceptionGroup):
        sinks.fan_out(broken, sinks.to_parquet(str(tmp_path / "q")))(df, 0)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    assert sinks.syslog_frame("x").startswith(b"38 <134>1 - packetloom")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_driver_queries_run(spark, name):
    queries.QUERIES[name](spark, SMALL).limit(1).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracle_sql_parses():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        con.sql(f"SELECT * FROM ({sql}) LIMIT 1").fetchall(), name


def stream(spark, tmp_path, df, make, name):
    """Rows of a stream over what a batch table holds, and a last row that moves the watermark past it."""
    src = str(tmp_path / f"{name}-in")
    df.write.parquet(src)
    out = []
    q = run.start(make(spark.readStream.schema(df.schema).parquet(src)), lambda b, _: out.extend(b.collect()), str(tmp_path / f"{name}-cp"))
    q.awaitTermination()
    return out


def test_streaming_windows_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [("a", f"d{i % 25}", base + dt.timedelta(seconds=i)) for i in range(50)] + [("b", "d", base)] + [("z", "z", base + dt.timedelta(hours=3))]
    df = spark.createDataFrame(data, "src string, dst string, event_time timestamp")
    got = stream(spark, tmp_path, df, lambda s: detect.distinct_members(s, ["src"], F.col("dst"), "1 minute", 20), "scan")
    assert [(r.src, r.n) for r in got] == [("a", 25)]
    ses = stream(spark, tmp_path, df, lambda s: detect.sessions(s, ["src"], "2 minutes"), "session")
    assert {(r.src, r.n) for r in ses} == {("a", 50), ("b", 1)}


def test_streaming_beacons(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [("h", base + dt.timedelta(seconds=20 * i)) for i in range(12)] + [("z", base + dt.timedelta(hours=3))]
    got = stream(spark, tmp_path, spark.createDataFrame(data, "src string, event_time timestamp"), lambda s: detect.beacons(s, ["src"], "10 minutes", "5 minutes"), "beacon")
    assert got and {r.src for r in got} == {"h"} and max(r.score for r in got) == 1.0


def test_stateful_processors(spark, tmp_path):
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    base = dt.datetime(2024, 1, 1)
    data = [("k", f"m{i}", "candidate" if i == 0 else "x", base + dt.timedelta(seconds=i)) for i in range(20)]
    df = spark.createDataFrame(data, "key string, member string, kind string, event_time timestamp")
    got = stream(spark, tmp_path, df, lambda s: stateful.first_seen_ranks(s, 15), "rank")
    assert sorted((r.member, r["rank"]) for r in got) == [("m15", 15), ("m16", 16), ("m17", 17), ("m18", 18), ("m19", 19)]
    got = stream(spark, tmp_path, df, lambda s: stateful.first_write_counts(s, 10, 5), "count")
    assert [r.n for r in got] == [5, 5]


def test_streaming_volumes_count_the_last_record_of_a_flow(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [("a", "f1", base, 100.0), ("a", "f1", base + dt.timedelta(seconds=5), 300.0), ("a", "f2", base, 20.0), ("z", "f", base + dt.timedelta(hours=5), 0.0), ("z", "f", base + dt.timedelta(hours=9), 0.0)]
    df = spark.createDataFrame(data, "src string, flow string, event_time timestamp, b double")
    got = stream(spark, tmp_path, df, lambda s: detect.volumes(s, ["src"], ["flow"], "b"), "volume")
    assert {(r.src, r.total, r.n_flows) for r in got if r.src == "a"} == {("a", 320.0, 2)}
    got = stream(spark, tmp_path, df.unionByName(df), lambda s: detect.bursts(detect.once(s, ["src", "flow", "b"]), ["src"], F.col("b") >= 0, "10 minutes", 1, lateness=None), "burst")
    assert {(r.src, r.n) for r in got if r.src == "a"} == {("a", 3)}


def test_pending_findings_time_out_or_reopen(spark, tmp_path):
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    src, out = tmp_path / "pending-in", []
    schema = "key string, kind string, event_time timestamp"
    batches = [[("a", "candidate", at(0)), ("b", "candidate", at(0))], [("a", "result", at(30))], [("z", "x", at(4000))], [("b", "result", at(4010)), ("z", "x", at(9000))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = run.start(stateful.pending_findings(spark.readStream.schema(schema).parquet(str(src)), 600), lambda b, _: out.extend(b.collect()), str(tmp_path / "pending-cp"))
        q.awaitTermination()
    assert sorted((r.key, r.revision, r.outcome) for r in out) == [("a", 2, "enriched"), ("b", 2, "timeout"), ("b", 3, "reopened")]


def test_members_age_and_values_are_set_once(spark, tmp_path):
    events = spark.createDataFrame([("a", "x", 1000), ("a", "y", 1050), ("a", "z", 1130), ("b", "x", 1000)], "key string, member string, s long").select("key", "member", F.col("member").alias("value"), F.timestamp_seconds("s").alias("event_time"))
    events.write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = make(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    own = run(lambda s: stateful.live_members(s, 100, refresh=False), "own_age")
    assert {(r.key, r.n) for r in own} >= {("a", 2), ("b", 1)}  # x has aged
    whole = run(lambda s: stateful.live_members(s, 100, refresh=True), "refreshed")
    assert {(r.key, r.n) for r in whole} >= {("a", 3), ("b", 1)}
    once = run(lambda s: stateful.set_once(s, 100), "set_once")
    assert sorted((r.key, r.value) for r in once) == [("a", "x"), ("a", "z"), ("b", "x")]
