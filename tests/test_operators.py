"""Operators on hand-made rows with known answers, and properties that must not depend on order."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import assets, baseline, counts, evidence, findings, flows, intel, joins, latest, novelty, scoring, siem, windows
from packetloom.plans import queries

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_beacons_find_callbacks_only(spark):
    r = random.Random(1)
    data = [("h1", "c2", at(20 * i), 100.0) for i in range(12)] + [("h2", "web", at(r.random() * 3600), r.random() * 1e5) for _ in range(40)] + [("h3", "few", at(60 * i), 1.0) for i in range(5)]
    df = spark.createDataFrame(data + data[:6], "src string, dst string, ts timestamp, bytes double")
    got = {x.src: x for x in flows.beacons(df, ["src", "dst"], size="bytes").collect()}
    assert got["h1"].score == 1.0 and got["h1"].is_beacon and got["h1"].n_conns == 12
    assert not got["h2"].is_beacon and "h3" not in got


def autocorrelated(spark, *series):
    rows = [(i, float(t)) for i, ts in enumerate(series) for t in ts]
    frame = spark.createDataFrame(rows, "pair int, at double").select("pair", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"))
    got = {r.pair: r for r in flows.autocorr_beacons(frame, ["pair"]).collect()}
    return [got.get(i) for i in range(len(series))]


def test_autocorrelation_on_documented_outcomes(spark):
    missed = [[60.0 * i for i in range(46) if i % 3 != phase] for phase in range(3)]
    jitter = random.Random(4242)
    shaken = [60.0 * i + jitter.uniform(-9, 9) for i in range(90) if i % 3]
    walk, w = [], random.Random(99)
    for _ in range(40):
        walk.append((walk[-1] if walk else 0.0) + 60 * (1 + w.uniform(-0.5, 0.5)))
    dense = random.Random(11)
    quiet = [np.cumsum(np.random.default_rng(s).exponential(60, n)).tolist() for n in (40, 12) for s in range(20)]
    got = autocorrelated(spark, *missed, shaken, walk, sorted(dense.uniform(0, 600) for _ in range(600)), *quiet, [1.0] * 20, list(range(5)))
    assert all(g.is_beacon and g.score > 0.9 and abs(g.period - 60) <= 30 for g in got[:3])
    assert got[3].is_beacon and got[3].score >= 0.7
    assert not any(g.is_beacon for g in got[4:-1]) and got[-2].score == 0 and got[-1] is None


def test_autocorrelation_takes_the_whole_series():
    early = [10.0 * i for i in range(200)]
    far = [1e7 + 10.0 * i for i in range(200)]  # a million bins between two bursts of callbacks
    strength, period = flows.periodicity(early + far)
    assert period == 10.0 and strength > 0.9
    r = np.random.default_rng(3)
    places, counts = np.unique(r.integers(0, 400, 150), return_counts=True)
    line = np.bincount(places, counts, 401)
    want = {k: int((line[:-k] * line[k:]).sum()) for k in range(1, 150)}
    want = {k: v for k, v in want.items() if v}
    for tail in ([], [10**9]):  # by transform, and by pairs
        lags, pairs = flows.pair_counts(np.concatenate([places, tail]).astype(int), np.concatenate([counts, [1] * len(tail)]), 149)
        assert dict(zip(lags.tolist(), pairs.tolist(), strict=True)) == want


def test_autocorr_operator(spark):
    data = [("a", at(60 * i)) for i in range(45) if i % 3 != 2] + [("b", at(i * i % 977)) for i in range(30)]
    got = {x.src: x.is_beacon for x in flows.autocorr_beacons(spark.createDataFrame(data, "src string, ts timestamp"), ["src"]).collect()}
    assert got["a"]


def test_volumes_count_the_last_record_of_a_flow(spark):
    data = [("a", "f1", 1, 100.0), ("a", "f1", 2, 300.0), ("a", "f1", 3, 50.0), ("a", "f2", 1, 200.0)]
    df = spark.createDataFrame(data, "src string, flow string, seq int, b double")
    for some in (df, df.unionByName(df), df.orderBy(F.desc("seq"))):
        assert rows(flows.volumes(some, ["src"], ["flow"], "seq", "b", 100), "src") == [("a", 250.0, 2, 1)]


def test_exfil_needs_spread_material(spark):
    df = spark.createDataFrame([("bulk", 60e6, 1, 1), ("slow", 6e6, 12, 6), ("signal", 6e6, 12, 1), ("small", 1e6, 40, 9)], "src string, total double, n_flows long, n_material long")
    assert {x.src: x.detector_id for x in flows.exfil(df).collect()} == {"bulk": "exfil", "slow": "low_slow_exfil"}


def test_rare_destinations_need_history(spark):
    df = spark.createDataFrame([("a", f"d{i:02}", at(i)) for i in range(17)] + [("b", "d00", at(0))], "src string, dst string, ts timestamp")
    assert [(x.dst, x.rank) for x in flows.rare_destinations(df, ["src"], "dst").orderBy("rank").collect()] == [("d15", 15), ("d16", 16)]


def test_severity_gate(spark):
    make = lambda *a: flows.gated_severity(*[F.lit(x) for x in a[:4]], F.lit(a[4]).cast("long"))
    row = spark.range(1).select(make(7, "Safe", False, False, 5), make(7, "Unsafe", False, False, 1), make(9, "", True, True, 1), make(1, "safe", False, False, 9), make(7, "Safe", False, True, 5)).first()
    assert tuple(row) == (5, 10, 10, 1, 7)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(700)), (3, "b", at(5)), (4, "a", at(0))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(0), "x"), ("a", at(5), "y"), ("a", at(5), "w"), ("a", at(11), "z"), ("c", at(0), "q")], "k string, at timestamp, v string")
    assert rows(joins.asof_join(left, right, ["k"], "ts", "at", ["v"], 600).select("id", "v"), "id") == [(1, "y"), (2, None), (3, None), (4, "x")]
    assert rows(joins.asof_join(left, right, ["k"], "ts", "at", ["v"], 600, strict=True).select("id", "v"), "id") == [(1, "y"), (2, None), (3, None), (4, None)]


@pytest.mark.parametrize("how", [{}, {"within": 50}, {"block": 40}, {"block": 7, "strict": True}, {"within": 1, "strict": True}])
def test_asof_join_in_blocks_equals_brute_force(spark, how):
    r = random.Random(3)
    left = [(i, r.choice(["a", "a", "b", None]), r.choice([None, *range(300)])) for i in range(120)] + [(i, "a", 80) for i in range(120, 125)]
    right = [(r.choice(["a", "b", None]), r.choice([None, *range(300)]), i) for i in range(25)] + [("a", 80, 99), ("a", 80, 98), ("a", 40, 97)]
    t = lambda s: None if s is None else at(s)
    a = spark.createDataFrame([(i, k, t(s)) for i, k, s in left], "id int, k string, ts timestamp")
    b = spark.createDataFrame([(k, t(s), v) for k, s, v in right], "k string, at timestamp, v int")
    want = []
    for i, k, s in left:
        seen = [(u, v) for q, u, v in right if q == k and None not in (s, u) and (u < s if how.get("strict") else u <= s)]
        hit = max(seen, default=None)
        want.append((i, hit[1] if hit and s - hit[0] <= how.get("within", 1000) else None))
    assert rows(joins.asof_join(a, b, ["k"], "ts", "at", ["v"], **how).select("id", "v"), "id") == want


def test_cidr_join_of_both_families(spark):
    left = spark.createDataFrame([("10.1.2.3",), ("10.9.0.1",), ("2001:db8::5",), ("x",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.2.0/24",), ("10.1.2.3",), ("2001:db8::/32",), ("bad/9",)], "net string")
    got = rows(joins.cidr_join(left, "ip", nets, "net"), "ip", "net")
    assert got == [("10.1.2.3", "10.0.0.0/8"), ("10.1.2.3", "10.1.2.0/24"), ("10.1.2.3", "10.1.2.3"), ("10.9.0.1", "10.0.0.0/8"), ("2001:db8::5", "2001:db8::/32")]
    plan = joins.cidr_join(left, "ip", nets, "net")._jdf.queryExecution().optimizedPlan().toString()
    assert "(_mask" in plan.replace("`", "")


def test_members_of_shared_networks(spark):
    left = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.1.9.9"), (3, "2001:db8::5"), (4, "x"), (5, None), (6, "10.1.2.3")], "id long, ip string")
    nets = ["10.1.0.0/16", "10.1.2.0/24", "2001:db8::/32", "bad/9"]
    member = spark.createDataFrame([(m, nets[m % 4]) for m in range(40)] + [(3, "10.1.2.3"), (0, nets[0])], "m long, net string")
    of = lambda *ks: sorted(m for m in range(40) if m % 4 in ks)
    want = [(i, m) for i, ms in ((1, [0, *of(0, 1), 3]), (2, [0, *of(0)]), (3, of(2)), (6, [0, *of(0, 1), 3])) for m in sorted(ms)]
    for span in (7, 65_536):
        got = joins.cidr_members(left, "id", "ip", member, "m", "net", span)
        assert sorted(map(tuple, got.collect())) == want
    # rows of a small table are dealt out before they multiply, and pairs come from lists
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "explode(_members" in plan
    plan = queries.QUERIES["cidr_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "explode(_members" in plan


def test_members_in_blocks_are_small_files(spark, tmp_path):
    """24 million pairs: runs of a member and short lists that repeat; with a list of all 12,000 members an id they took over a byte each."""
    left = spark.range(2_000).select("id", F.format_string("10.1.%d.%d", F.col("id") % 8, F.col("id") % 250).alias("ip"))
    nets = F.array(*map(F.lit, ["10.1.0.0/16", "10.1.0.0/21", "10.1.7.0/16", "10.1.255.255/16"]))
    member = spark.range(12_000).select(F.col("id").alias("m"), F.get(nets, (F.col("id") % 4).cast("int")).alias("net"))
    joins.cidr_members(left, "id", "ip", member, "m", "net").write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert tuple(got.agg(F.count("*"), F.sum("id"), F.sum("m")).first()) == (24_000_000, 12_000 * sum(range(2_000)), 2_000 * sum(range(12_000)))
    assert got.groupBy("id").agg(F.countDistinct("m").alias("n")).filter("n <> 12000").isEmpty()
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.5 * 24_000_000


def test_members_of_equal_networks_that_are_cut_within_a_digit(spark):
    """Bits 17 to 21 are set, so a mask of a mask would be another one; two spellings of a network are one."""
    left = spark.createDataFrame([(1, "10.1.250.1"), (2, "10.1.242.9"), (3, "10.1.250.7"), (4, "10.1.120.1")], "id long, ip string")
    member = spark.createDataFrame([(10, "10.1.248.0/21"), (11, "10.1.255.1/21"), (12, "10.1.240.0/21"), (13, "10.1.0.0/17"), (14, "10.1.250.0/24")], "m long, net string")
    got = joins.cidr_members(left, "id", "ip", member, "m", "net")
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (1, 14), (2, 12), (3, 10), (3, 11), (3, 14), (4, 13)]


LEASES = [("i", "m1", 0, 100, "o1"), ("i", "m2", 50, 70, "o2"), ("i", "m1", 50, 500, "o3"), ("i", "m1", 90, 120, "o4"), ("i", "m1", 110, 200, "o5"), ("j", "m3", 0, None, "o6")]


def test_ownership_does_not_depend_on_order(spark):
    want = [("i", "m1", 0, 50), ("i", "m2", 50, 70), ("i", "m1", 90, 200), ("j", "m3", 0, None)]
    r = random.Random(3)
    for _ in range(3):
        some = LEASES + LEASES[:2]
        r.shuffle(some)
        df = spark.createDataFrame(some, "ip string, mac string, start int, end int, obs string")
        got = windows.ownership_intervals(df, ["ip"], "mac", "start", "end", ["obs"]).select("ip", "mac", "valid_from", "valid_to")
        assert rows(got, "ip", "valid_from") == want
    asks = spark.createDataFrame([("i", t) for t in (0, 49, 50, 70, 89, 90, 150, 200)] + [("j", 10**6), ("k", 1)], "ip string, ts int")
    owned = windows.ownership_intervals(spark.createDataFrame(LEASES, "ip string, mac string, start int, end int, obs string"), ["ip"], "mac", "start", "end", ["obs"])
    got = dict((x[0], x[1]) for x in rows(windows.owner_at(asks, owned, ["ip"], "ts", "mac").select("ts", "mac"), "ts"))
    assert got == {0: "m1", 49: "m1", 50: "m2", 70: None, 89: None, 90: "m1", 150: "m1", 200: None, 10**6: "m3", 1: None}


def brute_facts(items):
    """The interval walk, one fact after another."""
    out = []
    for ts, v, x in items:
        cur = out[-1] if out else None
        if cur and cur["v"] == v and cur["to"] is None and (cur["x"] is None or ts < cur["x"]):
            cur["n"] += 1
            if x is not None and (cur["x"] is None or x > cur["x"]):
                cur["x"] = x
            continue
        if cur and cur["to"] is None:
            cur["to"] = ts if cur["x"] is None else min(ts, cur["x"])
        out.append({"v": v, "from": ts, "to": None, "x": x, "n": 1})
    if out and out[-1]["to"] is None:
        out[-1]["to"] = out[-1]["x"]
    return [(o["v"], o["from"], o["to"], o["n"]) for o in out]


@pytest.mark.parametrize("leases", ["always", "never"])
def test_fact_intervals_equal_a_walk(spark, leases):
    r = random.Random(4)
    data, want = [], {}
    for k in range(30):
        items = [(t, r.choice("ab"), t + r.randrange(1, 30) if leases == "always" else None) for t in sorted(r.sample(range(200), r.randint(1, 14)))]
        # renewals of one value never shorten the lease known so far
        want[k] = brute_facts(items)
        data += [(k, *i) for i in items]
    df = spark.createDataFrame(data, "k int, ts int, v string, x int")
    got = {}
    for k, *rest in rows(windows.fact_intervals(df, ["k"], "v", "ts", "x", [F.col("v")]), "k", "valid_from"):
        got.setdefault(k, []).append(tuple(rest))
    assert got == want


def test_sessions_and_tumbling(spark):
    df = spark.createDataFrame([("a", at(s), i) for i, s in enumerate((0, 60, 180, 301, 500))], "k string, ts timestamp, id int")
    got = windows.sessions(df, ["k"], "ts", "2 minutes", "id").orderBy("session_start").collect()
    assert [(x.n, x.first_id) for x in got] == [(3, 0), (1, 3), (1, 4)]
    many = spark.createDataFrame([("s", f"d{i % 25}", at(i)) for i in range(50)], "src string, dst string, ts timestamp")
    assert [x.n for x in windows.tumbling_distinct(many, ["src"], F.col("dst"), "ts", "1 minute", 20).collect()] == [25]


def test_trailing_distinct_equals_brute_force(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), r.choice("vwxyz"), r.randrange(100)) for _ in range(80)]
    df = spark.createDataFrame([(k, v, at(t), t) for k, v, t in data], "k string, v string, ts timestamp, t int")
    for x in windows.trailing_distinct(df, ["k"], "v", "ts", 10).collect():
        assert x.n_recent == len({v for k, v, t in data if k == x.k and x.t - 10 <= t <= x.t})


def test_novelty_is_scored_before_it_is_learned(spark):
    data = [("e", v, at(i)) for i, v in enumerate("abcdeafg")]
    df = spark.createDataFrame(data, "k string, v string, ts timestamp")
    got = rows(novelty.rare_values(df, ["k"], "v", "ts", 5).select("v", "n_prior_distinct"), "v")
    assert got == [("f", 5), ("g", 6)]


def test_ja4_novelty(spark):
    fp = lambda a, b, c: f"t13d{a:04}h2_{b:012}_{c:012}"
    data = [("e1", fp(1, 1, 1), at(900 * i)) for i in range(120)]
    data += [("e1", fp(2, 2, 2), at(900 * 121)), ("e1", fp(1, 9, 1), at(900 * 122)), ("e2", fp(3, 3, 3), at(0))] + [(f"x{i}", fp(5, 5, 5), at(i)) for i in range(5)] + [("e1", fp(5, 5, 5), at(900 * 123))]
    df = spark.createDataFrame(data, "entity string, fp string, ts timestamp").withColumn("tenant", F.lit("t"))
    got = {x.fp: (x.severity, x.confidence, x.n_fleet) for x in novelty.ja4_novelty(df, ["tenant"], "entity", "fp", "ts").collect()}
    assert got == {fp(2, 2, 2): (5, 0.5, 1), fp(1, 9, 1): (4, 0.25, 1), fp(5, 5, 5): (2, 0.3, 6)}


def test_outbound_baseline_needs_peers(spark):
    data = [("c", e, 300 * w, 1000.0 + 10 * w) for e in ("a", "b", "d") for w in range(6)] + [("c", "a", 1800, 500_000.0), ("c", "b", 1800, 1060.0), ("lone", "z", 0, 1.0), ("lone", "z", 1800, 9e9)]
    got = baseline.outbound_anomalies(spark.createDataFrame(data, "cohort string, e string, start long, bytes_out double"), ["cohort"], "e").collect()
    assert [(x.e, x.start, x.mode, x.confidence) for x in got] == [("a", 1800, "entity-and-peer", 0.8)] and got[0].score > 100


def test_counting_detections(spark):
    df = spark.createDataFrame([("s", f"d{i}", 445, "x") for i in range(6)] + [("s", "d0", p, "x") for p in range(16)], "src string, dst string, port int, n string")
    assert counts.lateral_fanout(df, ["src"], "dst", "port").first().n == 6
    assert tuple(counts.internal_scans(df, ["src"], "dst", "port").first()) == ("s", "vertical", 17)
    k = spark.createDataFrame([("a", f"spn{i}", "18") for i in range(8)] + [("b", f"spn{i}", "23") for i in range(3)] + [("c", "spn", "23"), ("a", "", "18")], "src string, spn string, e string")
    assert {x.src: x.n for x in counts.kerberoasting(k, ["src"], "spn", "e").collect()} == {"a": 8, "b": 3}
    q = spark.createDataFrame([("c", f"{i:040x}.t.evil.com") for i in range(60)] + [("d", "www.example.org")] * 60, "client string, name string")
    assert [x.client for x in counts.dns_tunnels(q, ["client"], "name").collect()] == ["c"]
    assert [(x.client, x.parent, x.n) for x in counts.dns_exploded(q, ["client"], "name").collect()] == [("c", "evil.com", 60)]


def test_current_rows_and_tombstones(spark):
    df = spark.createDataFrame([("k", 1, 0, "a"), ("k", 2, 0, "b"), ("k", 2, 1, "b"), ("l", 1, 0, "c")], "id string, v int, gone int, x string")
    assert rows(latest.live_facts(df, ["id"], "v", "gone").select("id", "x"), "id") == [("l", "c")]
    assert rows(latest.current(df, ["id"], ["v", "gone"]).select("id", "gone"), "id") == [("k", 1), ("l", 0)]


def finding_rows(spark):
    data = [("e", "beacon", "c2", 8, at(0), "f1"), ("e", "strobe", "c2", 8, at(0), "f2"), ("e", "exfil", "exfil", 9, at(10), "f3"), ("g", "slips_ml", "c2", 6, at(0), "f4"), ("g", "beacon", "c2", 7, at(0), "f5"), ("h", "correlation_incident", "incident", 10, at(0), "f6")]
    return spark.createDataFrame(data, "entity string, detector_id string, category string, severity int, ts timestamp, finding_id string")


def test_risk_is_capped_by_family_and_incidents_have_reasons(spark):
    now = F.lit(at(10))
    got = dict(rows(findings.entity_risk(finding_rows(spark), ["entity"], now), "entity"))
    assert got["e"] == pytest.approx(10.0 + 5.0) and got["g"] == pytest.approx(6 + 7, abs=0.1) and "h" not in got
    inc = {x.entity: x for x in findings.incidents(finding_rows(spark), ["entity"], now).collect()}
    assert (inc["e"].reason, inc["e"].severity) == ("kill-chain", 10) and inc["g"].reason == "risk-threshold"
    cor = findings.corroborations(finding_rows(spark), ["entity"]).collect()
    assert [(x.entity, x.category, x.detectors, x.severity) for x in cor] == [("g", "c2", ["beacon", "slips_ml"], 9)]


def test_kill_chain_is_ordered_in_time(spark):
    df = spark.createDataFrame([("up", 0, 1), ("up", 2, 2), ("down", 3, 1), ("down", 0, 2), ("flat", 2, 1), ("flat", 2, 2)], "e string, stage int, ts int")
    assert {x.e: x.is_chain for x in windows.rising_stages(df, ["e"], "stage", "ts").collect()} == {"up": True, "down": False, "flat": False}


def test_finding_policy_and_enrichment(spark):
    c = spark.createDataFrame([("a", "threat_intel", "c2", 3, 0.2), ("b", "beacon", "c2", 7, 0.5), ("c", "dga_domain", "c2", 5, 0.5), ("d", "internal_scan", "discovery", 6, 0.5)], "finding_id string, detector_id string, category string, severity int, confidence double")
    f = findings.build(c).withColumn("evidence_refs", F.array(F.lit("r0")))
    assert {x.finding_id: x.state for x in f.collect()} == {"a": "FINAL", "b": "CAPTURE_REQUESTED", "c": "SUPPRESSED", "d": "FINAL"}
    r = spark.createDataFrame([("b", ["r1", "r0"])], "finding_id string, refs array<string>")
    got = {x.finding_id: (x.state, x.revision, x.evidence_refs) for x in findings.apply_enrichment(f, r).collect()}
    assert got["b"] == ("FINAL", 2, ["r0", "r1"]) and got["c"] == ("SUPPRESSED", 1, ["r0"])


def test_intel_provenance(spark):
    data = [("i", "s1", "f", 1, 50.0, 0.9, "green", 100), ("i", "s1", "f", 2, 60.0, 0.9, "green", 10), ("i", "s2", "f", 1, 40.0, 0.5, "red", 500)]
    df = spark.createDataFrame(data, "ind string, source string, feed string, o int, score double, trust double, tlp string, expiry int").withColumn("first_seen", F.lit(0)).withColumn("last_seen", F.lit(1))
    said = intel.assertions(df, ["ind"], "o")
    assert said.count() == 2
    x = intel.effective(said, ["ind"], F.lit(50)).first()
    assert (x.source, x.score, x.tlp, x.disposition, x.expiry) == ("s2", 40.0, "red", "active", 500)
    assert intel.exportable(intel.effective(said, ["ind"], F.lit(50))).count() == 0
    gone = said.filter("source = 's2'").select("ind", "source", "feed")
    assert intel.effective(intel.revoke(said, gone, ["ind"]), ["ind"], F.lit(50)).first().disposition == "expired"
    assert intel.revoke(said, said, ["ind"]).count() == 0


def test_intel_match_exact_and_by_network(spark):
    seen = spark.createDataFrame([("t", "ip", "src_ip", "10.1.2.3"), ("t", "domain", "tls.sni", "EVIL.com"), ("u", "domain", "tls.sni", "evil.com"), ("t", "ip", "dest_ip", "8.8.8.8")], "tenant string, kind string, field string, value string")
    known = spark.createDataFrame([("t", "ip", "10.1.0.0/16", "active"), ("t", "ip", "10.1.2.3", "active"), ("t", "domain", "evil.com", "active"), ("t", "ip", "8.8.8.8", "expired")], "tenant string, kind string, indicator string, disposition string")
    got = rows(intel.match(seen, known).select("tenant", "value", "indicator"), "value", "indicator")
    assert got == [("t", "10.1.2.3", "10.1.0.0/16"), ("t", "10.1.2.3", "10.1.2.3"), ("t", "EVIL.com", "evil.com")]


def test_assets(spark):
    ev = spark.createDataFrame([("t", "mac:aa", "10.0.0.1", "AA", "h", "dhcp", at(0)), ("t", "mac:aa", "10.0.0.2", "aa", "", "arp", at(9))], "tenant string, asset_key string, ip string, mac string, hostname string, src string, ts timestamp")
    m = assets.merged(ev).first()
    assert (m.ip_set, m.mac_set, m.hostname_set, m.confidence) == (["10.0.0.1", "10.0.0.2"], ["aa"], ["h"], 0.7)
    f = spark.createDataFrame([("t", "10.0.0.2"), ("t", "10.9.9.9")], "tenant string, src_ip string")
    assert rows(assets.entity_of(f, assets.merged(ev)).select("entity"), "entity") == [("ip:10.9.9.9",), ("mac:aa",)]


def test_episodes(spark):
    d = spark.createDataFrame([("d1", "t", ["a", "b"], 0.0, 10.0), ("d2", "t", ["a"], 0.0, 10.0), ("d3", "t", ["c"], 0.0, 1.0), ("d4", "t", ["q"], 0.0, 1.0)], "detection_id string, tenant string, entities array<string>, start double, end double")
    e = spark.createDataFrame([("e1", "t", ["a", "b"], 5.0, 20.0, "malicious"), ("e2", "t", ["a"], 50.0, 60.0, "malicious"), ("e3", "t", ["c"], 0.0, 9.0, "unknown"), ("e4", "t", [], 0.0, 9.0, "malicious")], "episode_id string, tenant string, required array<string>, start double, end double, label string")
    assert rows(scoring.match_episodes(d, e), "detection_id") == [("d1", "e1"), ("d3", "e3")]
    x = scoring.episode_scores(d, e).first()
    assert (x.episodes, x.found, x.tp, x.fp, x.ambiguous) == (3, 1, 1, 2, 1)


def _made_episodes(spark, seed):
    r = random.Random(seed)
    some = lambda least: [r.choice(["a", "b", "c", "d", "e", "f", None] if r.random() < 0.1 else "abcdef") for _ in range(r.randint(least, 4))]
    span = lambda: (None, 5.0) if r.random() < 0.05 else (float(t := r.randint(0, 400)), float(t + r.choice([0, 3, 40])))
    tenant = lambda: r.choice(["t", "t", "u", None])
    d = [(r.choice([None, *range(60)]), tenant(), None if r.random() < 0.05 else some(0), *span()) for _ in range(120)]
    e = [(r.choice([None, *range(30)]), tenant(), some(0)[:2], *span(), r.choice(["malicious", "benign", "unknown", None])) for _ in range(60)]
    types = "{} int, tenant string, {} array<string>, start double, end double"
    return d, e, spark.createDataFrame(d, types.format("detection_id", "entities")), spark.createDataFrame(e, types.format("episode_id", "required") + ", label string")


def _plain_pairs(d, e, tolerance):
    """Row numbers of pairs that match, by comparing all with all."""
    meet = lambda x, y: None not in (x[1], x[2], x[3], y[3], *y[2]) and y[2] and x[1] == y[1] and set(y[2]) <= set(x[2]) and x[3] <= y[4] + tolerance and x[4] >= y[3] - tolerance
    return [(i, j) for i, x in enumerate(d) for j, y in enumerate(e) if meet(x, y)]


@pytest.mark.parametrize("tolerance", [0.0, 7.0])
def test_episodes_match_as_all_pairs_do(spark, tolerance):
    d, e, detections, episodes = _made_episodes(spark, 5)
    pairs = _plain_pairs(d, e, tolerance)
    got = scoring.match_episodes(detections, episodes, tolerance, block=30.0)
    assert len(pairs) > 20 and sorted(map(tuple, got.collect()), key=repr) == sorted(((d[i][0], e[j][0]) for i, j in pairs), key=repr)
    # rows meet on the whole required set, not on one entity of it
    assert re.search(r"Join \[tenant#\w+, _req#\w+, _at#\w+\]", got._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("tolerance", [0.0, 7.0])
def test_episode_scores_are_those_of_all_pairs(spark, tolerance):
    d, e, detections, episodes = _made_episodes(spark, 8)
    pairs = _plain_pairs(d, e, tolerance)
    met = {e[j][0] for _, j in pairs} - {None}
    labels = {k: {e[j][5] for i, j in pairs if d[i][0] == k} for k in {x[0] for x in d}} | {None: set()}
    bad = [y for y in e if y[5] == "malicious"]
    true = {k for k, v in labels.items() if "malicious" in v}
    ambiguous = {k for k, v in labels.items() if "unknown" in v} - true
    got = scoring.episode_scores(detections, episodes, tolerance, block=30.0)
    x = got.first()
    assert (x.episodes, x.found, x.tp, x.fp, x.ambiguous) == (len(bad), sum(y[0] in met for y in bad), len(true), len(labels) - len(true) - len(ambiguous), len(ambiguous))
    assert x.found and x.tp and x.ambiguous
    # pairs are not built
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    nothing = scoring.episode_scores(detections, episodes.limit(0)).first()
    assert (nothing.episodes, nothing.found, nothing.tp, nothing.recall, nothing.precision) == (0, 0, 0, 0.0, 0.0)


def test_set_scores_of_nothing(spark):
    none = spark.createDataFrame([], "k string")
    assert tuple(scoring.set_scores(none, none, "k").first()) == (0, 0, 0, 0.0, 0.0, 0.0, None)


def test_pages_follow_a_cursor(spark):
    df = spark.createDataFrame([(at(i // 3), f"id{i:03}") for i in range(20)], "ts timestamp, id string")
    got, after = [], None
    while True:
        page = evidence.page_after(df, "ts", "id", after, 6).collect()
        got += [x.id for x in page[:6]]
        if len(page) <= 6:
            break
        after = (page[5].ts, page[5].id)
    assert got == [f"id{i:03}" for i in range(20)]
    for bad in ({"entity": "a b"}, {"file_hash": "zz"}, {"page": 0}, {"start": 0, "end": 90_000}):
        with pytest.raises(ValueError, match=" "):
            evidence.checked_request(**bad)


def test_deep_inspection_risks(spark):
    shapes = ['{"flow_risk":{"11":{"risk":"Possible Exploit","severity":"Severe","risk_score":{"total":50}}}}', '{"flow_risk":{"4":"Self-signed Certificate"}}', '{"flow_risk":{"Susp Entropy":true}}', '{"flow_risk":["A","B"]}', '{"flow_risk":"Malformed"}', "{}", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, n string")
    got = [[tuple(r) for r in x.r] for x in df.select("i", siem.parsed_risks(F.col("n")).alias("r")).orderBy("i").collect()]
    assert got[0] == [("11", "Possible Exploit", "Severe", 50)] and got[1][0][:2] == ("4", "Self-signed Certificate") and got[2][0][1] == "Susp Entropy"
    assert [r[1] for r in got[3]] == ["A", "B"] and got[4][0][1] == "Malformed" and got[5] == [] and got[6] == []
    out = {(x.i, x.category): x.severity for x in siem.risk_findings(df, ["i"], "n").collect()}
    assert out[0, "exploit"] == 7 and out[1, "observation"] == 2 and out[3, "unclassified"] == 1


def test_siem_forms(spark):
    f = spark.createDataFrame([("f|1", "det", "c2", 7, [("ip", "src", "10.0.0.1"), ("ip", "dst", "8.8.8.8"), ("domain", None, "x=y")])], "finding_id string, detector_id string, category string, severity int, entities array<struct<type:string,role:string,value:string>>")
    p = siem.pivots(f)
    assert tuple(p.select("src_ip", "dest_ip", "domain", "entity").first()) == ("10.0.0.1", "8.8.8.8", "x=y", "10.0.0.1")
    assert siem.cef(p).first().cef == "CEF:0|packetloom|analytics|1.0|det|c2|7|externalId=f|1 cat=c2 src=10.0.0.1 dst=8.8.8.8 dhost=x\\=y"
    assert siem.renamed(p, siem.ECS).columns[0] == "event.id"
