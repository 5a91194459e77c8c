"""Findings, intelligence, assets, evidence, scoring and SIEM operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, ip as ips, rules, stats, text
from ..operators import assets, evidence, findings, intel, joins, latest, novelty, scoring, siem, windows
from .catalog import query


def _secs(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


# --- joins -----------------------------------------------------------------------------------

@query("""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), d AS (SELECT user_id, ts AS at, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
 SELECT q.event_id, CASE WHEN epoch_us(q.ts) - epoch_us(d.at) <= 200000 * 1000000::BIGINT THEN d.v END AS v FROM q ASOF LEFT JOIN d ON q.user_id = d.user_id AND q.ts >= d.at""")
def asof_domain(t):
    e = t("events")
    left = e.filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = e.filter("event_id % 2 = 1").select("user_id", F.col("ts").alias("at"), F.col("value").alias("v"))
    return joins.asof_join(left, right, ["user_id"], "ts", "at", ["v"], within=200_000).select("event_id", "v")


@query("""WITH h AS (SELECT event_id, user_id, ts, 'www.h' || (event_id % 3) || '.org:80' AS host FROM events WHERE event_id % 2 = 0), s AS (SELECT user_id, ts AS at, 'H' || (event_id % 3) || '.org' AS sni, event_id AS sid FROM events WHERE event_id % 2 = 1),
 j AS (SELECT h.event_id, s.sni, row_number() OVER (PARTITION BY h.event_id ORDER BY s.at, s.sid) AS k FROM h JOIN s ON h.user_id = s.user_id AND s.at <= h.ts AND h.ts < s.at + INTERVAL 1 DAY
       WHERE lower(s.sni) <> regexp_replace(split_part(h.host, ':', 1), '^www\\.', ''))
 SELECT event_id, sni FROM j WHERE k = 1""")
def host_sni_mismatch(t):
    http = t("events").filter("event_id % 2 = 0").select("event_id", "user_id", "ts", F.concat(F.lit("www.h"), (F.col("event_id") % 3).cast("string"), F.lit(".org:80")).alias("host"))
    tls = t("events").filter("event_id % 2 = 1").select("user_id", F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("until"), F.concat(F.lit("H"), (F.col("event_id") % 3).cast("string"), F.lit(".org")).alias("sni"), F.col("event_id").alias("sid"))
    pair = joins.interval_join(http, tls, ["user_id"], "ts", "at", "until").filter(rules.host_sni_mismatch(F.col("sni"), F.col("host")))
    return pair.groupBy("event_id").agg(F.min_by("sni", F.struct("at", "sid")).alias("sni"))


_ADDR = "('10.' || (p_partkey % 4) || '.' || (p_size % 8) || '.' || (p_partkey % 200))"


@query(f"""WITH a AS (SELECT p_partkey, p_partkey % 4 AS b, p_size % 8 AS c FROM part), n AS (SELECT s_suppkey, s_suppkey % 4 AS b, s_nationkey % 8 AS c, CASE s_suppkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 21 END AS len FROM supplier)
 SELECT p_partkey, s_suppkey FROM a JOIN n ON a.b = n.b AND (n.len = 16 OR (n.len = 24 AND a.c = n.c) OR (n.len = 21 AND a.c // 8 = n.c // 8))""")
def cidr_match(t):
    a = t("part").select("p_partkey", F.expr(_ADDR).alias("ip"))
    net = F.expr("concat('10.', s_suppkey % 4, '.', s_nationkey % 8, '.0/', CASE s_suppkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 21 END)")
    n = t("supplier").select("s_suppkey", net.alias("net"))
    return joins.cidr_members(a, "p_partkey", "ip", n, "s_suppkey", "net")


_SPECIAL = "CASE n_nationkey % 10 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '203.0.113.9' WHEN 3 THEN '100.64.0.1' WHEN 4 THEN '239.1.1.1' WHEN 5 THEN 'fe80::1' WHEN 6 THEN '2600::1' WHEN 7 THEN 'fd00::2' WHEN 8 THEN '104.16.0.1' ELSE 'nonsense' END"


@query(f"""SELECT n_nationkey, m.e AS is_external, m.i AS is_internal, m.g AS is_global, m.n AS is_noise FROM (SELECT n_nationkey, {_SPECIAL} AS ip FROM nation) JOIN
 (VALUES ('10.1.2.3', false, true, false, false), ('8.8.8.8', true, false, true, false), ('203.0.113.9', true, true, false, false), ('100.64.0.1', true, false, false, false), ('239.1.1.1', false, false, true, true),
  ('fe80::1', false, true, false, false), ('2600::1', true, false, true, false), ('fd00::2', false, true, false, false), ('104.16.0.1', true, false, true, true), ('nonsense', true, false, false, false)) m(ip, e, i, g, n) USING (ip)""")
def ip_predicates(t):
    ip = F.col("ip")
    out = t("nation").select("n_nationkey", F.expr(_SPECIAL).alias("ip"))
    return out.select("n_nationkey", ips.is_external(ip).alias("is_external"), ips.is_internal(ip).alias("is_internal"), ips.is_global(ip).alias("is_global"), ips.is_beacon_noise(ip).alias("is_noise"))


@query("""WITH n AS (SELECT s_suppkey, 'f' || s_suppkey % 9 AS k FROM supplier) SELECT p_partkey, CASE WHEN p_partkey % 12 < 9 THEN 'ip' WHEN p_size % 30 < 9 THEN 'ja3' WHEN p_partkey % 50 < 9 THEN 'cert' END AS matched_on FROM part""")
def static_feed_match(t):
    p = t("part").select("p_partkey", F.concat(F.lit("F"), (F.col("p_partkey") % 12).cast("string")).alias("ip"), F.concat(F.lit("f"), (F.col("p_size") % 30).cast("string")).alias("ja3"), F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("cert"))
    feed = t("supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") % 9).cast("string")).alias("v"))
    return intel.static_match(p, "ip", "ja3", "cert", {"ip": feed, "ja3": feed, "cert": feed}).select("p_partkey", "matched_on")


@query("SELECT o_custkey, o_orderstatus FROM orders EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def tombstone_antijoin(t):
    o = t("orders")
    return joins.reconcile(o, o.filter("o_orderkey % 3 = 0"), ["o_custkey", "o_orderstatus"])


# --- latest versions and evidence -----------------------------------------------------------

@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max((o_orderdate, o_orderkey))[2] AS o_orderkey FROM orders GROUP BY ALL".replace("max((o_orderdate, o_orderkey))[2]", "arg_max(o_orderkey, (o_orderdate, o_orderkey))"))
def current_finding(t):
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return latest.current(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "status", "o_orderkey")


@query("""WITH f AS (SELECT user_id, event_type, epoch(date_trunc('day', ts))::BIGINT AS d, (event_id % 3 = 0)::INT AS gone, value FROM events), m AS (SELECT user_id, event_type, max((d, gone, value)) AS x FROM f GROUP BY ALL)
 SELECT user_id, event_type, x[1]::BIGINT AS version, x[3] AS value FROM m WHERE x[2] = 0""".replace("max((d, gone, value)) AS x", "max(struct_pack(d := d, g := gone, v := value)) AS x").replace("x[1]::BIGINT", "x.d").replace("x[3]", "x.v").replace("x[2]", "x.g"))
def live_facts(t):
    f = t("events").select("user_id", "event_type", F.unix_seconds(F.date_trunc("day", F.col("ts")).cast("timestamp")).alias("version"), (F.col("event_id") % 3 == 0).cast("int").alias("gone"), "value")
    return latest.live_facts(f, ["user_id", "event_type"], "version", "gone").drop("gone")


@query("SELECT DISTINCT o_orderstatus AS observation, o_custkey AS who FROM orders UNION SELECT DISTINCT l_returnflag, l_suppkey FROM lineitem")
def evidence_distinct(t):
    a = t("orders").select(F.col("o_orderstatus").alias("observation"), F.col("o_custkey").alias("who"))
    b = t("lineitem").select(F.col("l_returnflag").alias("observation"), F.col("l_suppkey").alias("who"))
    return latest.evidence_union(a, b, a)


@query("SELECT 'fact' AS kind, s_suppkey AS entity, s_name AS label, NULL::BIGINT AS size FROM supplier UNION ALL SELECT 'observation', l_suppkey, NULL, l_orderkey FROM lineitem WHERE l_linenumber = 7")
def timeline_union(t):
    fact = t("supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("label"))
    obs = t("lineitem").filter("l_linenumber = 7").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("size"))
    return evidence.timeline(fact=fact, observation=obs).select("kind", "entity", "label", "size")


@query("SELECT event_id, epoch_us(ts) AS at FROM events WHERE (ts, event_id) > ((SELECT ts FROM events WHERE event_id = 500), 500) ORDER BY ts, event_id LIMIT 101")
def keyset_page(t):
    e = t("events")
    at = e.filter("event_id = 500").select("ts").first()[0]
    return evidence.page_after(e, "ts", "event_id", (at, 500), 100).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("""WITH f AS (SELECT o_custkey AS finding_id, arg_max(struct_pack(s := o_orderstatus, a := epoch(o_orderdate)::BIGINT, p := o_orderpriority), (o_orderdate, o_orderkey)) AS x FROM orders GROUP BY ALL)
 SELECT finding_id, x.a AS first_seen FROM f WHERE x.p = '1-URGENT' AND x.a < 946684800 AND x.a + 86400 >= 852076800""")
def findings_of_entity(t):
    o = t("orders").select(F.col("o_custkey").alias("finding_id"), F.struct("o_orderdate", "o_orderkey").alias("revision"), _secs("o_orderdate").alias("first_seen"), F.array(F.struct(F.col("o_orderpriority").alias("value"))).alias("entities"))
    out = evidence.findings_of(o.withColumn("last_seen", F.col("first_seen") + 86400), ["finding_id"], ["revision"], "1-URGENT", F.lit(852076800), F.lit(946684800))
    return out.select("finding_id", "first_seen")


@query("""WITH c AS (SELECT 'T' || (1000 + n_nationkey) AS technique FROM nation WHERE n_nationkey < 18), d AS (SELECT 'T' || (1000 + p_size % 30) AS technique, count(DISTINCT p_brand) AS n FROM part WHERE p_size % 5 > 0 GROUP BY ALL),
 o AS (SELECT 'T' || (1000 + s_nationkey) AS technique, count(*) AS n FROM supplier WHERE s_suppkey % 4 > 0 GROUP BY ALL)
 SELECT technique, c.technique IS NOT NULL AS in_catalog, coalesce(d.n, 0) AS n_detectors, coalesce(o.n, 0) AS n_observed, c.technique IS NOT NULL AND coalesce(d.n, 0) = 0 AS gap
 FROM c FULL JOIN d USING (technique) FULL JOIN o USING (technique)""")
def attack_coverage(t):
    name = lambda c: F.concat(F.lit("T"), (1000 + c).cast("string"))
    c = t("nation").filter("n_nationkey < 18").select(name(F.col("n_nationkey")).alias("technique"))
    d = t("part").filter("p_size % 5 > 0").select(name(F.col("p_size") % 30).alias("technique"), F.col("p_brand").alias("detector_id"))
    o = t("supplier").select(F.when(F.col("s_suppkey") % 4 > 0, name(F.col("s_nationkey"))).otherwise("TA0010").alias("technique"))
    return evidence.attack_coverage(c, d, o)


@query("SELECT DISTINCT s AS id FROM (SELECT 'c' || o_custkey AS s FROM orders UNION ALL SELECT o_orderpriority FROM orders)")
def graph_nodes(t):
    e = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.col("o_orderpriority").alias("to"), F.lit("orders").alias("relation"), F.col("o_orderstatus").alias("label"))
    return evidence.graph(e)[0]


# --- assets ----------------------------------------------------------------------------------

_LEASES = """l AS (SELECT l_suppkey % 40 AS ip, l_returnflag AS mac, l_shipdate AS s, CASE WHEN l_linenumber % 4 > 0 THEN l_shipdate + to_days(l_quantity::INT) END AS x, l_orderkey * 10 + l_linenumber AS obs FROM lineitem)"""
_OWNED = f"""WITH {_LEASES}, w AS (SELECT ip, s, arg_min(mac, (obs, mac)) AS mac, arg_min(struct_pack(x := x), (obs, mac)) AS e FROM l GROUP BY ALL),
 i AS (SELECT ip, mac, s, CASE WHEN e.x IS NULL THEN lead(s) OVER o WHEN lead(s) OVER o IS NULL THEN e.x ELSE least(lead(s) OVER o, e.x) END AS u FROM w WINDOW o AS (PARTITION BY ip ORDER BY s)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY s) AS part FROM (SELECT *, CASE WHEN lag(mac) OVER o = mac AND lag(u) OVER o = s THEN 0 ELSE 1 END AS fresh FROM i WINDOW o AS (PARTITION BY ip ORDER BY s))),
 owned AS (SELECT ip, mac, min(s) AS s, CASE WHEN bool_or(u IS NULL) THEN NULL ELSE max(u) END AS u FROM g GROUP BY ip, mac, part)"""


def _leases(t):
    rows = t("lineitem")
    end = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int")))
    return rows.select((F.col("l_suppkey") % 40).alias("ip"), F.col("l_returnflag").alias("mac"), F.col("l_shipdate").alias("start"), end.alias("expires"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"))


@query(_OWNED + " SELECT ip, mac, epoch(s)::BIGINT AS valid_from, epoch(u)::BIGINT AS valid_to FROM owned")
def ip_ownership(t):
    out = windows.ownership_intervals(_leases(t), ["ip"], "mac", "start", "expires", ["obs_id"])
    return out.select("ip", "mac", _secs("valid_from").alias("valid_from"), _secs("valid_to").alias("valid_to"))


@query(_OWNED + " SELECT o_orderkey, (SELECT min(mac) FROM owned WHERE ip = o_custkey % 40 AND s <= o_orderdate AND (u IS NULL OR o_orderdate < u)) AS mac FROM orders")
def owner_at_instant(t):
    owned = windows.ownership_intervals(_leases(t), ["ip"], "mac", "start", "expires", ["obs_id"])
    asks = t("orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("ip"), F.col("o_orderdate").alias("ts"))
    return windows.owner_at(asks, owned, ["ip"], "ts", "mac").select("o_orderkey", "mac")


@query("""WITH f AS (SELECT l_suppkey % 30 AS k, l_shipdate AS ts, arg_min(struct_pack(v := l_returnflag, x := CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate + to_days(l_quantity::INT) END), (l_linenumber, l_orderkey, l_returnflag)) AS b FROM lineitem GROUP BY ALL),
 r AS (SELECT k, ts, b.v AS v, b.x AS x FROM f), n AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS nw FROM r WINDOW w AS (PARTITION BY k ORDER BY ts)),
 u AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY ts) AS run, lead(ts) OVER (PARTITION BY k ORDER BY ts) AS nx FROM n),
 p AS (SELECT *, CASE WHEN lag(ts) OVER w IS NOT NULL AND ts >= max(x) OVER (PARTITION BY k, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM u WINDOW w AS (PARTITION BY k, run ORDER BY ts)),
 q AS (SELECT *, sum(gap) OVER (PARTITION BY k, run ORDER BY ts) AS part FROM p),
 o AS (SELECT k, v, run, part, min(ts) AS s, max(x) AS l, arg_max(struct_pack(n := nx), ts) AS a, count(*) AS n FROM q GROUP BY ALL)
 SELECT k, v, epoch(s)::BIGINT AS valid_from, epoch(CASE WHEN l IS NULL THEN a.n WHEN a.n IS NULL THEN l ELSE least(l, a.n) END)::BIGINT AS valid_to, n FROM o""")
def fact_intervals(t):
    rows = t("lineitem")
    end = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int")))
    f = rows.select((F.col("l_suppkey") % 30).alias("k"), F.col("l_returnflag").alias("v"), F.col("l_shipdate").alias("ts"), end.alias("x"), "l_linenumber", "l_orderkey", "l_returnflag")
    out = windows.fact_intervals(f, ["k"], "v", "ts", "x", [F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_returnflag")])
    return out.select("k", "v", _secs("valid_from").alias("valid_from"), _secs("valid_to").alias("valid_to"), "n")


@query("""SELECT o_custkey % 100 AS asset, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS ips, epoch(min(o_orderdate))::BIGINT AS first_seen, epoch(max(o_orderdate))::BIGINT AS last_seen,
 least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * count(DISTINCT o_orderstatus)) AS confidence FROM orders GROUP BY ALL""")
def asset_merge(t):
    e = t("orders").select(F.lit("t").alias("tenant"), (F.col("o_custkey") % 100).alias("asset_key"), F.col("o_orderpriority").alias("ip"), F.lit("").alias("mac"), F.lit("h").alias("hostname"), F.col("o_orderstatus").alias("src"), F.col("o_orderdate").alias("ts"))
    out = assets.merged(e)
    return out.select(F.col("asset_key").alias("asset"), F.array_join("ip_set", ",").alias("ips"), _secs("first_seen").alias("first_seen"), _secs("last_seen").alias("last_seen"), F.col("confidence").cast("double").alias("confidence"))


@query("SELECT l_suppkey, l_partkey % 10 AS dst, epoch(min(l_shipdate))::BIGINT AS first_seen, epoch(max(l_shipdate))::BIGINT AS last_seen, count(*) AS n, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS evidence FROM lineitem GROUP BY ALL")
def relation_edges(t):
    out = assets.relations(t("lineitem").withColumn("dst", F.col("l_partkey") % 10), ["l_suppkey", "dst"], "l_shipdate", "l_orderkey")
    return out.select("l_suppkey", "dst", _secs("first_seen").alias("first_seen"), _secs("last_seen").alias("last_seen"), "n", "evidence")


@query("SELECT o_orderkey, coalesce('asset' || (SELECT min(c_custkey) FROM customer WHERE c_custkey % 500 = o_custkey % 700), 'ip:' || (o_custkey % 700)) AS entity FROM orders".replace("'asset' || (SELECT min(c_custkey)", "(SELECT min('asset' || c_custkey)"))
def finding_entity(t):
    f = t("orders").select("o_orderkey", F.lit("t").alias("tenant"), (F.col("o_custkey") % 700).cast("string").alias("src_ip"))
    a = t("customer").select(F.lit("t").alias("tenant"), F.concat(F.lit("asset"), F.col("c_custkey").cast("string")).alias("asset_key"), F.array((F.col("c_custkey") % 500).cast("string")).alias("ip_set"))
    return assets.entity_of(f, a).select("o_orderkey", "entity")


# --- findings --------------------------------------------------------------------------------

_FINDINGS = """f AS (SELECT event_id AS finding_id, user_id, CASE event_id % 8 WHEN 0 THEN 'beacon' WHEN 1 THEN 'strobe' WHEN 2 THEN 'slips_ml' WHEN 3 THEN 'ids_signature' WHEN 4 THEN 'exfil' WHEN 5 THEN 'dga_domain' WHEN 6 THEN 'rare_destination' ELSE 'internal_scan' END AS detector_id,
 CASE event_id % 5 WHEN 0 THEN 'c2' WHEN 1 THEN 'recon' WHEN 2 THEN 'exfil' WHEN 3 THEN 'lateral' ELSE 'other' END AS category, (1 + event_id % 10)::INT AS severity, (event_id % 11) / 10.0 AS confidence, ts FROM events)"""
_END = "1706745600"


def _findings(t):
    body = _FINDINGS.split("AS (", 1)[1].rsplit(")", 1)[0].replace("::INT AS severity", " AS severity").replace("(1 + event_id % 10)", "CAST(1 + event_id % 10 AS INT)").replace("/ 10.0 AS confidence", "/ 10.0D AS confidence")
    select = body[len("SELECT ") : body.index(" FROM events")]
    parts = ["event_id AS finding_id", "user_id", select[select.index("CASE event_id % 8") : select.index("AS detector_id")] + "AS detector_id",
             select[select.index("CASE event_id % 5") : select.index("AS category")] + "AS category", "CAST(1 + event_id % 10 AS INT) AS severity", "(event_id % 11) / 10.0D AS confidence", "ts"]
    return t("events").selectExpr(*parts)


_RISK = f"""s AS (SELECT user_id, detector_id, max(struct_pack(s := severity, t := ts)) AS b FROM f GROUP BY ALL),
 p AS (SELECT user_id, CASE detector_id WHEN 'beacon' THEN 'temporal' WHEN 'strobe' THEN 'temporal' WHEN 'exfil' THEN 'volume' WHEN 'dga_domain' THEN 'dns' WHEN 'rare_destination' THEN 'destination' WHEN 'ids_signature' THEN 'signature' ELSE detector_id END AS family,
   sum(b.s * pow(0.5, greatest(0.0, {_END} - epoch_us(b.t) / 1e6) / 864000.0)) AS raw FROM s GROUP BY ALL),
 k AS (SELECT user_id, round(sum(least(raw, CASE family WHEN 'temporal' THEN 10.0 WHEN 'volume' THEN 5.0 WHEN 'dns' THEN 6.67 WHEN 'destination' THEN 5.0 WHEN 'signature' THEN 10.0 ELSE 100.0 END)), 3) AS risk FROM p GROUP BY ALL)"""


@query(f"WITH {_FINDINGS}, {_RISK} SELECT user_id, risk FROM k")
def entity_risk(t):
    return findings.entity_risk(_findings(t), ["user_id"], F.timestamp_seconds(F.lit(int(_END))), 864_000.0)


_STAGES = """g AS (SELECT *, CASE category WHEN 'recon' THEN 0 WHEN 'c2' THEN 2 WHEN 'lateral' THEN 3 WHEN 'exfil' THEN 4 END AS stage FROM f),
 m AS (SELECT *, max(stage) OVER (PARTITION BY user_id ORDER BY ts, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM g WHERE stage IS NOT NULL),
 c AS (SELECT user_id, count(*) FILTER (peak IS NULL OR stage > peak) AS n_rises, count(DISTINCT stage) AS n_stages FROM m GROUP BY ALL)"""


@query(f"WITH {_FINDINGS}, {_STAGES} SELECT user_id, n_rises, n_stages, n_rises >= 2 AND n_stages >= 2 AS is_chain FROM c")
def kill_chain(t):
    f = _findings(t).withColumn("stage", rules.lookup(findings.STAGES, F.col("category")))
    return windows.rising_stages(f, ["user_id"], "stage", "ts")


@query(f"""WITH {_FINDINGS}, {_RISK}, {_STAGES}, b AS (SELECT user_id, count(*) AS n, count(DISTINCT stage) AS d, max(severity) AS most FROM g GROUP BY ALL),
 j AS (SELECT b.*, k.risk, coalesce(c.n_rises >= 2 AND c.n_stages >= 2, false) AS chain FROM b JOIN k USING (user_id) LEFT JOIN c USING (user_id)),
 r AS (SELECT *, CASE WHEN chain AND d >= 3 THEN 'kill-chain' WHEN d >= 3 AND n >= 2 THEN 'multi-tactic' WHEN risk >= 12 THEN 'risk-threshold' END AS reason FROM j)
 SELECT user_id, n AS n_findings, risk, reason, greatest(1, least(10, most + CASE WHEN chain THEN 2 ELSE 1 END))::INT AS severity FROM r WHERE reason IS NOT NULL""")
def incidents(t):
    out = findings.incidents(_findings(t), ["user_id"], F.timestamp_seconds(F.lit(int(_END))), min_tactics=3, half_life=864_000.0)
    return out.select("user_id", "n_findings", "risk", "reason", "severity")


@query(f"""WITH {_FINDINGS} SELECT user_id, category, array_to_string(list_sort(list(DISTINCT detector_id)), ',') AS detectors, least(10, max(severity) + 2)::INT AS severity FROM f GROUP BY ALL
 HAVING bool_or(detector_id = 'slips_ml') AND bool_or(detector_id <> 'slips_ml')""")
def corroboration(t):
    return findings.corroborations(_findings(t), ["user_id"]).withColumn("detectors", F.array_join("detectors", ","))


@query(f"""WITH {_FINDINGS} SELECT finding_id, CASE WHEN detector_id = 'ids_signature' THEN 'packets_needed' WHEN category IN ('recon', 'lateral') OR confidence >= 0.9 THEN 'metadata_sufficient' ELSE 'packets_needed' END AS enrichment_state,
 detector_id <> 'ids_signature' AND severity <= 5 AS suppressed, CASE category WHEN 'c2' THEN 'T1071' WHEN 'recon' THEN 'T1046' WHEN 'exfil' THEN 'TA0010' WHEN 'lateral' THEN 'T1021' ELSE '' END AS mitre FROM f""")
def finding_policy(t):
    out = findings.build(_findings(t))
    return out.select("finding_id", "enrichment_state", findings.is_suppressed(F.col("detector_id"), F.col("severity")).alias("suppressed"), F.array_join("mitre", ",").alias("mitre"))


@query(f"""WITH {_FINDINGS}, b AS (SELECT *, epoch_us(ts) // 864000000000 AS bucket FROM f) SELECT user_id, detector_id, bucket, arg_min(finding_id, (ts, category, confidence, finding_id)) AS finding_id FROM b GROUP BY ALL""")
def emit_once(t):
    from ..operators.counts import emit_once as once

    f = _findings(t).withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 864_000_000_000).cast("long")).withColumnRenamed("ts", "first_seen")
    return once(f.select("user_id", "detector_id", "bucket", "first_seen", "category", "confidence", "finding_id"), ["user_id", "detector_id"], "bucket").select("user_id", "detector_id", "bucket", "finding_id")


@query("SELECT n_nationkey, 'x-' || (('0x' || substr(sha1(n_name || '|' || coalesce(CASE WHEN n_regionkey > 1 THEN n_regionkey END::VARCHAR, '')), 1, 15))::BIGINT % 10000000000) AS id FROM nation".replace("END::VARCHAR", "::VARCHAR END").replace("THEN n_regionkey ::VARCHAR END", "THEN n_regionkey::VARCHAR END"))
def finding_ids(t):
    return t("nation").select("n_nationkey", ids.finding_id("x", F.col("n_name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))).alias("id"))


@query("SELECT o_custkey, sha256(string_agg(o_orderpriority, chr(10) ORDER BY o_orderpriority)) AS digest FROM orders GROUP BY ALL")
def multiset_digest(t):
    return t("orders").groupBy("o_custkey").agg(ids.set_digest(F.collect_list("o_orderpriority")).alias("digest"))


# --- intelligence ----------------------------------------------------------------------------

_SAID = """a AS (SELECT l_partkey AS ind, l_returnflag AS source, l_linestatus AS feed, (l_orderkey, l_linenumber) AS o, (l_quantity * 2)::DOUBLE AS score, l_tax AS trust,
  CASE l_linenumber % 6 WHEN 0 THEN 'clear' WHEN 1 THEN 'green' WHEN 2 THEN 'amber' WHEN 3 THEN 'amber+strict' WHEN 4 THEN 'red' END AS tlp, l_shipdate AS fs, l_shipdate + to_days(l_quantity::INT * 20) AS x FROM lineitem),
 s AS (SELECT ind, source, feed, arg_max(struct_pack(score := score, trust := trust, tlp := tlp, fs := fs, x := x), o) AS b FROM a GROUP BY ALL)"""


def _said(t):
    tlp = F.expr("CASE l_linenumber % 6 WHEN 0 THEN 'clear' WHEN 1 THEN 'green' WHEN 2 THEN 'amber' WHEN 3 THEN 'amber+strict' WHEN 4 THEN 'red' END")
    rows = t("lineitem").select(
        F.col("l_partkey").alias("ind"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("feed"), F.struct("l_orderkey", "l_linenumber").alias("o"), (F.col("l_quantity") * 2).alias("score"),
        F.col("l_tax").alias("trust"), tlp.alias("tlp"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"),
        (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int") * 20)).alias("expiry"),
    )
    return intel.assertions(rows, ["ind"], "o")


@query(f"""WITH {_SAID}, g AS (SELECT ind, max(struct_pack(v := b.x > TIMESTAMP '2000-01-01', t := b.trust, s := b.score, o := source, f := feed)) AS w, max(b.x) AS x, max(CASE b.tlp WHEN 'clear' THEN 0 WHEN 'green' THEN 1 WHEN 'amber' THEN 2 WHEN 'amber+strict' THEN 3 WHEN 'red' THEN 4 END) AS k, min(b.fs) AS fs, max(b.fs) AS ls, count(*) AS n FROM s GROUP BY ALL)
 SELECT ind, w.o AS source, w.f AS feed, w.s AS score, w.t AS trust, epoch(x)::BIGINT AS expiry, ['clear', 'green', 'amber', 'amber+strict', 'red'][k + 1] AS tlp, epoch(fs)::BIGINT AS first_seen, epoch(ls)::BIGINT AS last_seen, n AS n_sources, CASE WHEN w.v THEN 'active' ELSE 'expired' END AS disposition FROM g""")
def intel_derive(t):
    out = intel.effective(_said(t), ["ind"], F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.withColumns({c: _secs(c) for c in ("expiry", "first_seen", "last_seen")})


@query(f"WITH {_SAID} SELECT ind, source, feed, b.score AS score FROM s WHERE NOT (ind % 3 = 0 AND source = 'N')")
def intel_revoke(t):
    said = _said(t)
    gone = said.filter("ind % 3 = 0 AND source = 'N'").select("ind", "source", "feed")
    return intel.revoke(said, gone, ["ind"]).select("ind", "source", "feed", "score")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT s_suppkey * 5 AS ps, s_acctbal AS e FROM supplier) WHERE e > 1000)")
def suppression_antijoin(t):
    s = t("supplier").select((F.col("s_suppkey") * 5).alias("p_partkey"), F.col("s_acctbal").alias("expires_at"))
    return intel.unsuppressed(t("part").select("p_partkey"), s, ["p_partkey"], F.lit(1000.0))


# --- quality ---------------------------------------------------------------------------------

@query("""WITH d AS (SELECT doc_id AS finding_id, CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 1 THEN 'false_positive' ELSE 'other' END AS v FROM labels), f AS (SELECT doc_id AS finding_id, source FROM documents),
 g AS (SELECT f.source AS detector_id, count(*) FILTER (v = 'true_positive') AS tp, count(*) FILTER (v = 'false_positive') AS fp, count(*) AS n FROM d LEFT JOIN f USING (finding_id) GROUP BY ALL),
 w AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, (tp + fp)::DOUBLE AS m, 1.959963984540054 AS z FROM g)
 SELECT detector_id, tp, fp, n, round(p, 6) AS rate, round(greatest(0.0, (p + z * z / (2 * m)) / (1 + z * z / m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)), 6) AS low,
  round(least(1.0, (p + z * z / (2 * m)) / (1 + z * z / m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)), 6) AS high, tp + fp < 30 AS low_confidence FROM w""")
def detector_quality(t):
    d = t("labels").select(F.col("doc_id").alias("finding_id"), F.when(F.col("toxic") == 1, "true_positive").when(F.col("quality") == 1, "false_positive").otherwise("other").alias("verdict"))
    f = t("documents").select(F.col("doc_id").alias("finding_id"), F.col("source").alias("detector_id"), F.lit(1).alias("revision"), F.lit(0).alias("ingested_at"))
    out = scoring.detector_quality(d, f)
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "low", "high")})


@query("""WITH r AS (SELECT 'src' || n_nationkey AS detector_id, n_regionkey AS manifest_ref FROM nation), q AS (SELECT source AS detector_id, count(*) / 1000.0 AS rate FROM documents WHERE lang = 'en' GROUP BY ALL)
 SELECT r.detector_id, r_name AS title, CASE WHEN q.rate IS NULL THEN 'insufficient dispositions' ELSE 'measured' END AS status FROM r LEFT JOIN region ON r_regionkey = manifest_ref AND r_regionkey > 1 LEFT JOIN q USING (detector_id)""")
def scoreboard(t):
    r = t("nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("detector_id"), F.col("n_regionkey").alias("manifest_ref"))
    m = t("region").filter("r_regionkey > 1").select(F.col("r_regionkey").alias("manifest_ref"), F.col("r_name").alias("title"))
    q = t("documents").filter("lang = 'en'").groupBy(F.col("source").alias("detector_id")).agg((F.count(F.lit(1)) / 1000.0).alias("rate"))
    return scoring.scoreboard(r, m, q).select("detector_id", "title", "status")


@query("""WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|stupid|trash')), tr AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
 c AS (SELECT count(*) FILTER (f.doc_id IS NOT NULL AND tr.doc_id IS NOT NULL) AS tp, count(*) FILTER (tr.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN tr USING (doc_id)),
 p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall FROM c)
 SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0), 9) AS f1, round(CASE WHEN tp > 0 THEN (tp + fp) / tp::DOUBLE END, 9) AS alerts_per_tp FROM p""")
def set_prf1(t):
    flagged = t("documents").filter(F.lower("text").rlike("idiot|stupid|trash")).select("doc_id")
    out = scoring.set_scores(flagged, t("labels").filter("toxic = 1"), "doc_id")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "alerts_per_tp")})


_EPISODES = """e AS (SELECT o_orderkey AS episode_id, o_custkey % 3 AS tenant, ['u' || o_custkey % 50, 'k' || o_orderkey % 6] AS required, epoch(o_orderdate) AS s, epoch(o_orderdate) + 86400 * 30 AS x, CASE o_orderkey % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'unknown' ELSE 'malicious' END AS label FROM orders),
 d AS (SELECT l_orderkey * 10 + l_linenumber AS detection_id, l_suppkey % 3 AS tenant, ['u' || l_suppkey % 50, 'k' || l_partkey % 6, 'z'] AS entities, epoch(l_shipdate) AS s, epoch(l_shipdate) + 3600 AS x FROM lineitem),
 m AS (SELECT d.detection_id, e.episode_id, e.label FROM d JOIN e ON d.tenant = e.tenant AND d.entities[1] = e.required[1] AND d.entities[2] = e.required[2] AND d.s <= e.x AND d.x >= e.s)"""


def _episodes(t):
    o = t("orders")
    label = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'unknown' ELSE 'malicious' END")
    e = o.select(F.col("o_orderkey").alias("episode_id"), (F.col("o_custkey") % 3).alias("tenant"), F.expr("array(concat('u', o_custkey % 50), concat('k', o_orderkey % 6))").alias("required"), _secs("o_orderdate").cast("double").alias("start"), (_secs("o_orderdate") + 86400 * 30).cast("double").alias("end"), label.alias("label"))
    li = t("lineitem")
    d = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detection_id"), (F.col("l_suppkey") % 3).alias("tenant"), F.expr("array(concat('u', l_suppkey % 50), concat('k', l_partkey % 6), 'z')").alias("entities"), _secs("l_shipdate").cast("double").alias("start"), (_secs("l_shipdate") + 3600).cast("double").alias("end"))
    return d, e


@query(f"WITH {_EPISODES} SELECT detection_id, episode_id FROM m")
def episode_match(t):
    return scoring.match_episodes(*_episodes(t))


@query(f"""WITH {_EPISODES}, r AS (SELECT count(*) AS episodes, count(*) FILTER (episode_id IN (SELECT episode_id FROM m)) AS found FROM e WHERE label = 'malicious'),
 q AS (SELECT detection_id, bool_or(label = 'malicious') AS t, bool_or(label = 'unknown') AS u FROM m GROUP BY ALL),
 p AS (SELECT count(*) FILTER (coalesce(t, false)) AS tp, count(*) FILTER (NOT coalesce(t, false) AND NOT coalesce(u, false)) AS fp, count(*) FILTER (NOT coalesce(t, false) AND coalesce(u, false)) AS ambiguous FROM (SELECT DISTINCT detection_id FROM d) LEFT JOIN q USING (detection_id))
 SELECT episodes, found, tp, fp, ambiguous, coalesce(found / nullif(episodes, 0)::DOUBLE, 0.0) AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision FROM r, p""")
def episode_score(t):
    return scoring.episode_scores(*_episodes(t))


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey % 5 AS revision, o_orderstatus AS digest FROM orders), m AS (SELECT *, max(revision) OVER (PARTITION BY id) AS top FROM r)
 SELECT id, revision, count(DISTINCT digest) AS n_contents, min(digest) AS digest, count(DISTINCT digest) > 1 AS conflict FROM m WHERE revision = top GROUP BY ALL""")
def revision_selection(t):
    r = t("orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5).alias("revision"), F.col("o_orderstatus").alias("digest"))
    return scoring.select_revisions(r, ["id"])


@query("""WITH o AS (SELECT l_returnflag AS destination, l_suppkey AS obligation, bool_or(l_quantity > 49) AS met FROM lineitem GROUP BY ALL)
 SELECT destination, count(*) AS obligations, count(*) FILTER (met) AS met, bool_and(met) AS complete FROM o GROUP BY ALL""")
def ledger(t):
    r = t("lineitem").select(F.col("l_returnflag").alias("destination"), F.col("l_suppkey").alias("obligation"), (F.col("l_quantity") > 49).alias("met"))
    return scoring.ledger_disposition(r)


# --- SIEM ------------------------------------------------------------------------------------

@query(f"WITH {_FINDINGS} SELECT category, count(*) AS n, array_to_string(list_sort(list(DISTINCT detector_id)), ',') AS members FROM f GROUP BY ALL")
def siem_stats(t):
    return siem.stats_by(_findings(t), ["category"], "detector_id").withColumn("members", F.array_join("members", ","))


@query(f"""WITH {_FINDINGS} SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, count(*) FILTER (category = 'c2') AS c2, count(*) FILTER (category = 'recon') AS recon, count(*) FILTER (category = 'exfil') AS exfil FROM f GROUP BY ALL""")
def siem_timechart(t):
    out = siem.timechart(_findings(t), "ts", "1 day", "category", ["c2", "recon", "exfil"])
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query(f"WITH {_FINDINGS} SELECT category, detector_id, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 3")
def siem_threshold(t):
    out = siem.threshold(_findings(t), ["category", "detector_id"], "ts", "1 day", 3)
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query(f"""WITH {_FINDINGS} SELECT finding_id, 'CEF:0|packetloom|analytics|1.0|' || detector_id || '|' || category || '|' || severity || '|externalId=' || finding_id || ' cat=' || category AS cef FROM f""")
def cef_lines(t):
    return siem.cef(_findings(t).withColumn("finding_id", F.col("finding_id").cast("string"))).select(F.col("finding_id").cast("long").alias("finding_id"), "cef")


@query(f"""WITH {_FINDINGS} SELECT finding_id, array_to_string(list_filter([CASE WHEN category IN ('c2', 'exfil') AND severity >= 7 THEN 'block_destination' END, CASE WHEN category = 'lateral' AND severity >= 7 THEN 'isolate_host' END,
 CASE WHEN severity >= 9 THEN 'page_on_call' END, 'open_ticket'], lambda x: x IS NOT NULL), ',') AS actions, CASE WHEN severity >= 9 THEN 1 WHEN severity >= 7 THEN 2 WHEN severity >= 5 THEN 3 ELSE 4 END::INT AS priority FROM f""")
def response_actions(t):
    return siem.actions(_findings(t)).select("finding_id", F.array_join("actions", ",").alias("actions"), "priority")


_NOTE = "CASE n_nationkey % 7 WHEN 0 THEN 'SSL::Weak_Key' WHEN 1 THEN 'CaptureLoss::Too_Much_Loss' WHEN 2 THEN 'Scan::Other' WHEN 3 THEN 'Kerberos::X' WHEN 4 THEN 'Unknown::Y' WHEN 5 THEN 'Intel::Notice' ELSE 'Software' END"


@query(f"""WITH n AS (SELECT n_nationkey, {_NOTE} AS note FROM nation) SELECT n_nationkey, note, CASE note WHEN 'SSL::Weak_Key' THEN 'c2' WHEN 'Scan::Other' THEN 'recon' WHEN 'Kerberos::X' THEN 'credential_access' WHEN 'Intel::Notice' THEN 'c2' ELSE 'malware' END AS category,
 CASE note WHEN 'SSL::Weak_Key' THEN 5 WHEN 'Scan::Other' THEN 5 WHEN 'Kerberos::X' THEN 6 WHEN 'Intel::Notice' THEN 8 ELSE 6 END::INT AS severity FROM n WHERE NOT regexp_matches(note, '^(CaptureLoss|PacketFilter|Software)(::|$)')""")
def zeek_notices(t):
    return siem.notices(t("nation").select("n_nationkey", F.expr(_NOTE).alias("note")), "note")


_SIG = "CASE o_orderkey % 5 WHEN 0 THEN 'ET INFO x' WHEN 1 THEN 'SURICATA STREAM y' WHEN 2 THEN 'ET MALWARE z' ELSE 'GPL ATTACK' END"


@query(f"""WITH a AS (SELECT o_orderkey, {_SIG} AS s, o_orderkey % 4 AS sev, CASE WHEN o_orderkey % 6 = 0 THEN '["Major"]' END AS m, CASE o_orderstatus WHEN 'F' THEN ' Misc Attack ' WHEN 'O' THEN 'Exfiltration' ELSE 'zzz' END AS c FROM orders)
 SELECT o_orderkey, CASE trim(lower(c)) WHEN 'misc attack' THEN 'c2' WHEN 'exfiltration' THEN 'exfil' ELSE 'anomaly' END AS category FROM a WHERE NOT regexp_matches(s, '^(ET INFO|SURICATA STREAM)') AND (sev <= 2 OR coalesce(contains(lower(m), 'major'), false))""")
def ids_alerts(t):
    c = F.expr("CASE o_orderstatus WHEN 'F' THEN ' Misc Attack ' WHEN 'O' THEN 'Exfiltration' ELSE 'zzz' END")
    hit = rules.is_threat_alert(F.expr(_SIG), (F.col("o_orderkey") % 4).cast("string"), F.when(F.col("o_orderkey") % 6 == 0, '["Major"]'))
    return t("orders").filter(hit).select("o_orderkey", rules.alert_category(c).alias("category"))


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN 'a' || p_partkey END AS attacker, CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'critical' WHEN 2 THEN 'bogus' END AS tl, CASE p_partkey % 3 WHEN 0 THEN 'Recon.Scanning' WHEN 1 THEN 'Malware' ELSE 'Odd' END AS k,
  CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'NaN' WHEN 2 THEN '0.4' END AS c, CASE p_size % 3 WHEN 0 THEN 'RNN_CC' WHEN 1 THEN 'threatintel feed' ELSE '' END AS m FROM part)
 SELECT p_partkey, CASE m WHEN 'RNN_CC' THEN 'slips_ml' WHEN 'threatintel feed' THEN 'slips_intel' ELSE 'slips_alert' END AS detector_id, CASE k WHEN 'Recon.Scanning' THEN 'recon' WHEN 'Malware' THEN 'c2' ELSE 'anomaly' END AS category,
  CASE tl WHEN 'HIGH' THEN 8 WHEN 'critical' THEN 9 ELSE 3 END::INT AS severity, CASE c WHEN '0' THEN 0.0 WHEN '0.4' THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM a WHERE attacker IS NOT NULL""")
def slips_alerts(t):
    a = t("part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 10 > 0 THEN concat('a', p_partkey) END AS attacker", "CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'critical' WHEN 2 THEN 'bogus' END AS threat_level",
        "CASE p_partkey % 3 WHEN 0 THEN 'Recon.Scanning' WHEN 1 THEN 'Malware' ELSE 'Odd' END AS kind", "CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'NaN' WHEN 2 THEN '0.4' END AS confidence",
        "CASE p_size % 3 WHEN 0 THEN 'RNN_CC' WHEN 1 THEN 'threatintel feed' ELSE '' END AS module",
    )
    return siem.idea_alerts(a).select("p_partkey", "detector_id", "category", "severity", "confidence")


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Possible  Exploit' WHEN 1 THEN 'Weak TLS Cipher' ELSE 'Brand New Risk' END AS name, CASE p_size % 4 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Low' WHEN 2 THEN 'Emergency' END AS tier FROM part)
 SELECT p_partkey, CASE name WHEN 'Possible  Exploit' THEN 'exploit' WHEN 'Weak TLS Cipher' THEN 'policy' ELSE 'unclassified' END AS category,
  CASE name WHEN 'Brand New Risk' THEN 1 WHEN 'Possible  Exploit' THEN CASE tier WHEN 'Severe' THEN 7 WHEN 'Low' THEN 4 WHEN 'Emergency' THEN 8 ELSE 4 END ELSE CASE tier WHEN 'Severe' THEN 5 WHEN 'Emergency' THEN 5 ELSE 2 END END::INT AS severity,
  CASE name WHEN 'Possible  Exploit' THEN 0.5 WHEN 'Weak TLS Cipher' THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence FROM r""")
def ndpi_classify(t):
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Possible  Exploit' WHEN 1 THEN 'Weak TLS Cipher' ELSE 'Brand New Risk' END")
    tier = F.expr("CASE p_size % 4 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Low' WHEN 2 THEN 'Emergency' END")
    c = siem.classified_risk(name, tier)
    return t("part").select("p_partkey", c["category"].alias("category"), c["severity"].alias("severity"), c["confidence"].cast("double").alias("confidence"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'HTTP://Ex.Org/Pa?Q' WHEN s_suppkey % 4 = 1 THEN '2001:0DB8:0:0:0:0:0:1' WHEN s_suppkey % 4 = 2 THEN 'ExAmple.ORG' ELSE '8.8.4.4' END AS raw, CASE WHEN s_suppkey % 4 = 0 THEN 'http://ex.org/Pa?Q' WHEN s_suppkey % 4 = 1 THEN '2001:db8::1' WHEN s_suppkey % 4 = 2 THEN 'example.org' ELSE '8.8.4.4' END AS norm FROM supplier")
def indicator_normal_form(t):
    raw = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'HTTP://Ex.Org/Pa?Q' WHEN 1 THEN '2001:0DB8:0:0:0:0:0:1' WHEN 2 THEN 'ExAmple.ORG' ELSE '8.8.4.4' END")
    kind = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'ip' WHEN 2 THEN 'domain' ELSE 'ip' END")
    return t("supplier").select("s_suppkey", raw.alias("raw"), intel.normal_indicator(kind, raw).alias("norm"))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (k = 1) AS n_new FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate) AS k FROM orders) GROUP BY ALL")
def prior_novelty(t):
    o = t("orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    out = novelty.prior_counts(o, ["o_custkey"], "o_orderpriority", "o_orderdate")
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("n_new"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || '  X'), '\\s+', ' ', 'g')) AS name, round(least(1.0, greatest(c_acctbal, 0) / 20000.0), 3) AS score FROM customer")
def scalar_forms(t):
    return t("customer").select("c_custkey", text.squashed(F.concat("c_name", F.lit("  X"))).alias("name"), stats.capped(F.greatest(F.col("c_acctbal"), F.lit(0)), 20000.0).alias("score"))
