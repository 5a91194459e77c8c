"""Flow, DNS, HTTP and counting detections over the driver's tables; thresholds fit their density.

Flows are either events (source user_id, destination event_type) or lineitem (source l_suppkey,
destination l_partkey, flow (l_orderkey, l_linenumber), duration l_quantity).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, time
from ..operators import baseline, counts, flows, health, latest, novelty, windows
from .catalog import query

_BEACON = """
WITH e AS (SELECT DISTINCT user_id, event_type, ts, value FROM events),
 p AS (SELECT user_id, event_type, count(*) AS n, list(epoch_us(ts) / 1e6 ORDER BY ts) AS t, list(value) AS v FROM e GROUP BY ALL HAVING count(*) >= 6),
 g AS (SELECT user_id, event_type, n, list_filter(list_transform(range(1, len(t)), lambda i: t[i+1] - t[i]), lambda x: x > 0) AS gaps, v FROM p),
 x AS (SELECT user_id, event_type, 'g' AS kind, gaps AS x FROM g UNION ALL SELECT user_id, event_type, 's', v FROM g),
 a AS (SELECT *, list_sort(x) AS s FROM x), b AS (SELECT *, len(s) AS n, len(s) // 2 AS h FROM a),
 c AS (SELECT *, list_aggregate(s, 'median') AS q2, CASE WHEN n < 2 THEN s[1] ELSE list_aggregate(s[1:h], 'median') END AS q1,
              CASE WHEN n < 2 THEN s[1] ELSE list_aggregate(s[n-h+1:n], 'median') END AS q3 FROM b),
 d AS (SELECT *, CASE WHEN q3 = q1 THEN 1.0 ELSE greatest(0.0, 1.0 - abs((q3 + q1 - 2.0 * q2) / (q3 - q1))) END AS bow,
              CASE WHEN q2 <= 0 THEN 0.0 ELSE 1.0 - least(list_aggregate(list_transform(s, lambda v: abs(v - q2)), 'median') / q2, 1.0) END AS mad FROM c),
 r AS (SELECT user_id, event_type, max(CASE WHEN kind = 'g' THEN (bow + mad) / 2.0 END) AS g, max(CASE WHEN kind = 's' THEN (bow + mad) / 2.0 END) AS z FROM d GROUP BY ALL),
 o AS (SELECT p.user_id, p.event_type, p.n AS n_conns, round((2.0 * (0.5 * r.g + 0.5 * r.z) + least(1.0, p.n / 12.0)) / 3.0, 3) AS score FROM p JOIN r USING (user_id, event_type))
"""


@query(_BEACON + "SELECT user_id, event_type, n_conns::INT AS n_conns, score, score >= 0.6 AS is_beacon FROM o")
def beacon_score(t):
    return flows.beacons(t("events"), ["user_id", "event_type"], size="value", threshold=0.6)


@query(_BEACON + ", c2 AS (SELECT user_id, event_type, count(*) AS n_conns FROM events GROUP BY ALL HAVING count(*) >= 16)"
       " SELECT c2.user_id, c2.event_type, c2.n_conns, round(least(1.0, c2.n_conns / 64.0), 3) AS score FROM c2 WHERE NOT EXISTS"
       " (SELECT 1 FROM o WHERE o.user_id = c2.user_id AND o.event_type = c2.event_type AND o.score >= 0.6)")  # fmt: skip
def strobe(t):
    e = t("events")
    key = ["user_id", "event_type"]
    return flows.strobes(e, key, flows.beacons(e, key, size="value", threshold=0.6), 16)


@query("""WITH p AS (SELECT user_id, event_type, count(*)::INT AS n_conns, list(epoch_us(ts) / 1e6 ORDER BY ts) AS t, list_sort(list(value)) AS v FROM events GROUP BY ALL HAVING count(*) >= 8),
 g AS (SELECT *, list_sort(list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i])) AS gaps FROM p),
 w AS (SELECT *, list_aggregate(gaps[1:greatest(1, len(gaps) // 2)], 'median') / 2 AS width FROM g),
 b AS (SELECT user_id, event_type, floor((unnest(t) - t[1]) / width)::BIGINT AS bin FROM w WHERE width > 0),
 c AS (SELECT user_id, event_type, bin, count(*) AS k FROM b GROUP BY ALL),
 z AS (SELECT user_id, event_type, n_conns, width, max(bin) + 1 AS n, n_conns / (max(bin) + 1)::DOUBLE AS mu, sum(k * k) AS sq, least((max(bin) + 1) // 2, floor((t[len(t)] - t[1]) / width / 4)::BIGINT) AS most
       FROM c JOIN w USING (user_id, event_type) GROUP BY user_id, event_type, n_conns, width, t),
 l AS (SELECT x.user_id, x.event_type, y.bin - x.bin AS lag, sum(x.k * y.k) AS pairs FROM c x JOIN c y ON x.user_id = y.user_id AND x.event_type = y.event_type AND y.bin > x.bin JOIN z ON z.user_id = x.user_id AND z.event_type = x.event_type AND y.bin - x.bin <= z.most GROUP BY ALL),
 e AS (SELECT l.user_id, l.event_type, l.lag, l.pairs, sum(CASE WHEN c.bin < z.n - l.lag THEN c.k ELSE 0 END) + sum(CASE WHEN c.bin >= l.lag THEN c.k ELSE 0 END) AS edges
       FROM l JOIN z USING (user_id, event_type) JOIN c USING (user_id, event_type) GROUP BY ALL),
 a AS (SELECT e.*, width, round((pairs - mu * edges + (n - lag) * mu * mu) / (sq - n * mu * mu), 9) AS s FROM e JOIN z USING (user_id, event_type) WHERE sq - n * mu * mu > 0),
 m AS (SELECT user_id, event_type, width, arg_max(struct_pack(l := lag, p := pairs, s := s), (s, -lag)) AS best FROM a GROUP BY ALL),
 f AS (SELECT a.user_id, a.event_type, min(a.lag) AS lag FROM a JOIN m USING (user_id, event_type) WHERE best.s > 0 AND best.l % a.lag = 0 AND a.pairs >= 0.5 * best.p GROUP BY ALL),
 r AS (SELECT w.user_id, w.event_type, w.n_conns, CASE WHEN f.lag IS NULL THEN 0.0 ELSE least(1.0, best.s) END AS s, coalesce(f.lag * w.width, 0.0) AS period, v, len(v) AS n, len(v) // 2 AS h
       FROM w LEFT JOIN m USING (user_id, event_type) LEFT JOIN f USING (user_id, event_type)),
 q AS (SELECT *, list_aggregate(v, 'median') AS q2, list_aggregate(v[1:h], 'median') AS q1, list_aggregate(v[n-h+1:n], 'median') AS q3 FROM r),
 d AS (SELECT *, (CASE WHEN q3 = q1 THEN 1.0 ELSE greatest(0.0, 1.0 - abs((q3 + q1 - 2.0 * q2) / (q3 - q1))) END
                  + CASE WHEN q2 <= 0 THEN 0.0 ELSE 1.0 - least(list_aggregate(list_transform(v, lambda x: abs(x - q2)), 'median') / q2, 1.0) END) / 2.0 AS reg FROM q),
 o AS (SELECT user_id, event_type, n_conns, period, round(s, 3) AS timing, CASE WHEN s > 0 THEN round((2.0 * (0.5 * round(s, 3) + 0.5 * reg) + least(1.0, n_conns / 12.0)) / 3.0, 3) ELSE 0.0 END AS score FROM d)
 SELECT user_id, event_type, n_conns, round(period, 3) AS period, score, timing >= 0.2 AND score >= 0.4 AS is_beacon FROM o""")
def beacon_autocorr(t):
    out = flows.autocorr_beacons(t("events"), ["user_id", "event_type"], size="value", threshold=0.4, strength=0.2)
    return out.withColumn("period", F.round("period", 3))


@query("""WITH m AS (SELECT event_type AS domain, user_id, (value)::INT % 5 AS ip, ts, value FROM events)
 SELECT user_id, domain, count(DISTINCT ip) AS n_ips FROM m GROUP BY ALL HAVING count(DISTINCT ip) >= 3 AND count(DISTINCT (ts, value)) >= 6""".replace("(value)::INT % 5", "floor(value)::INT % 5"))
def fqdn_beacon(t):
    e = t("events").select(F.col("event_type").alias("domain"), "user_id", (F.floor("value") % 5).alias("ip"), "ts", "value")
    return flows.fqdn_beacons(e, ["user_id"], "domain", "ip", size="value", min_ips=3, threshold=0.0).select("user_id", "domain", "n_ips")


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, count(DISTINCT user_id) AS n FROM events GROUP BY ALL HAVING count(DISTINCT user_id) >= 40")
def hscan_tumble(t):
    out = windows.tumbling_distinct(t("events"), ["event_type"], F.col("user_id"), "ts", "1 day", 40)
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("SELECT user_id, event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, count(DISTINCT json_extract_string(props, '$.k')) AS n"
       " FROM events GROUP BY ALL HAVING count(DISTINCT json_extract_string(props, '$.k')) >= 3")  # fmt: skip
def vscan_tumble(t):
    out = windows.tumbling_distinct(t("events"), ["user_id", "event_type"], F.get_json_object("props", "$.k"), "ts", "1 day", 3)
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 p AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM l),
 g AS (SELECT user_id, part, min(ts) AS s, max(ts) AS e, count(*) AS n, min(event_id) AS first_id FROM p GROUP BY ALL)
 SELECT user_id, epoch_us(s) AS session_start, epoch_us(e) AS session_end, n, first_id, md5(user_id || '|' || floor(epoch_us(s) / 1000000)::BIGINT) AS session_id FROM g""")
def session_stitch(t):
    out = windows.sessions(t("events"), ["user_id"], "ts", "6 hours", "event_id")
    return out.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("session_start", "session_end")})


_VOLUME = """WITH f AS (SELECT l_suppkey, date_trunc('year', l_shipdate) AS y, l_partkey, arg_max({v}, (l_shipdate, l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY ALL),
 s AS (SELECT l_suppkey, year(y)::INT AS y, sum(v) AS total, count(*) AS n_flows, count(*) FILTER (v >= {m}) AS n_material FROM f GROUP BY ALL) """


def _lineitem_flows(t):
    return t("lineitem").withColumn("y", F.year("l_shipdate")).withColumn("seq", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))


@query(_VOLUME.format(v="l_extendedprice", m=40000) + "SELECT l_suppkey, y, round(total, 2) AS total, n_flows, n_material FROM s")
def exfil_lww(t):
    out = flows.volumes(_lineitem_flows(t), ["l_suppkey", "y"], ["l_partkey"], "seq", "l_extendedprice", 40000)
    return out.withColumn("total", F.round("total", 2))


@query(_VOLUME.format(v="l_extendedprice", m=40000) + """SELECT l_suppkey, y, n_flows, n_material, CASE WHEN total >= 2.4e6 THEN 'exfil' ELSE 'low_slow_exfil' END AS detector_id FROM s
 WHERE total >= 2.4e6 OR (total >= 1e6 AND n_flows >= 10 AND n_material >= 25)""")
def low_slow_exfil(t):
    v = flows.volumes(_lineitem_flows(t), ["l_suppkey", "y"], ["l_partkey"], "seq", "l_extendedprice", 40000)
    return flows.exfil(v, 2.4e6, 1e6, 10, 25).select("l_suppkey", "y", "n_flows", "n_material", "detector_id")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, round(least(1.0, l_quantity / 270.0), 3) AS score FROM lineitem WHERE l_quantity >= 45")
def long_connection(t):
    out = flows.long_connections(t("lineitem"), "l_quantity", 45)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "score")


@query(_VOLUME.format(v="l_quantity", m=0) + "SELECT l_suppkey, y, total, n_flows, round(least(1.0, total / 12000.0), 3) AS score FROM s WHERE total >= 2000 AND n_flows >= 4")
def long_connection_cumulative(t):
    v = flows.volumes(_lineitem_flows(t), ["l_suppkey", "y"], ["l_partkey"], "seq", "l_quantity", 0)
    return flows.cumulative_connections(v, 2000, 4).drop("n_material")


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min(l_shipdate) AS s FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_partkey) AS k FROM f)
 SELECT l_suppkey, count(*) FILTER (k <= 100) AS admitted, count(*) FILTER (k > 100) AS refused FROM lineitem JOIN r USING (l_suppkey, l_partkey) GROUP BY ALL""")
def capped_admission(t):
    out = latest.admitted(t("lineitem"), ["l_suppkey"], ["l_partkey"], "l_shipdate", 100)
    return out.groupBy("l_suppkey").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min(l_shipdate) AS s FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_partkey) - 1 AS rank FROM f)
 SELECT l_suppkey, l_partkey, epoch(s)::BIGINT AS first_seen, rank FROM r WHERE rank >= 15""")
def rare_destination(t):
    out = flows.rare_destinations(t("lineitem"), ["l_suppkey"], "l_partkey", "l_shipdate")
    return out.select("l_suppkey", "l_partkey", F.unix_seconds(F.col("first_seen").cast("timestamp")).alias("first_seen"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY ALL")
def fleet_prevalence(t):
    return flows.prevalence(t("lineitem"), ["l_partkey"], "l_suppkey")


@query("""WITH n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, greatest(1, least(10, 7 + CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'N' AND l_linenumber > 2 THEN -2 ELSE 0 END
   + CASE WHEN k <= 2 THEN 1 WHEN k >= 8 THEN -1 ELSE 0 END))::INT AS severity FROM lineitem JOIN n USING (l_partkey)""")
def gated_severity(t):
    li = t("lineitem")
    breed = F.when(F.col("l_returnflag") == "R", "Unsafe").when(F.col("l_returnflag") == "N", "Safe").otherwise("Fun")
    row = li.join(flows.prevalence(li, ["l_partkey"], "l_suppkey"), "l_partkey")
    return row.select("l_orderkey", "l_linenumber", flows.gated_severity(F.lit(7), breed, F.lit(False), F.col("l_linenumber") <= 2, F.col("n_sources")).alias("severity"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
 SELECT user_id, count(g) AS n_gaps, round(avg(g), 2) AS mean_gap, round(stddev_pop(g), 2) AS deviation, round(median(g), 2) AS median_gap FROM g WHERE g IS NOT NULL GROUP BY ALL""")
def timing_evidence(t):
    out = flows.timing_evidence(t("events"), ["user_id"])
    return out.withColumns({c: F.round(c, 2) for c in ("mean_gap", "deviation", "median_gap")})


_HOST = "regexp_extract(url, '://([^/?#:]+)', 1)"


def _names(t):
    return t("pages").select("page_id", F.regexp_extract("url", "://([^/?#:]+)", 1).alias("name"), (F.col("page_id") % 3).alias("client"))


def _entropy_sql(s: str) -> str:
    return f"coalesce((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({s})::DOUBLE AS p FROM (SELECT unnest(string_split({s}, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 0.0)"


@query(f"SELECT p_partkey, round({_entropy_sql('p_name')}, 6) AS entropy FROM part")
def entropy(t):
    return t("part").select("p_partkey", F.round(text.entropy(F.col("p_name")), 6).alias("entropy"))


@query(f"""WITH n AS (SELECT page_id % 3 AS client, {_HOST} AS name FROM pages), e AS (SELECT client, name, {_entropy_sql('name')} AS ent FROM n),
 g AS (SELECT client, count(*) AS n, avg(length(name)) AS l, avg(ent) AS m FROM e GROUP BY ALL)
 SELECT client, n, round(l, 6) AS mean_length, round(m, 6) AS mean_entropy, round(least(1.0, l / 60.0 * 0.5 + m / 4.5 * 0.5), 3) AS score FROM g WHERE n >= 20 AND (l > 40 OR m > 3.0)""")
def dns_tunnel(t):
    out = counts.dns_tunnels(_names(t), ["client"], "name", 20, min_entropy=3.0)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_length", "mean_entropy")})


@query(f"""WITH n AS (SELECT page_id % 3 AS client, lower({_HOST}) AS name FROM pages), p AS (SELECT client, name, array_to_string(string_split(name, '.')[-2:], '.') AS parent FROM n),
 c AS (SELECT client, parent, count(DISTINCT name) AS n FROM p WHERE parent <> name GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY n DESC, parent) AS k FROM c)
 SELECT client, parent, n, round(least(1.0, n / 20.0), 3) AS score FROM r WHERE k = 1 AND n >= 5""")
def exploded_dns(t):
    return counts.dns_exploded(_names(t), ["client"], "name", 5)


_LABEL = "CASE WHEN len(list_filter(string_split(name, '.'), lambda x: x <> '')) >= 2 THEN list_filter(string_split(name, '.'), lambda x: x <> '')[-2] ELSE '' END"


@query(f"""WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) || (p_partkey % 97) || '.com' AS name FROM part), l AS (SELECT p_partkey, {_LABEL} AS label FROM n),
 s AS (SELECT p_partkey, label, {_entropy_sql('label')} AS e, length(label) AS n, coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) AS run FROM l),
 q AS (SELECT p_partkey, label, CASE WHEN n < 8 THEN 0.0 ELSE round(least(0.35 * least(e / 4.0, 1.0) + 0.25 * least(run / 6.0, 1.0)
   + 0.20 * (1.0 - least(length(regexp_replace(label, '[^aeiou]', '', 'g')) / n::DOUBLE / 0.30, 1.0)) + 0.20 * least(length(regexp_replace(label, '[^0-9]', '', 'g')) / n::DOUBLE / 0.30, 1.0), 1.0), 3) END AS score FROM s)
 SELECT * FROM q WHERE score >= 0.4""")
def dga_domain(t):
    name = F.concat(F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))), (F.col("p_partkey") % 97).cast("string"), F.lit(".com"))
    return counts.dga_domains(t("part").select("p_partkey", name.alias("name")), "name", 0.4).drop("name")


@query(f"SELECT page_id, array_to_string(string_split(lower({_HOST}), '.')[-2:], '.') AS parent FROM pages")
def registered_parent(t):
    return _names(t).select("page_id", text.registered_parent(F.col("name")).alias("parent"))


_URL = """url || CASE page_id % 9 WHEN 0 THEN '?q=1'' or 1=1' WHEN 1 THEN '/uploads/x1.php' WHEN 2 THEN ';cat /etc/passwd' WHEN 3 THEN '?password=abc' WHEN 4 THEN '/../../etc'
 WHEN 5 THEN '?a=UNION/**/SELECT' WHEN 6 THEN '/c99' WHEN 7 THEN '?x=$(id)' ELSE '' END"""
_METHOD = "CASE WHEN page_id % 4 = 0 THEN 'put' WHEN page_id % 4 = 1 THEN 'TRACE' ELSE 'GET' END"


@query(f"WITH u AS (SELECT page_id, {_URL} AS u, {_METHOD} AS m FROM pages), h AS (SELECT page_id, unnest([" + ", ".join(
    f"CASE WHEN regexp_matches(u, '{p.replace(chr(39), chr(39) * 2)}') THEN {{'d': '{d}', 'c': '{c}', 's': {s}}} END" for d, c, s, p in rules.HTTP_PATTERNS)
    + f", CASE WHEN upper(m) IN {rules.RISKY_METHODS} THEN {{'d': 'http_suspicious_method', 'c': 'c2', 's': 5}} END]) AS r FROM u)"
    " SELECT page_id, r.d AS detector_id, r.c AS category, r.s AS severity FROM h WHERE r IS NOT NULL")  # fmt: skip
def http_rules(t):
    u = t("pages").select("page_id", F.expr(_URL).alias("u"), F.expr(_METHOD).alias("m"))
    return u.select("page_id", F.inline(rules.http_rules(F.col("m"), F.col("u")))).drop("hit")


_AGENT = "CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Mozilla/5.0 PowerShell nmap' WHEN 3 THEN 'CURL/8 python-requests' WHEN 4 THEN 'Mozilla/5.0' ELSE 'x java/11' END"


@query(f"""WITH a AS (SELECT page_id, {_AGENT} AS a FROM pages), r AS (SELECT page_id, CASE WHEN coalesce(a, '') = '' THEN 'empty_ua' ELSE
 (SELECT w FROM (SELECT unnest({list(rules.TOOL_AGENTS)}) AS w, unnest(range({len(rules.TOOL_AGENTS)})) AS k) WHERE contains(lower(a), w) ORDER BY k LIMIT 1) END AS why FROM a)
 SELECT page_id, why FROM r WHERE why IS NOT NULL""")
def suspicious_ua(t):
    out = t("pages").select("page_id", rules.suspicious_agent(F.expr(_AGENT)).alias("why"))
    return out.filter("why IS NOT NULL")


_SNI = "CASE p_partkey % 6 WHEN 0 THEN 'X.Dropbox.com' WHEN 1 THEN 'dns.google' WHEN 2 THEN 'a.s3.amazonaws.com' WHEN 3 THEN 'example.org' WHEN 4 THEN 'doh.opendns.com' END"


@query(f"""WITH s AS (SELECT p_partkey, {_SNI} AS s, CASE WHEN p_size % 7 = 0 THEN 853 ELSE 443 END AS port FROM part),
 r AS (SELECT p_partkey, (SELECT min(w) FROM (SELECT unnest({list(rules.STAGING_HOSTS)}) AS w) WHERE contains(lower(s), w)) AS staging,
  CASE WHEN port = 853 THEN 'dot:853' WHEN s <> 'dns.google' THEN 'doh:' || (SELECT min(w) FROM (SELECT unnest({list(rules.DOH_HOSTS)}) AS w) WHERE contains(lower(s), w)) END AS doh FROM s)
 SELECT * FROM r WHERE staging IS NOT NULL OR doh IS NOT NULL""")
def sni_rules(t):
    s = t("part").select("p_partkey", F.expr(_SNI).alias("s"), F.expr("CASE WHEN p_size % 7 = 0 THEN 853 ELSE 443 END").alias("port"))
    out = s.select("p_partkey", rules.cloud_staging(F.col("s")).alias("staging"), rules.encrypted_dns(F.col("s"), F.col("port"), ("dns.google",)).alias("doh"))
    return out.filter("staging IS NOT NULL OR doh IS NOT NULL")


_PORT = "CASE l_linenumber WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 8080 WHEN 4 THEN 445 WHEN 5 THEN 3389 WHEN 6 THEN 5985 ELSE 9999 END"
_APP = "CASE l_returnflag WHEN 'A' THEN 'SSL' WHEN 'N' THEN 'ssh' ELSE 'unknown' END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_PORT} AS port, CASE l_returnflag WHEN 'A' THEN 'tls' WHEN 'N' THEN 'ssh' END AS app FROM lineitem),
 w AS (SELECT *, CASE port WHEN 443 THEN 'tls' WHEN 22 THEN 'ssh' WHEN 8080 THEN 'http' WHEN 445 THEN 'smb' WHEN 3389 THEN 'rdp' END AS want FROM r)
 SELECT l_orderkey, l_linenumber, app || ' on port ' || port || ' (expected ' || want || ')' AS why FROM w WHERE app <> want""")
def port_proto_mismatch(t):
    out = t("lineitem").select("l_orderkey", "l_linenumber", rules.port_mismatch(F.expr(_APP), F.expr(_PORT)).alias("why"))
    return out.filter("why IS NOT NULL")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'self_signed' ELSE 'short_validity' END AS why FROM orders WHERE o_orderkey % 11 = 0 OR (o_orderkey % 5) / 2.0 < 2 AND o_orderkey % 7 > 0""")
def tls_cert_anomaly(t):
    o = t("orders")
    start = F.col("o_orderdate").cast("timestamp")
    before = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    after = F.when(F.col("o_orderkey") % 7 > 0, F.date_format(start + F.make_dt_interval(hours=((F.col("o_orderkey") % 5) * 12).cast("int")), "yyyy-MM-dd'T'HH:mm:ss+0000")).otherwise("never")
    issuer = F.when(F.col("o_orderkey") % 11 == 0, " CN=a ").otherwise("CN=b")
    return o.select("o_orderkey", rules.cert_anomaly(F.lit("CN=a"), issuer, before, after).alias("why")).filter("why IS NOT NULL")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE " + _PORT.replace("l_linenumber", "l_linenumber") + " IN (22, 445, 3389, 5985) GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 5")
def lateral_movement(t):
    f = t("lineitem").withColumn("port", F.expr(_PORT))
    return counts.lateral_fanout(f, ["l_suppkey"], "l_partkey", "port")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_linenumber = 5 GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 3")
def rdp_fanout(t):
    return counts.rdp_fanout(t("lineitem").withColumn("port", F.expr(_PORT)), ["l_suppkey"], "l_partkey", "port")


@query("""WITH p AS (SELECT o_custkey, o_orderstatus AS dst, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY ALL), g AS (SELECT o_custkey, count(*) AS d, max(k) AS k FROM p GROUP BY ALL)
 SELECT o_custkey, CASE WHEN d >= 3 THEN 'horizontal' ELSE 'vertical' END AS kind, CASE WHEN d >= 3 THEN d ELSE k END AS n FROM g WHERE d >= 3 OR k >= 4""")
def internal_scan(t):
    return counts.internal_scans(t("orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority", 3, 4)


@query("SELECT l_suppkey, count(DISTINCT l_partkey % 40) AS n, bool_or(l_returnflag = 'R') AS weak FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL HAVING count(DISTINCT l_partkey % 40) >= 18 OR (bool_or(l_returnflag = 'R') AND count(DISTINCT l_partkey % 40) >= 12)")
def kerberoasting(t):
    r = t("lineitem").filter("l_linenumber = 7").select("l_suppkey", (F.col("l_partkey") % 40).cast("string").alias("spn"), F.when(F.col("l_returnflag") == "R", "0x17").otherwise("18").alias("etype"))
    return counts.kerberoasting(r, ["l_suppkey"], "spn", "etype", 18, 12)


@query("SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events WHERE event_type = 'login' OR event_type LIKE '%e%' GROUP BY ALL HAVING count(DISTINCT json_extract_string(props, '$.k')) >= 10")
def password_spraying(t):
    e = t("events")
    return counts.fanout(e, ["user_id"], F.get_json_object("props", "$.k"), 10, (F.col("event_type") == "login") | F.col("event_type").like("%e%"))


@query("""WITH g AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_files, count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS n_writes, count(DISTINCT l_partkey) FILTER (l_returnflag <> 'N') AS n_reads FROM lineitem GROUP BY ALL)
 SELECT *, n_writes / (n_writes + n_reads)::DOUBLE AS write_share FROM g WHERE n_files >= 100 AND n_writes >= 100 AND n_writes / (n_writes + n_reads)::DOUBLE >= 0.34""")
def ransomware_smb(t):
    return counts.smb_ransomware(t("lineitem"), ["l_suppkey"], "l_partkey", F.col("l_returnflag") == "N", min_share=0.34)


@query("""WITH g AS (SELECT user_id, count(DISTINCT event_type) AS n_codes, count(DISTINCT json_extract_string(props, '$.k')) AS n_units FROM events GROUP BY ALL)
 SELECT user_id, n_codes, n_units, CASE WHEN n_codes >= 5 THEN 'fc enumeration: ' || n_codes || ' distinct function codes' ELSE 'unit enumeration: ' || n_units || ' distinct unit IDs' END AS why FROM g WHERE n_codes >= 5 OR n_units >= 9""")
def fc_enumeration(t):
    e = t("events").withColumn("unit", F.get_json_object("props", "$.k"))
    return counts.modbus_enumeration(e, ["user_id"], "event_type", "unit", 5, 9)


@query("SELECT user_id, (epoch(ts)::BIGINT // 86400) AS bucket, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL HAVING count(*) >= 2".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def event_burst(t):
    e = t("events").withColumn("bucket", time.bucket(F.col("ts"), 86400))
    return counts.event_bursts(e, ["user_id", "bucket"], F.col("value") > 50, 2)


@query("SELECT user_id, round(sum(value), 3) AS total FROM events GROUP BY ALL HAVING bool_or(event_type = (SELECT min(event_type) FROM events)) AND sum(value) >= 1000")
def icmp_exfil(t):
    e = t("events")
    first = e.agg(F.min("event_type").alias("_m"))
    e = e.join(F.broadcast(first)).withColumn("proto", F.when(F.col("event_type") == F.col("_m"), "icmp").otherwise("TCP"))
    return counts.icmp_exfil(e, ["user_id"], "proto", F.col("value"), 1000).withColumn("total", F.round("total", 3))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS fp, o_orderdate FROM orders),
 f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, fp ORDER BY o_orderdate, o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, fp, o_orderkey) AS r FROM o),
 d AS (SELECT f.*, (SELECT count(*) FROM f p WHERE p.o_custkey = f.o_custkey AND p.k = 1 AND p.r < f.r) AS known FROM f)
 SELECT o_custkey, fp, epoch(o_orderdate)::BIGINT AS at, known FROM d WHERE k = 1 AND known >= 3""")
def fingerprint_rarity(t):
    o = t("orders").select("o_custkey", F.col("o_orderpriority").alias("fp"), "o_orderdate")
    out = novelty.rare_values(o, ["o_custkey"], "fp", "o_orderdate", 3)
    return out.select("o_custkey", "fp", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("n_prior_distinct").alias("known"))


@query("""SELECT o.o_orderkey, (SELECT count(DISTINCT p.o_orderpriority) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate BETWEEN o.o_orderdate - INTERVAL 200 DAY AND o.o_orderdate) AS n_recent
 FROM orders o WHERE n_recent >= 3""")
def transition_burst(t):
    out = windows.trailing_distinct(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", 200 * 86400)
    return out.filter("n_recent >= 3").select("o_orderkey", "n_recent")


_FP = "'t13d' || lpad((o_custkey % 3 * 100 + o_orderkey % 4)::VARCHAR, 4, '0') || 'h2_' || lpad((o_orderkey % 4)::VARCHAR, 12, '0') || '_' || lpad((o_custkey % 2)::VARCHAR, 12, '0')"


@query(f"""WITH o AS (SELECT o_custkey % 20 AS entity, {_FP} AS fp, o_orderdate AS ts, o_orderkey FROM orders),
 f AS (SELECT *, row_number() OVER (PARTITION BY entity, fp ORDER BY ts, o_orderkey) AS k, row_number() OVER (PARTITION BY entity ORDER BY ts, fp, o_orderkey) - 1 AS prior, min(ts) OVER (PARTITION BY entity) AS since,
         split_part(fp, '_', 1) || split_part(fp, '_', 3) AS ac FROM o),
 g AS (SELECT *, row_number() OVER (PARTITION BY entity, ac ORDER BY ts, fp, o_orderkey) > 1 AS alike FROM f),
 h AS (SELECT g.*, (SELECT count(DISTINCT entity) FROM o p WHERE p.fp = g.fp AND p.ts <= g.ts) AS fleet FROM g WHERE k = 1)
 SELECT entity, fp, fleet AS n_fleet, greatest(1, CASE WHEN fleet <= 3 THEN 5 ELSE 2 END - CASE WHEN alike THEN 1 ELSE 0 END)::INT AS severity,
        CASE WHEN fleet <= 3 THEN 0.5 ELSE 0.3 END::DOUBLE * CASE WHEN alike THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM h
 WHERE prior >= 1 AND epoch(ts) - epoch(since) >= 86400""")
def ja4_novelty(t):
    spark_fp = _FP.replace("::VARCHAR", "").replace("lpad((", "lpad(CAST((").replace(", 4, '0')", " AS STRING), 4, '0')").replace(", 12, '0')", " AS STRING), 12, '0')")
    o = t("orders").select((F.col("o_custkey") % 20).alias("entity"), F.expr(spark_fp).alias("fp"), F.col("o_orderdate").alias("ts"))
    out = novelty.ja4_novelty(o, [], "entity", "fp", "ts", min_observations=1, rare=3)
    return out.select("entity", "fp", "n_fleet", "severity", F.col("confidence").cast("double").alias("confidence"))


@query("""WITH w AS (SELECT event_type || '/' || user_id // 8 AS cohort, user_id, floor(epoch(ts) / 86400)::BIGINT * 86400 AS start, sum(value) AS b FROM events GROUP BY ALL),
 j AS (SELECT w.cohort, w.user_id, w.start, w.b, h.user_id = w.user_id AS own, h.user_id AS who, h.b AS v FROM w JOIN w h ON h.cohort = w.cohort AND h.start >= w.start - 20 * 86400 AND h.start + 86400 <= w.start),
 m AS (SELECT *, median(v) OVER (PARTITION BY cohort, user_id, start, own) AS med FROM j),
 s AS (SELECT cohort, user_id, start, b, own, count(*) AS n, count(DISTINCT who) AS k, any_value(med) AS med, greatest(1.4826 * median(abs(v - med)), 4.0, any_value(med) * 0.1) AS sc FROM m GROUP BY ALL),
 r AS (SELECT p.cohort, p.user_id, p.start, p.b, greatest(0.0, (p.b - p.med) / p.sc) AS dp, CASE WHEN o.n >= 3 THEN greatest(0.0, (o.b - o.med) / o.sc) END AS d0
       FROM s p LEFT JOIN s o ON o.own AND o.cohort = p.cohort AND o.user_id = p.user_id AND o.start = p.start WHERE NOT p.own AND p.n >= 3 AND p.k >= 2)
 SELECT cohort, user_id, start, round(CASE WHEN d0 IS NULL THEN dp ELSE least(d0, dp) END, 4) AS score, CASE WHEN d0 IS NULL THEN 'peer-only-cold-start' ELSE 'entity-and-peer' END AS mode
 FROM r WHERE CASE WHEN d0 IS NULL THEN dp ELSE least(d0, dp) END > 3.0""")
def outbound_baseline(t):
    e = t("events").withColumn("cohort", F.concat_ws("/", "event_type", F.floor(F.col("user_id") / 8).cast("string")))
    w = baseline.outbound_windows(e, ["cohort"], "user_id", "ts", "value", 86400)
    out = baseline.outbound_anomalies(w, ["cohort"], "user_id", 86400, history=20, threshold=3.0, floor=4.0)
    return out.select("cohort", "user_id", "start", F.round("score", 4).alias("score"), "mode")


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'decode' WHEN 1 THEN 'stream' ELSE 'applayer' END"
_EVENT = "CASE l_returnflag WHEN 'N' THEN 'decoder.ipv4.invalid_checksum' WHEN 'A' THEN 'stream.reassembly_gap' ELSE 'decoder.ipv4.trunc' END"


@query(f"""WITH a AS (SELECT l_suppkey, {_KIND} AS k, {_EVENT} AS e FROM lineitem), b AS (SELECT *, k = 'applayer' OR (k = 'stream' AND contains(e, 'reassembly')) AS threat FROM a),
 g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (NOT threat AND contains(e, 'checksum')) AS n_checksum, count(*) FILTER (NOT (NOT threat AND contains(e, 'checksum')) AND k = 'decode') AS n_other_decode FROM b GROUP BY ALL)
 SELECT *, round(n_checksum / n::DOUBLE, 4) AS share, CASE WHEN n_other_decode / (n_checksum + n_other_decode)::DOUBLE > 0.5 THEN 'link_corruption_suspected' ELSE 'checksum_validation_suspected' END AS verdict
 FROM g WHERE n >= 200 AND n_checksum / n::DOUBLE >= 0.22""")
def checksum_health(t):
    a = t("lineitem").select("l_suppkey", F.expr(_KIND).alias("k"), F.expr(_EVENT).alias("e"))
    return health.checksum_health(a, ["l_suppkey"], "k", "e", min_share=0.22, mixed=0.5)


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 10 END AS p, o_orderkey % 50 AS d, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey * 10 END AS k, o_orderkey % 30 AS a FROM orders),
 r AS (SELECT o_orderkey, CASE WHEN p + d > 0 THEN d / (p + d)::DOUBLE END AS loss, CASE WHEN k >= 5000 THEN 2 * a / k::DOUBLE END AS ratio FROM s),
 q AS (SELECT *, CASE WHEN ratio <= 0.001 THEN 'blind' WHEN loss >= 0.02 THEN 'degraded' WHEN loss IS NULL AND ratio IS NULL THEN 'unknown' ELSE 'good' END AS quality FROM r)
 SELECT o_orderkey, loss, ratio, quality, CASE quality WHEN 'blind' THEN least((o_orderkey % 10) / 10.0::DOUBLE, greatest(0.05, (o_orderkey % 10) / 10.0::DOUBLE * 0.4))
   WHEN 'degraded' THEN least((o_orderkey % 10) / 10.0::DOUBLE, greatest(0.05, (o_orderkey % 10) / 10.0::DOUBLE * 0.7)) ELSE (o_orderkey % 10) / 10.0::DOUBLE END AS confidence FROM q""")
def coverage_quality(t):
    k = F.col("o_orderkey")
    s = t("orders").select(
        "o_orderkey", F.when(k % 5 > 0, F.col("o_custkey") * 10).alias("kernel_packets"), (k % 50).alias("kernel_drops"), F.when(k % 3 > 0, F.col("o_custkey") * 10).alias("decoder_packets"),
        F.create_map(F.lit("http"), k % 30, F.lit("dns"), k % 30).alias("flows"),
    )
    out = health.sensor_quality(s)
    return out.select("o_orderkey", "loss", "ratio", "quality", health.discounted((k % 10) / 10.0, F.col("quality")).alias("confidence"))
