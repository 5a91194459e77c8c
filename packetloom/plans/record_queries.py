"""Parsing, normalisation, routing and lookups over event records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intel
from ..sources import eve, feeds
from . import normalize
from .catalog import query

_SRC = "'10.0.' || (user_id % 8) || '.' || (event_id % 250)"


def _records(t):
    """Flow, DNS and broken lines as a sensor writes them."""
    e = t("events")
    kind = F.when(F.col("event_id") % 12 == 0, "dns").when(F.col("event_id") % 20 == 4, "odd").otherwise("flow")
    flow = F.when(kind == "flow", F.struct(F.floor("value").alias("bytes_toserver"), F.when(F.col("event_id") % 8 == 0, F.lit(7)).alias("bytes_toclient"), F.lit(1.5).alias("age")))
    dns = F.when(kind == "dns", F.struct(F.upper(F.col("event_type")).alias("rrname"), F.lit("nxdomain").alias("rcode"), F.when(F.col("event_id") % 24 == 0, 2).otherwise(3).alias("version")))
    line = F.to_json(F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+0000'").alias("timestamp"), kind.alias("event_type"), F.expr(_SRC).alias("src_ip"), F.lit("8.8.8.8").alias("dest_ip"),
        F.col("event_id").cast("string").alias("flow_id"), F.lit("t").alias("tenant"), flow.alias("flow"), dns.alias("dns"),
    ))
    return eve.parse(e.select(F.when(F.col("event_id") % 44 == 0, F.lit("{broken")).otherwise(line).alias("value")))


_KIND = "CASE WHEN event_id % 12 = 0 THEN 'dns' WHEN event_id % 20 = 4 THEN 'odd' ELSE 'flow' END"
_E = f"e AS (SELECT *, {_KIND} AS kind, {_SRC} AS src FROM events WHERE event_id % 44 > 0)"


@query(f"""WITH {_E} SELECT event_id::VARCHAR AS flow_id, src AS src_ip, floor(epoch(ts))::BIGINT AS at, floor(value)::BIGINT AS bytes_toserver, CASE WHEN event_id % 8 = 0 THEN 7 ELSE 0 END::BIGINT AS bytes_toclient, 0::BIGINT AS pkts_toserver, '' AS state
 FROM e WHERE kind = 'flow'""")
def normalize_flow(t):
    f = normalize.flows(_records(t))
    return f.select("flow_id", "src_ip", F.unix_seconds("event_time").alias("at"), "bytes_toserver", "bytes_toclient", "pkts_toserver", "state")


@query(f"WITH {_E} SELECT event_id::VARCHAR AS flow_id, lower(event_type) AS rrname, 'NXDOMAIN' AS rcode FROM e WHERE kind = 'dns' AND event_id % 24 > 0")
def normalize_dns(t):
    return normalize.dns(_records(t))[0].select("flow_id", "rrname", "rcode")


@query(f"WITH {_E} SELECT reason, count(*) AS n FROM (SELECT 'dns version' AS reason FROM e WHERE kind = 'dns' AND event_id % 24 = 0 UNION ALL SELECT 'malformed' FROM events WHERE event_id % 44 = 0) GROUP BY ALL")
def quarantine(t):
    return normalize.typed(_records(t))["quarantine"].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E} SELECT CASE kind WHEN 'odd' THEN 'suricata.raw.v1' ELSE 'suricata.' || kind || '.v1' END AS topic, src AS key, count(*) AS n FROM e GROUP BY ALL")
def event_routing(t):
    out = eve.routed(_records(t).filter("_corrupt_record IS NULL"), "mine", "s1")
    return out.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT p_partkey, p_partkey % 4 AS b, p_size % 8 AS c, p_partkey % 200 AS d FROM part),
 i AS (SELECT s_suppkey, s_suppkey % 4 AS b, s_nationkey % 8 AS c, s_suppkey % 3 AS k, s_suppkey % 5 > 0 AS live FROM supplier)
 SELECT DISTINCT p_partkey, CASE k WHEN 0 THEN '10.' || i.b || '.0.0/16' WHEN 1 THEN '10.' || i.b || '.' || i.c || '.0/24' ELSE '10.' || i.b || '.' || i.c || '.7' END AS indicator FROM o JOIN i ON o.b = i.b AND live AND (k = 0 OR (i.c = o.c AND (k = 1 OR o.d = 7)))""")
def intel_match(t):
    seen = t("part").selectExpr("p_partkey", "'t' AS tenant", "'ip' AS kind", "'src_ip' AS field", "concat('10.', p_partkey % 4, '.', p_size % 8, '.', p_partkey % 200) AS value")
    known = t("supplier").selectExpr(
        "'t' AS tenant", "'ip' AS kind", "CASE WHEN s_suppkey % 5 > 0 THEN 'active' ELSE 'expired' END AS disposition",
        "CASE s_suppkey % 3 WHEN 0 THEN concat('10.', s_suppkey % 4, '.0.0/16') WHEN 1 THEN concat('10.', s_suppkey % 4, '.', s_nationkey % 8, '.0/24') ELSE concat('10.', s_suppkey % 4, '.', s_nationkey % 8, '.7') END AS indicator",
    ).distinct()
    return intel.match(seen, known).select("p_partkey", "indicator")


@query("""WITH a AS (SELECT p_partkey, p_size % 5 AS b, p_partkey % 6 AS c FROM part) SELECT p_partkey, CASE WHEN b = 4 THEN NULL WHEN c < 3 THEN 'fine' || b || c ELSE 'wide' || b END AS country FROM a""")
def geo_lookup(t):
    a = t("part").selectExpr("p_partkey", "concat(CASE WHEN p_size % 5 = 4 THEN '10.' ELSE '8.' END, p_size % 5, '.', p_partkey % 6, '.', p_partkey % 250) AS ip")
    n = t("nation").selectExpr("n_nationkey AS b", "explode(array(-1, 0, 1, 2)) AS c")
    n = n.selectExpr("CASE WHEN c < 0 THEN concat('8.', b, '.0.0/16') ELSE concat('8.', b, '.', c, '.0/24') END AS net", "CASE WHEN c < 0 THEN concat('wide', b) ELSE concat('fine', b, c) END AS country")
    return feeds.geo_join(a, "ip", n, "net", ["country"]).select("p_partkey", "country")
