"""Driver queries against their DuckDB SQL on small tables: both over every row of their tables."""

import duckdb
import pytest

from packetloom.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
NAMES = (
    "beacon_autocorr", "outbound_baseline", "finding_policy", "entity_risk", "kill_chain", "incidents", "corroboration", "emit_once", "siem_stats", "siem_timechart", "siem_threshold", "cef_lines", "response_actions",
    "ip_ownership", "owner_at_instant", "fact_intervals", "episode_match", "episode_score", "detector_quality", "cidr_match", "evidence_distinct", "host_sni_mismatch", "fc_enumeration", "ja4_novelty", "normalize_flow",
    "normalize_dns", "quarantine", "event_routing", "geo_lookup", "export_records", "delivery_settled", "delivery_replay", "finding_contributors", "containment", "asset_lookup", "finding_quality", "detector_table", "parity_counts",
    "campaign_rollup", "pending_recovery", "hunt", "enrichment_merge", "modbus_rules", "risk_evidence", "http_findings",
)


def plain(rows):
    """Rows in one order; numbers to six places."""
    short = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)
    return sorted((tuple(map(short, r)) for r in rows), key=repr)


def duck(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns, rows = duck(SMALL, queries.ORACLE_SQL[name])
    assert plain(got.select(columns).collect()) == plain(rows)
    assert rows or name == "siem_threshold"  # no day has three there


def test_file_kinds_of_keys_beyond_a_header_field(spark, tmp_path):
    """From key 65,536 on, the number that a file is built with needs more than 32 bits."""
    keys = (0, 65_530, 65_532, 65_535, 65_538, 65_868, 119_994, 119_999, 1_199_994, 6 * 2**40, -6)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k::BIGINT AS p_partkey, (1 + i % 50)::INTEGER AS p_size FROM (SELECT unnest([{', '.join(map(str, keys))}]) AS k, unnest(range({len(keys)})) AS i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    out = con.execute(queries.ORACLE_SQL["file_kinds"])
    columns, want = [c[0] for c in out.description], out.fetchall()
    got = queries.QUERIES["file_kinds"](spark, str(tmp_path)).select(columns).collect()
    assert len(want) == len(keys) and sorted(map(tuple, got)) == sorted(want)


def test_every_query_of_the_security_part_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
