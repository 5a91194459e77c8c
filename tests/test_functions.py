"""Column builders against plain Python and the standard library."""

import ipaddress
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.functions import ids, ip, rules, stats, text, time

ADDRESSES = [
    "10.0.0.1", "8.8.8.8", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "203.0.113.7", "198.18.0.1",
    "100.64.0.1", "100.128.0.1", "224.0.0.1", "255.255.255.255", "0.0.0.0", "1.1.1.1", "192.0.0.9", "192.0.0.8", "240.0.0.1", "::", "::1", "fe80::1", "fd00::1", "fc00::", "2001:db8::1",
    "2001:4860:4860::8888", "2600::", "::ffff:8.8.8.8", "ff02::1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1::8", "1:0:0:2::3", "A:B:C:D:E:F:0:1", "2001:db8:0:1:1:1:1:1",
]
MALFORMED = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", ":::", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":1:2", "fe80::1%eth0", "01.2.3.4", "x", None]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).select("i", make(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_keys_order_like_addresses(spark):
    got = apply(spark, ADDRESSES + MALFORMED, ip.key)
    for a, k in zip(ADDRESSES, got, strict=False):
        x = ipaddress.ip_address(a)
        assert int(k, 16) == (int(x) if x.version == 6 else (0xFFFF << 32) + int(x)), a
    assert got[len(ADDRESSES) :] == [None] * len(MALFORMED)


def test_canonical_form(spark):
    got = apply(spark, ADDRESSES, ip.canonical)
    for a, g in zip(ADDRESSES, got, strict=True):
        want = ipaddress.ip_address(a).compressed
        assert ipaddress.ip_address(g) == ipaddress.ip_address(a) and (g == want or "." in want or ":ffff:" in g), (a, g)


def test_internal_and_global_follow_the_registries(spark):
    inner = apply(spark, ADDRESSES, ip.is_internal)
    glob = apply(spark, ADDRESSES, ip.is_global)
    for a, i, g in zip(ADDRESSES, inner, glob, strict=True):
        x = ipaddress.ip_address(a)
        if x.version == 6 and x.ipv4_mapped:
            continue
        assert i == (x.is_private or x.is_link_local), a
        if a not in ("64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1::8", "1:0:0:2::3", "A:B:C:D:E:F:0:1"):
            assert g == (x.is_global and not x.is_multicast) or x.is_multicast, a
    assert apply(spark, MALFORMED, ip.is_internal) == [False] * len(MALFORMED)


def test_external_uses_string_prefixes(spark):
    want = {"8.8.8.8": True, "10.0.0.1": False, "172.15.0.1": True, "172.31.255.255": False, "203.0.113.7": True, "224.0.0.1": False, "fe80::1": False, "fd00::1": False, "2600::": True, "": False, "g::1": False, "x": True}
    assert apply(spark, list(want), ip.is_external) == list(want.values())
    assert apply(spark, [None, "100.64.0.1"], lambda c: ip.is_external(c, ("100.64.",))) == [False, False]


def test_masks_tell_networks(spark):
    r = random.Random(1)
    for net in ("10.1.0.0/21", "192.0.2.128/25", "2001:db8::/33", "0.0.0.0/0", "8.8.8.8/32"):
        n = ipaddress.ip_network(net)
        some = [str(n[r.randrange(n.num_addresses)]) for _ in range(5)] + [str(type(n.network_address)(r.getrandbits(n.max_prefixlen))) for _ in range(5)]
        length = apply(spark, [net], ip.net_length)[0]
        base = apply(spark, [str(n.network_address)], lambda c: ip.mask(ip.key(c), F.lit(length)))[0]
        got = apply(spark, some, lambda c: ip.mask(ip.key(c), F.lit(length)))  # noqa: B023
        assert [g == base for g in got] == [ipaddress.ip_address(a) in n for a in some]
    assert apply(spark, ["10.0.0.0/33", "x/8", "10.0.0.1", "::1/129", "::/0"], ip.net_length) == [None, None, 128, None, 0]


def brute_entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0


def test_entropy(spark):
    words = ["hello", "", "aaaa", "abcdefgh", "x1y2z3", "éèé"]
    got = apply(spark, [*words, None], text.entropy)
    assert got[:-1] == pytest.approx([brute_entropy(w) for w in words]) and got[-1] == 0.0


def test_domains(spark):
    names = ["a.b.tunnel.evil.co.uk", "WWW.Example.COM.", "localhost", "", None, "x.com.au", "com.au", "a..b.org"]
    assert apply(spark, names, text.registered_parent) == ["evil.co.uk", "example.com", "localhost", "", "", "x.com.au", "com.au", "b.org"]
    assert apply(spark, names, text.registered_label) == ["co", "Example", "", "", "", "com", "com", "b"]


def test_generated_names_score_high(spark):
    got = apply(spark, ["xk7q9zt4mwp2v8.com", "wikipedia.org", "short.io", "d2k1fab3.cloudfront.net", None], text.dga_score)
    assert got[0] >= 0.72 and got[1] < 0.5 and got[2] == 0.0 and got[3] < 0.72 and got[4] == 0.0


def brute_quartiles(xs):
    s, n = sorted(xs), len(xs)
    if n < 2:
        return (s[0],) * 3
    half = n // 2
    return statistics.median(s[:half]), statistics.median(s), statistics.median(s[n - half :])


def brute_regularity(xs):
    q1, q2, q3 = brute_quartiles(xs)
    bowley = 1.0 if q3 == q1 else max(0.0, 1 - abs((q3 + q1 - 2 * q2) / (q3 - q1)))
    madm = 0.0 if q2 <= 0 else 1 - min(statistics.median(abs(x - q2) for x in xs) / q2, 1)
    return (bowley + madm) / 2


def test_robust_statistics(spark):
    r = random.Random(2)
    rows = [[r.uniform(0, 100) for _ in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 40)] + [[5.0] * 6, [0.0, 0.0, 1.0]]
    a = lambda c: F.array_sort(c)
    got = apply(spark, rows, lambda c: F.array(*stats.quartiles(a(c))), "array<double>")
    assert [g == pytest.approx(brute_quartiles(x)) for g, x in zip(got, rows, strict=True)] == [True] * len(rows)
    assert apply(spark, rows, lambda c: stats.regularity(a(c)), "array<double>") == pytest.approx([brute_regularity(x) for x in rows])


def test_beacon_scores(spark):
    steady = [60.0 * i for i in range(12)]
    gapped = [60.0 * i for i in range(45) if i % 3 != 2]
    rows = [steady, steady[:5], [1.0] * 12, [60.0 * i + (i % 2) for i in range(12)], gapped, [0.0, 0.0, *[60.0 * i for i in range(1, 11)]]]
    got = apply(spark, rows, stats.beacon_score, "array<double>")
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0 and 0.6 < got[3] < 0.7
    assert got[4] == pytest.approx(0.67, abs=0.08)  # missed beats spoil interval statistics
    assert got[5] > 0.9  # zero gaps are left out


def test_wilson(spark):
    df = column(spark, [(8, 10), (0, 5), (0, 0)], "struct<h:long,n:long>")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(stats.wilson(F.col("v.h"), F.col("v.n")))]).orderBy("i").collect()
    assert rows[0][1:] == pytest.approx((0.8, 0.49016, 0.94331), abs=1e-4)
    assert rows[1][1] == 0.0 and rows[1][2] == pytest.approx(0.0, abs=1e-12) and rows[2][1:] == (None, None, None)


def test_event_times(spark):
    got = apply(spark, ["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05+0000", "2024-01-02T05:04:05+02:00", "2024-01-02T03:04:05", "soon", None], lambda c: time.epoch(time.event_time(c)))
    assert got == [1704164645.5, 1704164645.0, 1704164645.0, 1704164645.0, None, None]


def test_http_rules(spark):
    urls = ["/c99.php", "/?id=1' or '1'='1", "/x;cat%20", "/a;wget http", "/../../etc/passwd", "/login?password=x", "/uploads/a_1.php", "/index.html", None]
    got = apply(spark, urls, lambda c: F.transform(rules.http_rules(F.lit("GET"), c), lambda x: x["detector_id"]))
    assert got[0] == ["http_webshell"] and got[1] == ["http_sqli"] and got[3] == ["http_cmd_injection"] and "http_path_traversal" in got[4]
    assert got[5] == ["http_cred_in_url"] and got[6] == ["http_webshell"] and got[7] == [] and got[8] == []
    assert apply(spark, ["put", "GET", None], lambda c: F.size(rules.http_rules(c, F.lit("/")))) == [1, 0, 0]


def test_agents_names_and_certificates(spark):
    assert apply(spark, [None, "", "curl/8.0", "Mozilla/5.0", "x Nmap"], rules.suspicious_agent) == ["empty_ua", "empty_ua", "curl/", None, "nmap"]
    assert apply(spark, ["a.dropbox.com", "x.org", None], rules.cloud_staging) == ["dropbox.com", None, None]
    assert apply(spark, ["dns.google", "x"], lambda c: rules.encrypted_dns(c, F.lit(443))) == ["doh:dns.google", None]
    assert apply(spark, ["x"], lambda c: rules.encrypted_dns(c, F.lit(853))) == ["dot:853"]
    assert apply(spark, [22, 443, 9999, None], lambda c: rules.port_mismatch(F.lit("SSL"), c), "int") == ["tls on port 22 (expected ssh)", None, None, None]
    day = lambda c: rules.cert_anomaly(F.lit("CN=a"), F.lit("CN=b"), F.lit("2024-01-01T00:00:00Z"), c)
    assert apply(spark, ["2024-01-02T00:00:00Z", "2025-01-01T00:00:00", "x", None], day) == ["short_validity", None, None, None]
    fp = "t13d1516h2_8daaf6152771_b186095e22b6"
    assert apply(spark, [fp, fp[:-1], "", None], rules.ja4_valid) == [True, False, False, False]
    assert apply(spark, [fp], rules.ja4_ac) == ["t13d1516h2_b186095e22b6"]


def test_modbus_fields(spark):
    rows = ['{"function":{"code":6},"unit_id":1}', '{"function":16,"access":{"type":"write"}}', '{"function_code":"90"}', '{"exception":"illegal"}', "{}", None]
    got = apply(spark, rows, lambda c: rules.modbus_fields(c))
    assert [g["fc"] for g in got] == [6, 16, 90, None, None, None]
    assert [g["access"] for g in got][1] == "WRITE" and [g["is_error"] for g in got] == [False, False, False, True, False, False]
    assert apply(spark, [502, 503, None], rules.modbus_port, "int") == [False, True, False]


def test_lateral_signals(spark):
    got = apply(spark, ["\\PIPE\\svcctl", "\\\\h\\share\\x.txt", None], lambda c: rules.lateral_signals(F.array_compact(F.array(c)), F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert got == [["pipe:svcctl (service control (PsExec))"], [], []]
    uuid = "367ABB81-9844-35F1-AD32-98F038001003"
    assert apply(spark, [f'{{"interfaces":[{{"uuid":"{uuid}"}}],"uuid":"{uuid}"}}', "{}"], rules.dcerpc_interfaces) == [[uuid.lower()], []]


def test_alerts_and_notices(spark):
    hit = lambda s, v, m: rules.is_threat_alert(F.lit(s), F.lit(v), F.lit(m))
    row = spark.range(1).select(hit("ET MALWARE", "1", None), hit("ET INFO", "1", None), hit("ET X", "3", "Major"), hit("ET X", "3", None), hit("ET X", "high", "critical"), hit(None, "2", None)).first()
    assert tuple(row) == (True, False, True, False, False, True)
    assert apply(spark, ["Intel::Notice", "Scan::New", "Odd"], rules.notice_class) == [("c2", 8), ("recon", 5), ("malware", 6)]
    assert apply(spark, ["CaptureLoss::X", "CaptureLossy", "Software"], rules.is_operational_notice) == [True, False, True]


def test_identities(spark):
    import hashlib

    want = int(hashlib.sha1(b"a||3").hexdigest()[:15], 16) % 10**10
    assert spark.range(1).select(ids.stable_number(F.lit("a"), F.lit(None), F.lit(3))).first()[0] == want


def test_cef_escaping(spark):
    assert apply(spark, ["a|b\\c", None], text.cef_header) == ["a\\|b\\\\c", ""]
    assert apply(spark, ["a=b\\\nc"], text.cef_value) == ["a\\=b\\\\\\nc"]
    assert apply(spark, ["HTTP://U:p@Ex.ORG:80/Path?Q#F", "not a url", "https://[2001:DB8::1]/X"], text.canonical_url) == ["http://U:p@ex.org:80/Path?Q#F", "not a url", "https://[2001:db8::1]/X"]
