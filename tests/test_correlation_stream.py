"""Correlation as a stream against the batch operators at every evaluation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import findings
from packetloom.streaming import correlate, run, stateful

T0 = 1_700_006_400  # a multiple of the window below
TICK, WINDOW = 30, 600
SCHEMA = "tenant string, src_ip string, detector_id string, detector_version string, category string, severity int, arrived timestamp"
KINDS = [("beacon", "c2"), ("beacon_fqdn", "c2"), ("internal_scan", "recon"), ("exfil", "exfil"), ("slips_ml", "c2"), ("slips_ml", "recon"), ("odd", "other"), ("plain", ""), ("correlation_incident", "incident"), ("ndpi_risk", "anomaly")]


def at(seconds):
    return dt.datetime.fromtimestamp(T0 + seconds, dt.UTC).replace(tzinfo=None)


def some_findings(seed, n=90, span=1500):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        detector, category = r.choice(KINDS)
        # exactly on a tick, too
        t = r.choice([r.uniform(0, span), r.randrange(span // TICK) * TICK])
        rows.append(("t", f"10.0.0.{r.randrange(3)}", detector, r.choice([None, "2.0"]), category, r.choice([None, 0, 2, 4, 9]), at(round(t, 3))))
    return rows + rows[:6]  # repeated


@pytest.fixture
def rocks(spark):
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.STATE:
        spark.conf.unset(k)


def streamed(spark, tmp_path, batches, **how):
    """What a stream tells of batches handed in one by one, over restarts; and rows of state at the end."""
    src, out = tmp_path / "in", []
    src.mkdir(parents=True)
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    made = correlate.correlated(read, seconds=WINDOW, tick=TICK, lateness="30 seconds", **how)
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        q = run.start(made, lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"))
        assert q.awaitTermination(120) is not False
        if q.exception():
            raise q.exception()
    return out, q.lastProgress


def batch_told(spark, rows, rules, until):
    """Evaluations at every tick by the batch operators, each thing told once per window number."""
    frame = spark.createDataFrame(rows, SCHEMA).filter("NOT (detector_id = 'ndpi_risk' AND detector_version <=> '2.0')").withColumnRenamed("arrived", "ts")
    frame = frame.withColumn("severity", F.coalesce("severity", F.lit(0))).cache()
    told, out, key = set(), [], ["tenant", "src_ip"]
    for now in range(TICK, until + 1, TICK):
        recent = frame.filter((F.col("ts") > F.lit(at(now - WINDOW))) & (F.col("ts") <= F.lit(at(now))))
        bucket = (T0 + now) // WINDOW
        for r in findings.incidents(recent, key, F.lit(at(now)), rules.risk, rules.min_tactics, rules.half_life).collect():
            if (r.src_ip, bucket, r.reason) not in told:
                told.add((r.src_ip, bucket, r.reason))
                out.append((r.src_ip, now, r.reason, "incident", r.severity, round(r.risk, 2), r.n_findings, r.n_tactics))
        for r in findings.corroborations(recent, key, rules.ml).collect():
            if (r.src_ip, bucket, r.category) not in told:
                told.add((r.src_ip, bucket, r.category))
                out.append((r.src_ip, now, "corroboration", r.category, r.severity, tuple(r.detectors)))
    frame.unpersist()
    return sorted(map(repr, out))


def told_rows(out):
    rows = []
    for r in out:
        now = round((r.evaluated_at - at(0)).total_seconds())
        rows.append((r.src_ip, now, r.reason, r.category, r.severity, *((tuple(r.detectors),) if r.reason == "corroboration" else (round(r.risk, 2), r.n_findings, r.n_tactics))))
    return sorted(map(repr, rows))


def test_stream_tells_what_batch_tells_at_every_tick(rocks, tmp_path):
    rules = correlate.Rules(risk=9.0, half_life=300.0)
    rows = sorted(some_findings(4), key=lambda r: r[-1])
    last = ("t", "10.9.9.9", "beacon", None, "c2", 1, at(9000))
    pieces = [rows[:20], rows[20:21], rows[21:70], rows[70:], [last], [(*last[:-1], at(9001))]]
    # a batch is out of order in itself
    out, progress = streamed(rocks, tmp_path, [random.Random(1).sample(p, len(p)) for p in pieces], rules=rules)
    assert told_rows([r for r in out if r.src_ip != "10.9.9.9"]) == batch_told(rocks, rows, rules, 2700)
    assert len({r.finding_id for r in out}) == len(out) > 8 and {"kill-chain", "corroboration"} <= {r.reason for r in out}
    # all but the last entity's state is gone: its two findings share a slot or have one each
    assert sum(s["numRowsTotal"] for s in map(lambda s: __import__("json").loads(s.json), progress.stateOperators)) <= 12


def test_stream_does_not_depend_on_batches(rocks, tmp_path):
    rows = sorted(some_findings(9, 40, 700), key=lambda r: r[-1])
    end = [[("t", "x", "beacon", None, "c2", 1, at(9000))], [("t", "x", "beacon", None, "c2", 1, at(9001))]]
    one, _ = streamed(rocks, tmp_path / "a", [rows, *end])
    many, _ = streamed(rocks, tmp_path / "b", [rows[:7], rows[7:19], rows[19:], *end])
    assert sorted(r.finding_id for r in one) == sorted(r.finding_id for r in many) and told_rows(one) == told_rows(many)


def test_decisions_without_findings_or_stages():
    assert correlate.decide({}, 0, correlate.Rules()) == []
    slot = lambda s, t: correlate.Slot(1, s, t, t, t)
    # a falling order of stages is no chain; equal times go by stage
    down = correlate.decide({(1, "a", "exfil"): slot(3, 5), (1, "b", "recon"): slot(3, 6)}, 0, correlate.Rules())
    assert [x["reason"] for x in down] == ["multi-tactic"]
    level = correlate.decide({(1, "a", "exfil"): slot(3, 5), (1, "b", "recon"): slot(3, 5)}, 0, correlate.Rules())
    assert [(x["reason"], x["severity"]) for x in level] == [("kill-chain", 5)]
    with pytest.raises(ValueError):
        correlate.Correlator(correlate.Rules(), 100, 30)
