"""Evaluation proofs, file predicates, novelty of hot keys, state that is forgotten."""

import datetime as dt
import io
import os
import posixpath
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from packetloom.functions import files
from packetloom.operators import novelty, proofs as ops
from packetloom.streaming import proofs, stateful

BASE = dt.datetime(2024, 1, 1)


def test_coverage_tells_evaluated_behind_missing_and_idle(spark):
    acks = spark.createDataFrame([("s", 0, 0, 100, 10, 5), ("s", 0, 0, 130, 10, 7), ("s", 0, 1, 140, 10, 3), ("s", 1, 0, 120, 30, 1)], "service string, part long, batch long, evaluated_at long, horizon long, records long")
    inputs = spark.createDataFrame([("s", 0, 120), ("s", 0, 130), ("s", 1, 95), ("s", 2, 5)], "service string, part long, at long")
    expected = spark.createDataFrame([("s", i) for i in range(4)] * 2, "service string, part long")
    got = {r.part: (r.verdict, r.behind, r.records) for r in ops.coverage(acks, inputs, expected).collect()}
    assert got == {0: ("evaluated", 0, 10), 1: ("behind", 5, 1), 2: ("missing", None, None), 3: ("idle", None, None)}
    none = acks.limit(0)
    assert {r.verdict for r in ops.coverage(none, inputs.limit(0), expected).collect()} == {"idle"} and ops.batch_gaps(none).collect() == []


def test_window_proofs_are_the_first_sufficient_evaluation(spark):
    acks = spark.createDataFrame([("s", 0, 100, 10), ("s", 0, 105, 40), ("s", 0, 200, 10), ("s", 1, 999, 0)], "service string, part long, evaluated_at long, horizon long")
    windows = spark.createDataFrame([("s", 0, u) for u in (60, 65, 90, 91, 190, 191)], "service string, part long, until long").withColumn("note", F.lit("kept"))
    got = {r.until: r.evaluated_at for r in ops.window_proofs(windows, acks).collect()}
    assert got == {60: 100.0, 65: 100.0, 90: 100.0, 91: 200.0, 190: 200.0, 191: None}
    assert ops.window_proofs(windows, acks).columns == ["service", "part", "until", "note", "evaluated_at"]


def staged(spark, tmp_path, rows, schema):
    """A stream of one file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{i}"))
    for i in range(len(rows)):
        for f in sorted((tmp_path / "in" / f"{i}").glob("*.json")):
            (tmp_path / "flat").mkdir(exist_ok=True)
            target = tmp_path / "flat" / f"{i}.json"
            shutil.copy(f, target)
            os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "flat"))


def test_a_stream_proves_its_batches_and_a_lost_one_is_a_gap(spark, tmp_path):
    rows = [[(p, BASE + dt.timedelta(seconds=10 * b + p)) for p in range(2 if b else 1)] for b in range(3)]
    stream = staged(spark, tmp_path, rows, "partition long, event_time timestamp")
    wrote, times = [], iter([100.0, 110.0, 120.0])
    writer = proofs.proving(lambda df, b: wrote.append((b, df.count())), "svc", str(tmp_path / "acks"), 5, clock=lambda: next(times))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(writer).trigger(availableNow=True).start().awaitTermination()
    acks = proofs.acknowledged(spark, str(tmp_path / "acks"))
    assert wrote == [(0, 1), (1, 2), (2, 2)]
    assert sorted((r.batch, r.part, r.records, r.evaluated_at) for r in acks.collect()) == [(0, -1, 1, 100.0), (0, 0, 1, 100.0), (1, -1, 2, 110.0), (1, 0, 1, 110.0), (1, 1, 1, 110.0), (2, -1, 2, 120.0), (2, 0, 1, 120.0), (2, 1, 1, 120.0)]
    assert ops.batch_gaps(acks).collect() == []
    shutil.rmtree(tmp_path / "acks" / "svc" / "b1")
    acks = proofs.acknowledged(spark, str(tmp_path / "acks"))
    assert [tuple(r) for r in ops.batch_gaps(acks).collect()] == [("svc", 1, 1)]
    times = iter([130.0])
    writer(spark.createDataFrame(rows[1], "partition long, event_time timestamp"), 1)
    assert ops.batch_gaps(proofs.acknowledged(spark, str(tmp_path / "acks"))).collect() == []


def test_members_and_windows_are_forgotten(spark, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    rows = [[("k", "a", at(0)), ("k", "b", at(1))], [("z", "z", at(500))], [("k", "a", at(1000)), ("k", "b", at(1001))], [("z", "z", at(2000))]]
    spark.conf.set(*next(iter(stateful.STATE.items())))
    stream = staged(spark, tmp_path, rows, "key string, member string, event_time timestamp")
    out = []
    q = stateful.first_seen_ranks(stream, 1, "1 seconds", keep=100).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, b: out.extend(df.collect()))
    q.trigger(availableNow=True).start().awaitTermination()
    assert [(r.key, r.member, r["rank"]) for r in sorted(out, key=lambda r: r.first_seen)] == [("k", "b", 1), ("k", "b", 1)]


def plain_rare(rows, least, forget):
    out, shown, last = [], [], {}
    for t, v in sorted(rows):
        if v not in last or (forget is not None and t - last[v] > forget):
            if len(shown) >= least:
                out.append((v, t, len(shown)))
        if v not in shown:
            shown.append(v)
        last[v] = t
    return sorted(out)


@pytest.mark.parametrize("forget", [None, 50, 7])
def test_rare_values_equal_walking_through_the_rows(spark, forget):
    import random

    r = random.Random(forget)
    rows = sorted({(r.randint(0, 600), r.choice("abcdefghij" + "a" * 20)) for _ in range(150)})
    df = spark.createDataFrame([("t", v, BASE + dt.timedelta(seconds=t), {"x": t}) for t, v in rows] + [("t", None, BASE, None), ("t", "", BASE, None), ("t", "q", None, None)], "k string, v string, ts timestamp, more map<string,int>")
    got = novelty.rare_values(df, ["k"], "v", "ts", 3, forget)
    assert sorted((x.v, int((x.ts - BASE).total_seconds()), x.n_prior_distinct) for x in got.collect()) == plain_rare(rows, 3, forget)
    assert got.columns == ["k", "v", "ts", "more", "n_prior_distinct"]


def program(machine, sections, compiled, flags):
    return b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0" + machine.to_bytes(2, "little") + sections.to_bytes(2, "little") + compiled.to_bytes(4, "little") + bytes(10) + flags.to_bytes(2, "little")


def test_files_are_known_by_their_bytes(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a/b.txt", "hello")
    whole = program(0x8664, 5, 1_700_000_000, 0x2022)
    data = [whole, b"\x7fELF\x02", b"%PDF-1.7", made.getvalue(), b"\xff stub" + made.getvalue(), b"plain\ttext\r\n", b"", b"\x00\x01", None, whole[:70], b"MZ", b"text\x80", b"PK\x05\x06 short, but a start", b"x PK\x05\x06"]
    df = spark.createDataFrame([(i, d if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    got = df.select("i", files.kind(F.col("d")).alias("k"), files.executable(F.col("d")).alias("e"), files.is_zip(F.col("d")).alias("z")).orderBy("i").collect()
    dos, other = "application/x-dosexec", files.OTHER
    assert [r.k for r in got] == [dos, "application/x-elf", "application/pdf", "application/zip", "application/zip", "text/plain", other, other, None, dos, dos, other, "application/zip", other]
    assert [tuple(r.e) if r.e else None for r in got] == [(0x8664, 5, 1_700_000_000, True), *[None] * 13]
    assert [bool(r.z) for r in got][3:5] == [True, True]


def test_entries_that_leave_their_folder(spark):
    names = ["a/b", "../x", "a/../../x", "/etc", "a\\b", "a/../b", "", None, ".", "a//b/./c", "..", "a/..", "x/../../y/../z", "\\\\host"]
    got = [r.e for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(files.escapes(F.col("n")).alias("e")).collect()]
    outside = lambda n: not n or n.startswith("/") or "\\" in n or posixpath.normpath(n).startswith("..")
    assert got == [outside(n) for n in names]
    row = spark.createDataFrame([([("a/", 99), ("a/b", 5)],), ([("a/b", 50)],), ([("../", 1)],), ([],)], "e array<struct<name:string,size:long>>")
    assert [r.f for r in row.select(files.archive_fault(F.col("e"), 10).alias("f")).collect()] == [None, "entry exceeds size", "entry escapes root", None]
    assert row.select(files.archive_fault(F.col("e"), 10, 4).alias("f")).first().f == "archive exceeds depth"
