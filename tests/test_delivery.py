"""Durable delivery against a local receiver that fails, refuses and kills."""

import json
import os
import signal
import subprocess
import sys
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from packetloom.sources import delivery, sinks
from packetloom.streaming import run


class Receiver:
    """Accepts rows by id; ``how`` decides on each request: an HTTP status, or the ids it refuses."""

    def __init__(self, how):
        self.accepted, self.seen, self.requests, self.how, self.lock = Counter(), Counter(), 0, how, threading.Lock()
        me = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with me.lock:
                    me.requests += 1
                    me.seen.update(r["id"] for r in rows)
                    say = me.how(me, rows)
                    items = []
                    if say == 200 or isinstance(say, set):
                        refused = say if isinstance(say, set) else set()
                        me.accepted.update(r["id"] for r in rows if r["id"] not in refused)
                        items = [{"index": {"status": 400, "error": "no"} if r["id"] in refused else {"status": 201}} for r in rows]
                if say is None:
                    return  # no answer
                self.send_response(say if isinstance(say, int) else 200)
                self.end_headers()
                self.wfile.write(json.dumps({"items": items}).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server.server_port}/"


@pytest.fixture
def receive():
    made = []

    def make(how):
        made.append(Receiver(how))
        return made[-1]

    yield make
    for r in made:
        r.server.shutdown()


def post(url):
    return delivery.http_post(url, lambda rows: "[" + ",".join(rows) + "]", read=delivery.bulk_errors)


def frame(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id int, text string").repartition(3)


def test_failures_are_tried_again_and_refusals_become_dead_letters(spark, tmp_path, receive):
    r = receive(lambda me, rows: 503 if me.requests <= 2 else {7, 8})
    pauses = []
    out = delivery.Delivery(str(tmp_path / "d"), post(r.url), ["id"], retries=3, backoff=0.5, chunk=4, sleep=pauses.append)
    out(frame(spark, [*range(20), 3, 3]), 0)
    assert r.accepted == {i: 1 for i in range(20) if i not in (7, 8)}
    assert pauses == [0.5, 1.0, 2.0] and out.receipt(spark) == {"delivered": 18, "dead_lettered": 2, "pending": 0}
    dead = spark.read.parquet(str(tmp_path / "d" / "dead")).collect()
    assert {json.loads(x.value)["id"] for x in dead} == {7, 8} and all(x.error for x in dead)
    # the same batch again, and another with some of the same rows: nothing is sent twice
    before = r.requests
    out(frame(spark, range(20)), 0)
    assert r.requests == before
    out(frame(spark, [5, 6, 7, 21, 22]), 1)
    assert r.accepted[21] == r.accepted[22] == 1 and max(r.accepted.values()) == 1 and r.seen[7] == 4
    # replay: one of the two is taken now
    r.how = lambda me, rows: {8}
    assert out.replay(spark) == (1, 1) and out.replay(spark) == (0, 1)
    assert r.accepted[7] == 1 and out.receipt(spark) == {"delivered": 21, "dead_lettered": 1, "pending": 0}
    said = out.attempts(spark).filter("obligation LIKE '%=7%'").collect()
    assert {x.outcome for x in said} == {"failed", "dead_lettered", "delivered"}


def test_compaction_keeps_what_a_replay_needs(spark, tmp_path, receive):
    r = receive(lambda me, rows: {1})
    out = delivery.Delivery(str(tmp_path / "d"), post(r.url), ["id"], retries=0, sleep=lambda s: None)
    out(frame(spark, range(10)), 0)
    was = {(x.obligation, x.outcome) for x in out.ledger(spark).collect()}
    assert out.compact(spark) == 10 and {(x.obligation, x.outcome) for x in out.ledger(spark).collect()} == was
    assert out.attempts(spark).count() == 10
    before = r.requests
    out(frame(spark, range(10)), 0)
    out(frame(spark, range(10)), 7)
    assert r.requests == before
    assert out.compact(spark, keep_seconds=-1) == 1  # what is not delivered stays
    r.how = lambda me, rows: 200
    assert out.replay(spark) == (1, 0)


def test_keys_with_nulls_and_empty_batches(spark, tmp_path, receive):
    r = receive(lambda me, rows: 200)
    out = delivery.Delivery(str(tmp_path / "d"), post(r.url), ["tenant", "id"], sleep=lambda s: None)
    rows = spark.createDataFrame([(None, 1), ("", 1), ("a", 1), ("a", None), (None, None)], "tenant string, id int").selectExpr("tenant", "id")
    out(rows.filter("false"), 0)
    assert r.requests == 0 and out.receipt(spark) == {"delivered": 0, "dead_lettered": 0, "pending": 0}
    odd = delivery.Delivery(str(tmp_path / "e"), lambda values: [None] * len(values), ["tenant", "id"], sleep=lambda s: None)
    odd(rows, 0)
    assert odd.receipt(spark)["delivered"] == 5


def test_a_crash_between_attempts_loses_and_repeats_nothing(spark, tmp_path, receive):
    r = receive(lambda me, rows: {x["id"] for x in rows if x["id"] % 3 == 0} if me.requests < 9 else 200)
    (tmp_path / "in").mkdir()
    frame(spark, range(30)).write.mode("overwrite").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))

    def crash(seconds):
        raise KeyError("gone")

    make = lambda sleep: delivery.Delivery(str(tmp_path / "d"), post(r.url), ["id"], chunk=4, sleep=sleep)
    q = run.start(read, make(crash), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="gone"):
        q.awaitTermination(120)
    assert make(None).receipt(spark) == {"delivered": 20, "dead_lettered": 0, "pending": 10}
    run.start(read, sinks.fan_out(make(lambda s: None)), str(tmp_path / "cp")).awaitTermination(120)
    assert r.accepted == {i: 1 for i in range(30)} and make(None).receipt(spark)["delivered"] == 30
    assert all(r.seen[i] == 1 for i in range(30) if i % 3)


VICTIM = """
import sys
from packetloom.session import session
from packetloom.sources import delivery
from packetloom.streaming import run
url, folder = sys.argv[1:]
spark = session("local[1]", **{"spark.ui.enabled": "false"})
post = delivery.http_post(url, lambda rows: "[" + ",".join(rows) + "]", read=delivery.bulk_errors)
read = spark.readStream.schema("id int, text string").parquet(folder + "/in")
run.start(read, delivery.Delivery(folder + "/d", post, ["id"], chunk=3), folder + "/cp").awaitTermination(120)
"""


def test_a_killed_driver_sends_no_settled_row_again(spark, tmp_path, receive):
    (tmp_path / "in").mkdir()
    frame(spark, range(30)).write.mode("overwrite").parquet(str(tmp_path / "in"))
    victim, down = [], []

    def kill(me, rows):
        if me.requests == 5:  # in the middle of the batch, before this request is taken
            os.killpg(victim[0].pid, signal.SIGKILL)
            down.append(True)
        return None if down else 200  # a worker that outlives its driver gets no answer either

    r = receive(kill)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.getcwd(), os.environ.get("PYTHONPATH", "")])}
    victim.append(subprocess.Popen([sys.executable, "-c", VICTIM, r.url, str(tmp_path)], env=env, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL))
    assert victim[0].wait(120) == -signal.SIGKILL and sum(r.accepted.values()) == 12
    time.sleep(3)
    down.clear()
    out = delivery.Delivery(str(tmp_path / "d"), post(r.url), ["id"], chunk=3)
    assert out.receipt(spark) == {"delivered": 12, "dead_lettered": 0, "pending": 18}
    read = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    run.start(read, out, str(tmp_path / "cp")).awaitTermination(120)
    assert r.accepted == {i: 1 for i in range(30)} and out.receipt(spark)["delivered"] == 30
