"""Rotating files and paged collections: each line and object once, over rotations, refusals and restarts."""

import json
import os
import shutil
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from packetloom.sources import feeds, follow, taxii


class Followed:
    """A log folder and a query over it that is stopped and started anew for every look."""

    def __init__(self, spark, tmp, **how):
        self.spark, self.log, self.state, self.out, self.how = spark, tmp / "log", str(tmp / "state"), str(tmp / "out"), how
        self.log.mkdir()

    def write(self, text, name="alerts.json", mode="a"):
        with open(self.log / name, mode) as f:
            f.write(text)

    def look(self):
        rows = follow.lines(self.spark, str(self.log), "alerts.json", **self.how)
        q = rows.writeStream.format("parquet").option("checkpointLocation", self.state).option("path", self.out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in self.spark.read.parquet(self.out).collect())


def numbered(a, b):
    return "".join(f"line {i:04d}\n" for i in range(a, b))


def wanted(n):
    return [f"line {i:04d}" for i in range(n)]


def test_lines_once_over_renames_and_restarts(spark, tmp_path):
    f = Followed(spark, tmp_path, split=50)
    f.write(numbered(0, 10) + "line 00")
    assert f.look() == wanted(10)  # half a line waits
    f.write("10\n" + numbered(11, 15))
    os.rename(f.log / "alerts.json", f.log / "alerts.json.1")
    f.write(numbered(15, 20))
    assert f.look() == wanted(20)
    os.rename(f.log / "alerts.json.1", f.log / "alerts.json.2")
    os.rename(f.log / "alerts.json", f.log / "alerts.json.1")
    f.write(numbered(20, 21))
    assert f.look() == wanted(21)
    assert f.look() == wanted(21)
    os.remove(f.log / "alerts.json.2")
    f.write(numbered(21, 24))
    assert f.look() == wanted(24)


def test_copied_and_truncated(spark, tmp_path):
    f = Followed(spark, tmp_path)
    f.write(numbered(0, 10))
    assert f.look() == wanted(10)
    f.write(numbered(10, 12))
    shutil.copy(f.log / "alerts.json", f.log / "alerts.json-1")
    f.write(numbered(12, 14), mode="w")
    assert f.look() == wanted(14)


def test_two_files_that_begin_alike_are_two(spark, tmp_path):
    f = Followed(spark, tmp_path)
    f.write("[\n")
    assert f.look() == ["["]
    f.write("[\nb\n", "alerts.json.1")
    f.write("a\n")
    assert f.look() == ["[", "[", "a", "b"]


def test_other_names_and_missing_folders(spark, tmp_path):
    f = Followed(spark, tmp_path)
    f.write("x\n", "alerts.jsonl")
    f.write("x\n", "alerts.json.1.gz")
    assert follow.RotatingReader({"path": str(f.log), "name": "alerts.json"}).latestOffset() == {}
    assert follow.RotatingReader({"path": str(tmp_path / "no"), "name": "alerts.json"}).latestOffset() == {}


def test_planned_lines_that_are_gone_are_an_error(tmp_path):
    log = tmp_path / "alerts.json"
    log.write_text(numbered(0, 10))
    reader = follow.RotatingReader({"path": str(tmp_path), "name": "alerts.json"})
    end = reader.latestOffset()
    log.write_text("new\n")
    with pytest.raises(follow.LinesLost):
        reader.partitions({}, end)
    assert follow.RotatingReader({"path": str(tmp_path), "name": "alerts.json", "failondataloss": "false"}).partitions({}, end) == []


@pytest.mark.parametrize("split", [1, 7, 10, 1000])
def test_spans_share_no_line(tmp_path, split):
    (tmp_path / "alerts.json").write_text("a\n\nlonger line é\r\nb\n" * 5 + "half")
    reader = follow.RotatingReader({"path": str(tmp_path), "name": "alerts.json", "splitbytes": str(split)})
    spans = reader.partitions({}, reader.latestOffset())
    got = [v for s in spans for v, _, _ in reader.read(s)]
    assert got == ["a", "", "longer line é", "b"] * 5


def test_records_of_either_framing(spark):
    rows = spark.createDataFrame([("[",), ('{"a": 1},',), (' {"a": 2} , ',), ("]",), ("",), ("{broken}",), ("7",), (None,), ('{"a": 3}',)], "value string")
    assert sorted(json.loads(r.value)["a"] for r in follow.records(rows).collect()) == [1, 2, 3]


class Server:
    """A collection behind a local server; ``fail`` refuses so many requests first."""

    def __init__(self, page):
        self.objects, self.page, self.fail, self.stuck, self.asked, self.forgotten = [], page, 0, False, [], set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.asked.append(q)
                status, doc, last = outer.answer(q)
                self.send_response(status)
                if last:
                    self.send_header("X-TAXII-Date-Added-Last", last)
                self.end_headers()
                self.wfile.write(json.dumps(doc).encode())

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/api/collections/c/objects/"

    def add(self, *names):
        for n in names:
            at = f"2024-01-01T00:00:{len(self.objects):02d}.000000Z"
            self.objects.append((at, {"type": "indicator", "id": f"indicator--{n}", "pattern": f"[domain-name:value = '{n}.example']", "valid_from": "2024-01-01T00:00:00Z"}))

    def answer(self, q):
        if self.fail:
            self.fail -= 1
            return 503, {}, None
        if q.get("next") in self.forgotten:
            return 404, {}, None
        found = [o for o in self.objects if o[0] > q.get("added_after", "")]
        if "next" in q:
            found = [o for o in found if o[0] > q["next"]]
        page, more = found[: self.page], len(found) > self.page
        doc = {"objects": [o for _, o in page]} if page else {}
        if more:
            doc |= {"more": True} | ({} if self.stuck else {"next": page[-1][0]})
        return 200, doc, page[-1][0] if page else None


@pytest.fixture
def server():
    s = Server(2)
    yield s
    s.http.shutdown()
    s.http.server_close()


def test_all_pages_of_collections(spark, server):
    server.add(*"abcde")
    server.fail = 2
    other = Server(10)
    other.add("z", "a")
    got = taxii.objects(spark, [server.url, other.url], wait=0.01)
    assert got.rdd.getNumPartitions() == 2
    found = feeds.stix_indicators(got.cache())
    # an object that two collections hold is one
    assert sorted(r.indicator for r in found.collect()) == [f"{c}.example" for c in "abcdez"]
    assert got.count() == 7
    got.unpersist()


def test_unfinished_fetches_are_errors(server):
    server.add(*"abcde")
    one = {"url": server.url, "wait": "0.01", "tries": "2"}
    for more in ({"maxpages": "2"}, {"stuck": True}, {"fail": 2}):
        server.stuck, server.fail = more.pop("stuck", False), more.pop("fail", 0)
        with pytest.raises(taxii.FetchIncomplete):
            list(taxii.Reader(one | more).read(taxii.Collection(server.url)))
    server.stuck = False
    assert len(list(taxii.Reader(one | {"maxpages": "3"}).read(taxii.Collection(server.url)))) == 5


def test_empty_collection(spark, server):
    assert taxii.objects(spark, [server.url]).count() == 0


def walked(reader, offset, looks):
    got = []
    for _ in range(looks):
        rows, offset = reader.read(offset)
        got += [r[2].removeprefix("indicator--") for r in rows]
    return got, offset


def test_stream_walks_go_on_where_they_ended(server):
    reader = taxii.StreamReader({"url": server.url, "wait": "0.01"})
    server.add(*"abcde")
    got, place = walked(reader, reader.initialOffset(), 3)
    assert got == list("abcde") and place["next"] is None
    server.add(*"fgh")
    first, middle = walked(taxii.StreamReader({"url": server.url}), place, 1)
    assert first == ["f", "g"]
    # a batch that is repeated asks for the same page
    assert [r[2] for r in reader.readBetweenOffsets(place, middle)] == ["indicator--f", "indicator--g"]
    rest, end = walked(reader, middle, 2)
    assert rest == ["h"] and end["next"] is None
    # one that holds several, for all of them, over walks too
    assert [r[2].removeprefix("indicator--") for r in reader.readBetweenOffsets(reader.initialOffset(), end)] == list("abcdefgh")
    assert [r[2].removeprefix("indicator--") for r in reader.readBetweenOffsets(reader.initialOffset(), middle)][-1] == "h"


def test_stream_starts_a_walk_again_when_its_token_is_forgotten(server):
    reader = taxii.StreamReader({"url": server.url, "wait": "0.01"})
    server.add(*"abcd")
    _, middle = walked(reader, reader.initialOffset(), 1)
    server.forgotten.add(middle["next"])
    again, _ = walked(reader, middle, 1)
    assert again == ["a", "b"]  # twice, but nothing is left out


def test_stream_of_objects_over_restarts(spark, server, tmp_path):
    def look(n):
        q = taxii.stream_objects(spark, server.url, wait=0.01).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).option("path", str(tmp_path / "o")).start()
        try:
            for _ in range(120):
                if spark.read.schema("id string").parquet(str(tmp_path / "o")).count() >= n if (tmp_path / "o" / "_spark_metadata").exists() else False:
                    break
                q.exception() and pytest.fail(str(q.exception()))
                threading.Event().wait(0.25)
        finally:
            q.stop()
        return sorted(r.id.removeprefix("indicator--") for r in spark.read.parquet(str(tmp_path / "o")).collect())

    server.add(*"abc")
    assert look(3) == list("abc")
    server.add(*"defg")
    assert look(7) == list("abcdefg")
