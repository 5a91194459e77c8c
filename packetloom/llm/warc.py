"""Deterministic sharded WARC writer and reader.

Writing: records are range-sorted by page_id into shards whose bounds depend on the pages alone
(byte counts per page_id range, refined where a range is heavy), not on sampling. Rows of one page_id
that exceed a shard are dealt to several by payload digest, and so are rows without a page_id. A shard's
task streams its records in order into gzip members, one a record, and rolls to the next file when the
compressed size passes a limit. Every header is made anew: record ids and dates come from the
content, digests and lengths from the payload. Every file starts with a warcinfo record; a response holds
an HTTP message whose body is the page. A file is written under a temporary name and
renamed when complete; a task then reports its files, and the table of all reports, the
manifest, is what commits the archive. Readers read files that the manifest names and check
their sizes, so what a lost or repeated task leaves behind is never read.

A payload of at least ``REVISIT_BYTES`` that an earlier page has is not stored again, but written
as a revisit record that names the other's record id, URI and date. Which page that is comes from an aggregate
over digests; it reaches the writer as a light row sorted right before the page, so that payloads are shuffled
only once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._store import Workspace, join_counted, small_batches

REVISIT_BYTES = 100
#: Payload bytes a shard holds at most, but for a row that repeats page_id and payload; compressed bytes after which a
#: file is rolled. A shard is a task: for very large inputs give larger shards, as there are input / SHARD_BYTES of them
#: (8 bytes each on the driver).
SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
#: Ranges looked at in one pass, and at least as many counts; FINER counts a range where there are many. The driver holds a pass's counts.
RANGES = 16_384
FINER = 16
DATE = "1970-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(file:)?/*", "file:///", path))


def shard_bounds(weight: DataFrame, limit: int, ranges: int = RANGES, heavy: list[tuple[int, int]] | None = None) -> list[int]:
    """Upper ends (inclusive) of page_id ranges of at most ``limit`` bytes, from rows (page_id, bytes).

    Ranges are counted in at most ``ranges`` equal steps; steps over the limit are counted again,
    finer, ``ranges`` of them in one pass. A row finds its range by binary search in a sorted literal, so plans
    do not grow with the number of ranges. A single page_id is not divided; those over the limit are
    added to ``heavy`` with their bytes.
    """
    low, high, total = weight.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None or (total or 0) <= limit:
        return []
    known: list[tuple[int, int, int]] = []
    todo = [(low, high)]
    while todo:
        now, todo = sorted(todo[:ranges]), todo[ranges:]
        each = max(FINER, ranges // len(now))
        steps = [max(1, -(-(b - a + 1) // each)) for a, b in now]
        row = weight.select("page_id", "bytes", _place(F.col("page_id"), [b for _, b in now]).alias("i"))
        row = row.select("page_id", "bytes", F.get(_longs([a for a, _ in now]), F.col("i")).alias("a"), F.get(_longs(steps), F.col("i")).alias("step"))
        kind = "decimal(20,0)" if high - low >= 1 << 62 else "long"  # wider than a long can count
        at = F.expr(f"cast(cast(a as {kind}) + cast((cast(page_id as {kind}) - a) div step as {kind}) * step as long)")
        for r in row.filter("page_id >= a").groupBy(at.alias("at"), "step").agg(F.sum("bytes").alias("n")).collect():
            if r["n"] > limit and r["step"] > 1:
                todo.append((r["at"], r["at"] + r["step"] - 1))
            else:
                known.append((r["at"], r["at"] + r["step"] - 1, r["n"]))
                if heavy is not None and r["n"] > limit:
                    heavy.append((r["at"], r["n"]))
    out, run = [], 0
    known.sort()
    for i, (_, _, n) in enumerate(known):
        if run and run + n > limit:
            out.append(known[i - 1][1])
            run = 0
        run += n
    return out


def _longs(values: list[int]) -> Column:
    """A literal array of longs; of one string, so that the plan stays one node."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _place(value: Column, ends: list[int]) -> Column:
    """How many of the sorted ends are below a value, by binary search in a literal."""
    if not ends:
        return F.lit(0)
    table = _longs(ends)
    span = F.struct(F.lit(0).alias("a"), F.lit(len(ends)).alias("b"))

    def halve(s, _):
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        below = F.get(table, mid) < value
        return F.when(s["a"] >= s["b"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(mid).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1)), span, halve, lambda s: s["a"])


def _uri(url: bytes | None) -> str:
    return re.sub(rb"[\r\n]+", b"", url or b"").decode("utf-8", "replace")


def _record_id(page_id: int | None, uri: str, digest: str, twin: int) -> str:
    return f"urn:sha256:{hashlib.sha256(f'{page_id}|{uri}|{digest}|{twin}'.encode()).hexdigest()}"


def _record(kind: str, record_id: str, lines: list[str], content: str, block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *lines, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_record(page_id: int | None, uri: str, digest: str, body: bytes, twin: int, first: tuple[int | None, str] | None) -> bytes:
    """A response, or with ``first`` (page_id and URI of the record that holds the payload) a revisit."""
    lines = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_record_id(*first, digest, 0)}>", f"WARC-Refers-To-Target-URI: {first[1]}", f"WARC-Refers-To-Date: {DATE}",
        ]
        if first[0] is not None:
            lines.append(f"X-Refers-To-Page-ID: {first[0]}")
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    return _record(kind, _record_id(page_id, uri, digest, twin), lines, "application/http; msgtype=response", message + (body if first is None else b""))


def _file_record(name: str) -> bytes:
    fields = b"software: packetloom\r\nformat: WARC File Format 1.1\r\n"
    return _record("warcinfo", f"urn:sha256:{hashlib.sha256(name.encode()).hexdigest()}", [f"WARC-Filename: {name}"], "application/warc-fields", fields)


class _Roller:
    """Writes one shard's records to files of about ``roll`` compressed bytes."""

    def __init__(self, folder: str, shard: int, attempt: str, roll: int):
        self.store, self.folder = _open(folder)
        self.shard, self.attempt, self.roll = shard, attempt, roll
        self.files: list[tuple[str, int, int, str]] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self._write(_file_record(self.name))
        self._write(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.folder}/{self.name}")  # replaces an equal file of an earlier attempt
            self.files.append((self.name, self.records, self.size, self.sum.hexdigest()))
            self.out = None


MANIFEST = "shard int, file string, records long, bytes long, sha256 string"


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}.tmp"
        roller, shard, decided, last, twins = None, None, None, None, 0
        done: list[tuple] = []

        def end():
            if roller is not None:
                roller.close()
                done.extend((shard, *f) for f in roller.files)

        for batch in batches:
            for s, page_id, digest, page, url, html, refers in zip(*((batch.column(c).cast(pa.binary()) if c in ("url", "html") else batch.column(c)).to_pylist() for c in ("shard", "page_id", "digest", "page", "url", "html", "refers")), strict=True):
                if s != shard:
                    end()
                    roller, shard, last = _Roller(folder, s, attempt, roll), s, None
                if not page:
                    decided = (page_id, digest, refers, _uri(url))
                    continue
                body = html or b""
                twins = twins + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                again = decided is not None and decided[:2] == last and (decided[2] != page_id or twins > 0)
                roller.add(_page_record(page_id, _uri(url), digest, body, twins, decided[2:] if again else None))
        end()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder`` and returns the manifest.

    A null html is an empty payload, a null url an empty one; line ends in a url are dropped. Payloads
    are bytes: what is no UTF-8 is stored as it is; in a url it becomes replacement characters. Of
    equal payloads of at least ``revisit_bytes``, the record with the smallest page_id holds the
    payload (a null page_id is larger than any other); where rows repeat that page_id, the one whose url
    sorts first. page_id must be a whole number. Rows with one page_id and payload lie in one shard, ordered
    by url. The archive is complete once ``folder``/manifest is.
    """
    spark = pages.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "warc-work")
    html = F.coalesce(F.col("html"), F.lit(""))
    light = ws.save(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")), "light")
    heavy: list[tuple[int, int]] = []
    bounds = shard_bounds(light.filter("page_id IS NOT NULL").select("page_id", "bytes"), shard_bytes, heavy=heavy)
    unnamed = light.filter("page_id IS NULL").agg(F.sum("bytes")).first()[0] or 0
    store, at = _open(folder)
    store.create_dir(at, recursive=True)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f")
    many = light.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(first, F.count(F.lit(1)).alias("c")).filter("c > 1")
    many = many.select("digest", "c", F.col("f.page_id").alias("refers"), F.col("f.url").alias("first_url"))
    note = join_counted(light.filter(F.col("bytes") >= revisit_bytes).select("page_id", "digest"), many, ["digest"]).distinct()
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.lit(1).alias("page"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.lit(None).cast("long").alias("refers"),
    ).unionByName(
        note.select("page_id", "digest", F.lit(0).alias("page"), F.col("first_url").alias("url"), F.lit(None).cast("string").alias("html"), "refers")
    )
    # rows without a page_id, and of page_ids over the limit, are dealt by digest to shards of their own
    shards = len(bounds) + 1
    rows = rows.withColumn("shard", _place(F.col("page_id"), bounds))
    if unnamed:
        k = -(-unnamed // shard_bytes)
        rows = rows.withColumn("shard", F.when(F.col("page_id").isNull(), shards + F.pmod(F.xxhash64("digest"), F.lit(k))).otherwise(F.col("shard")))
        shards += k
    if heavy:
        keys, counts, starts = [], [], []
        for key, n in sorted(heavy):
            keys.append(key)
            counts.append(-(-n // shard_bytes))
            starts.append(shards)
            shards += counts[-1]
        rows = rows.withColumn("at", _place(F.col("page_id"), keys))
        dealt = F.get(_longs(starts), F.col("at")) + F.pmod(F.xxhash64("digest"), F.get(_longs(counts), F.col("at")))
        rows = rows.withColumn("shard", F.when(F.get(_longs(keys), F.col("at")) == F.col("page_id"), dealt).otherwise(F.col("shard"))).drop("at")
    rows = rows.withColumn("shard", F.coalesce("shard", F.lit(0)).cast("int"))
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "page", "url")
    made = dealt.mapInArrow(_writer(folder, roll_bytes), MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    ws.drop("light")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each gzip member of an open file, one record at a time."""
    pending, more = b"", True
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending:
                if not more:
                    break
                pending = stream.read(1 << 20)
                more = bool(pending)
                continue
            parts.append(unpack.decompress(pending))
            pending = unpack.unused_data if unpack.eof else b""
        if not parts:
            return
        if not unpack.eof:
            raise ValueError("a record is cut off")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        store, at = _open(folder)
        for batch in batches:
            for name, size in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if store.get_file_info(f"{at}/{name}").size != size:
                    raise ValueError(f"{name} is not as the manifest says")
                rows, held = [], 0
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for f, block in _records(stream):
                        kind = f["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = hashlib.sha256(body).hexdigest() if kind == "response" else f["WARC-Payload-Digest"].removeprefix("sha256:")
                        if f["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, ref = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
                        rows.append((
                            None if page is None else int(page), f["WARC-Target-URI"], len(body) if kind == "response" else int(f["X-Payload-Length"]),
                            digest, kind, None if ref is None else int(ref), body if kind == "response" else None,
                        ))
                        held += len(body) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payload digests are computed from the payloads and must equal the headers'. A revisit has no
    payload of its own (null); its length and digest are those of the payload it stands for.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "bytes")
    n = manifest.count()
    return manifest.repartition(max(1, n), "file").mapInArrow(_reader(folder), RECORD)


def op1(spark, sf_dir: str) -> DataFrame:
    folder = f"{Workspace(spark, 'warc').path}/archive"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN first END AS refers_to
FROM f
"""
