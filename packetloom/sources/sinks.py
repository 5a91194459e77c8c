"""Where findings go: files, Kafka, HTTP collectors, syslog; batch writers and foreachBatch functions.

Network sinks post from the executors, one connection a partition, in bounded batches; a failed
batch fails its task, so that the checkpoint is not advanced past findings that were not accepted.
"""

from __future__ import annotations

import socket
import ssl
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Writer = Callable[[DataFrame, int], None]


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON column, fields in alphabetical order."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias(name))


def to_parquet(path: str, by: list[str] = ()) -> Writer:
    """Appends to a Parquet table; a batch has a folder of its own, so a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")

    return write


def to_jsonl(path: str, most_rows: int = 1_000_000) -> Writer:
    def write(df: DataFrame, batch: int) -> None:
        as_json(df).write.mode("overwrite").option("maxRecordsPerFile", most_rows).text(f"{path}/batch={batch}")

    return write


def kafka_rows(df: DataFrame, key: tuple[str, str] = ("tenant", "entity")) -> DataFrame:
    """key (tenant|entity) and value (JSON) of each finding."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("key"), whole.alias("value"))


def to_kafka(servers: str, topic: str) -> Writer:
    def write(df: DataFrame, batch: int) -> None:
        options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.compression.type": "lz4", "kafka.linger.ms": "10"}
        kafka_rows(df).write.format("kafka").options(**options).save()

    return write


def _chunks(rows, most: int):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _post(url: str, headers: dict[str, str], body: bytes, accepted: Callable[[bytes], bool] | None, timeout: float) -> None:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:  # noqa: S310
        got = answer.read()
    if accepted is not None and not accepted(got):
        raise OSError(f"{url} did not accept all of a batch")


def to_http(url: str, body: Callable[[list[str]], str], headers: dict[str, str] | None = None, accepted: Callable[[bytes], bool] | None = None, most: int = 500, timeout: float = 30.0) -> Writer:
    """Posts findings as JSON texts in batches; ``body`` makes a request's body of them."""
    head = {"Content-Type": "application/json", **(headers or {})}

    def send(rows) -> None:
        for part in _chunks((r["value"] for r in rows), most):
            _post(url, head, body(part).encode(), accepted, timeout)

    return lambda df, batch: as_json(df).foreachPartition(send)


def to_webhook(url: str, **how) -> Writer:
    return to_http(url, lambda rows: "[" + ",".join(rows) + "]", **how)


def to_splunk(url: str, token: str, **how) -> Writer:
    return to_http(url, lambda rows: "\n".join('{"event":' + r + "}" for r in rows), {"Authorization": f"Splunk {token}"}, **how)


def bulk_lines(df: DataFrame, index: str) -> DataFrame:
    """Findings as pairs of lines for a bulk request; the document id holds tenant, finding and revision, so replays overwrite."""
    ident = F.concat_ws(":", *[F.col(c).cast("string") for c in ("tenant_id", "finding_id", "revision")])
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), ident.alias("_id")).alias("index")))
    return df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).alias("value"))


def to_elastic(url: str, index: str, most: int = 500, timeout: float = 30.0) -> Writer:
    """Bulk indexing; a response with errors for any document fails the batch."""

    def send(rows) -> None:
        for part in _chunks((r["value"] for r in rows), most):
            _post(f"{url}/_bulk", {"Content-Type": "application/x-ndjson"}, ("\n".join(part) + "\n").encode(), lambda got: b'"errors":true' not in got.replace(b" ", b""), timeout)

    return lambda df, batch: bulk_lines(df, index).foreachPartition(send)


def syslog_frame(line: str, host: str = "packetloom", tag: str = "", priority: int = 134) -> bytes:
    """A line framed by its length (RFC 6587), with a header without time (RFC 5424 nil values)."""
    body = f"<{priority}>1 - {host} {tag or 'packetloom'} - - - {line}".encode()
    return str(len(body)).encode() + b" " + body


def to_syslog(host: str, port: int, column: str = "cef", tag: str = "", tls: bool = False, timeout: float = 30.0) -> Writer:
    """Lines of a column over TCP or TLS; a tag names the table at collectors that route by it."""

    def send(rows) -> None:
        with socket.create_connection((host, port), timeout) as plain:
            out = ssl.create_default_context().wrap_socket(plain, server_hostname=host) if tls else plain
            for r in rows:
                out.sendall(syslog_frame(r["value"], tag=tag))

    return lambda df, batch: df.select(F.col(column).alias("value")).foreachPartition(send)


def fan_out(*writers: Writer) -> Writer:
    """All writers on one cached batch; each is tried, and the errors of all are raised together."""

    def write(df: DataFrame, batch: int) -> None:
        held, errors = df.persist(), []
        try:
            for w in writers:
                try:
                    w(held, batch)
                except Exception as e:  # every sink gets its chance before the batch fails
                    errors.append(e)
        finally:
            held.unpersist()
        if errors:
            raise ExceptionGroup("sinks failed", errors)

    return write
