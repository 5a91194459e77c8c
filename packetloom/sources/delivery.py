"""Durable delivery: every record is an obligation that ends as delivered or dead-lettered, over failures and restarts.

A batch is written down before anything is sent, and what its receiver said to each chunk before the next chunk is
sent. What a repeated batch finds settled it does not send again; a crash can repeat the one chunk that a task had in
flight, whose outcome nobody knows, and no other. Rejected rows alone are tried again, with growing pauses; those that
stay rejected go to the dead letters, with their payload, before the ledger says so. Below one folder, that driver
and executors share, lie

    records/batch=N     what a batch owes: obligation, value
    outcomes/...        per chunk: obligation, outcome, error, attempt, worker, at
    dead/batch=N        what was given up: obligation, value, error
    ledger/gen=N        outcomes, compacted

The ledger is read as a table: of what was said on an obligation a delivery counts first, then that it was given up.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What a receiver says to the values of one chunk: for each an error, or None where it accepted.
Post = Callable[[list[str]], list[str | None]]
OUTCOME = "obligation string, outcome string, error string, attempt int, worker string, at double"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(file:)?/*", "file:///", path))


def _exists(path: str) -> bool:
    store, at = _open(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def http_post(url: str, body: Callable[[list[str]], str], headers: dict[str, str] | None = None, timeout: float = 30.0, read: Callable[[bytes, int], list[str | None]] | None = None) -> Post:
    """Chunks as requests. A request that fails rejects all its rows; else ``read`` says which, from the answer and the number of rows (default: none)."""
    head = {"Content-Type": "application/json", **(headers or {})}

    def post(values: list[str]) -> list[str | None]:
        with urllib.request.urlopen(urllib.request.Request(url, body(values).encode(), head), timeout=timeout) as answer:  # noqa: S310
            got = answer.read()
        return read(got, len(values)) if read is not None else [None] * len(values)

    return post


def bulk_errors(answer: bytes, n: int) -> list[str | None]:
    """The errors of a bulk request, item by item: a request can succeed while some of its documents are refused."""
    items = json.loads(answer).get("items", [])
    if len(items) != n:
        return [f"{len(items)} of {n} items answered"] * n
    said = [next(iter(i.values())) for i in items]
    return [None if 200 <= int(s.get("status", 0)) < 300 else json.dumps(s.get("error") or s.get("status")) for s in said]


def _sender(post: Post, folder: str, attempt: int, worker: str, most: int):
    """A partition's chunks: sends each and writes down what became of it, in a file of its own, before the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        for frame in frames:
            for first in range(0, len(frame), most):
                part = frame.iloc[first : first + most]
                try:
                    errors = post(part["value"].tolist())
                except Exception as e:  # the receiver did not answer: all of it is unresolved
                    errors = [f"{type(e).__name__}: {e}"] * len(part)
                now = time.time()
                lines = [
                    json.dumps({"obligation": o, "outcome": "delivered" if e is None else "failed", "error": e, "attempt": attempt, "worker": worker, "at": now})
                    for o, e in zip(part["obligation"], errors, strict=True)
                ]
                name = f"{at}/{uuid.uuid4().hex}"
                with store.open_output_stream(f"{name}.tmp") as out:
                    out.write(("\n".join(lines) + "\n").encode())
                store.move(f"{name}.tmp", f"{name}.json")  # whole or not at all
                yield pd.DataFrame({"obligation": part["obligation"], "value": part["value"], "error": errors})

    return run


class Delivery:
    """A writer for foreachBatch (or a batch's own use) that delivers to one sink, see the module.

    ``key``: the columns that name an obligation; ``value``: a column of texts, or all columns as JSON. ``retries``
    attempts follow the first, after pauses of ``backoff`` seconds, doubled each time.
    """

    def __init__(self, path: str, post: Post, key: list[str], value: str | None = None, retries: int = 5, backoff: float = 1.0, chunk: int = 500, sleep: Callable[[float], None] = time.sleep):
        self.path, self.post, self.key, self.value = path.rstrip("/"), post, key, value
        self.retries, self.backoff, self.chunk, self.sleep = retries, backoff, chunk, sleep
        self.worker = uuid.uuid4().hex

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark, owed = df.sparkSession, f"{self.path}/records/batch={batch}"
        if not _exists(f"{owed}/_SUCCESS"):  # a repeated batch owes what it owed before
            self._named(df).dropDuplicates(["obligation"]).write.mode("overwrite").parquet(owed)
        self._settle(spark.read.parquet(owed), batch)

    def _named(self, df: DataFrame) -> DataFrame:
        whole = F.col(self.value) if self.value else F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
        parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in self.key]  # a null is not the empty string
        return df.select(F.to_json(F.array(*parts)).alias("obligation"), whole.alias("value"))

    def _settle(self, owed: DataFrame, batch: int | str, note: str = "") -> None:
        spark = owed.sparkSession
        settled = self.ledger(spark).filter(F.col("outcome").isin(*(("delivered",) if note else ("delivered", "dead_lettered"))))
        pending = owed.select("obligation", "value").join(settled.select("obligation"), "obligation", "left_anti")
        for attempt in range(self.retries + 1):
            tried = pending.mapInPandas(_sender(self.post, f"{self.path}/outcomes/{note or 'batch'}={batch}-{attempt}", attempt, self.worker, self.chunk), "obligation string, value string, error string")
            rejected = f"{self.path}/rejected/{note or 'batch'}={batch}-{attempt}"
            tried.filter("error IS NOT NULL").write.mode("overwrite").parquet(rejected)
            pending = spark.read.parquet(rejected)
            if pending.isEmpty():
                return
            if attempt < self.retries:
                self.sleep(self.backoff * 2**attempt)
                # a task that was run twice may have delivered what it reported as rejected
                done = self.ledger(spark).filter(F.col("outcome") == "delivered").select("obligation")
                pending = pending.select("obligation", "value").join(done, "obligation", "left_anti")
        if note:
            return
        dead = f"{self.path}/dead/batch={batch}"
        pending.write.mode("overwrite").parquet(dead)
        self._say(spark.read.parquet(dead), "dead_lettered", f"dead={batch}")

    def _say(self, rows: DataFrame, outcome: str, name: str) -> None:
        said = rows.select("obligation", F.lit(outcome).alias("outcome"), "error", F.lit(self.retries).alias("attempt"), F.lit(self.worker).alias("worker"), F.lit(time.time()).alias("at"))
        said.write.mode("overwrite").json(f"{self.path}/outcomes/{name}")

    def attempts(self, spark: SparkSession) -> DataFrame:
        """All that was said on obligations: attempts, dead letters, and what of them was compacted."""
        out = spark.createDataFrame([], OUTCOME)
        if _exists(f"{self.path}/outcomes"):
            out = out.unionByName(spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.path}/outcomes"))
        kept = self._generations()
        return out.unionByName(spark.read.schema(OUTCOME).parquet(kept[-1])) if kept else out

    def _generations(self) -> list[str]:
        if not _exists(f"{self.path}/ledger"):
            return []
        store, at = _open(f"{self.path}/ledger")
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory]
        return [f"{self.path}/ledger/{n}" for n in sorted(names, key=lambda n: int(n.split("=")[1])) if _exists(f"{self.path}/ledger/{n}/_SUCCESS")]

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Where each obligation stands: obligation, outcome (delivered, dead_lettered or failed), error, attempt, worker, at."""
        rank = F.struct(F.when(F.col("outcome") == "delivered", 2).when(F.col("outcome") == "dead_lettered", 1).otherwise(0).alias("o"), "at")
        rest = F.struct("outcome", "error", "attempt", "worker", "at")
        return self.attempts(spark).groupBy("obligation").agg(F.max_by(rest, rank).alias("r")).select("obligation", "r.*")

    def receipt(self, spark: SparkSession) -> dict[str, int]:
        """Obligations by where they stand; pending ones have been owed but neither delivered nor given up."""
        owed = spark.read.parquet(f"{self.path}/records").select("obligation").distinct() if _exists(f"{self.path}/records") else spark.createDataFrame([], "obligation string")
        stand = F.when(F.col("outcome").isin("delivered", "dead_lettered"), F.col("outcome")).otherwise("pending")
        rows = owed.join(self.ledger(spark), "obligation", "left").groupBy(stand.alias("s")).count().collect()
        return {"delivered": 0, "dead_lettered": 0, "pending": 0} | {r["s"]: r["count"] for r in rows}

    def replay(self, spark: SparkSession) -> tuple[int, int]:
        """Tries dead letters again, once: how many were delivered, and how many are still dead. Their earlier attempts stay in the ledger."""
        if not _exists(f"{self.path}/dead"):
            return 0, 0
        dead = spark.read.parquet(f"{self.path}/dead").dropDuplicates(["obligation"])
        before = dead.join(self.ledger(spark).filter("outcome = 'delivered'"), "obligation", "left_anti").count()
        if before:
            once = Delivery(self.path, self.post, self.key, self.value, 0, self.backoff, self.chunk, self.sleep)
            once._settle(dead, uuid.uuid4().hex, "replay")
        after = dead.join(self.ledger(spark).filter("outcome = 'delivered'"), "obligation", "left_anti").count()
        return before - after, after

    def compact(self, spark: SparkSession, keep_seconds: float | None = None) -> int:
        """Writes the ledger anew, a row an obligation, and drops what it was made of; of settled ones those older than ``keep_seconds``, past which no batch is repeated."""
        kept = self._generations()
        store, at = _open(f"{self.path}/outcomes")
        made_of = [i.path for i in store.get_file_info(fs.FileSelector(at))] if _exists(f"{self.path}/outcomes") else []
        rows = self.ledger(spark)
        if keep_seconds is not None:
            rows = rows.filter((F.col("at") >= time.time() - keep_seconds) | (F.col("outcome") != "delivered"))
        new = f"{self.path}/ledger/gen={int(kept[-1].split('=')[-1]) + 1 if kept else 0}"
        rows.write.mode("overwrite").parquet(new)
        for p in made_of:  # after the new one is whole; what is read twice meanwhile says the same
            store.delete_dir(p)
        for old in kept:
            s, p = _open(old)
            s.delete_dir(p)
        return spark.read.parquet(new).count()
