"""Lines of files that grow and rotate, as a stream: each line once, across rotations and restarts.

A log that a sensor writes is renamed (or copied and truncated) when it is large, and written anew under its old
name. Spark's own file stream takes a file as a whole when it first sees it, so lines that come later are lost.

A place in a file is kept by the file's number on its disk, not by its name: a renamed file goes on where it was.
The place holds the bytes read and a digest of the file's head. A file of a known number with another head, or
shorter than its place, is a new file. One of an unknown number that begins with the head of a place whose own
file has gone or begins anew is the copy made before a truncation, and goes on from that place. Only whole lines
are read. The folder must be one that the driver and all executors mount.

The source keeps nothing between batches: places are Spark's offsets, so a restarted query begins where the last
committed batch ended, and a batch that was planned but not committed is read again, byte for byte.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "rotating_lines"
HEAD = 1024
SPLIT = 64 << 20
#: Bytes looked at in one go for the last line's end.
STEP = 1 << 16


class LinesLost(RuntimeError):
    """A batch that was planned can no longer be read whole."""


@dataclass
class Span(InputPartition):
    """Lines of one file that begin in [start, end)."""

    folder: str
    name: str
    number: int
    start: int
    end: int


def digest_of(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(size)).hexdigest()[:32]


def whole_lines(path: str, size: int) -> int:
    """Bytes of a file up to the end of its last whole line within ``size``."""
    with open(path, "rb") as f:
        end = size
        while end > 0:
            begin = max(0, end - STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def files_of(folder: str, name: str) -> dict[int, tuple[str, int]]:
    """Number, path and size of the file called ``name`` and of its rotated forms (``name`` and a dot or dash before what follows)."""
    found = {}
    try:
        entries = list(os.scandir(folder))
    except FileNotFoundError:
        return found
    for e in entries:
        rest = e.name.removeprefix(name)
        if not e.name.startswith(name) or (rest and rest[0] not in ".-") or rest.endswith((".gz", ".xz", ".zst", ".bz2")):
            continue
        try:
            if e.is_file():
                s = e.stat()
                found[s.st_ino] = (e.path, s.st_size)
        except FileNotFoundError:
            continue  # renamed meanwhile: the next look finds it
    return found


class RotatingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.name = options["path"], options["name"]
        self.strict = options.get("failondataloss", "true").lower() != "false"
        self.split = int(options.get("splitbytes", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per file number: bytes of whole lines, bytes of the head, digest of the head."""
        out = {}
        for number, (path, size) in sorted(files_of(self.folder, self.name).items()):
            try:
                end = whole_lines(path, size)
                if end:
                    head = min(end, HEAD)
                    out[str(number)] = [end, head, digest_of(path, head)]
            except FileNotFoundError:
                continue
        return out

    def begins(self, number: str, path: str, end: int, start: dict) -> int:
        """Where reading of a file begins, given the places of the batch before."""
        known = start.get(number)
        if known and known[0] <= end and digest_of(path, known[1]) == known[2]:
            return known[0]
        here = files_of(self.folder, self.name)
        for other, (place, head, digest) in start.items():
            if place > end or digest_of(path, head) != digest:
                continue
            left = here.get(int(other))
            # a copy is one only if the original is no longer what it was; two files that begin alike are two files
            if left is None or left[1] < place or digest_of(left[0], head) != digest:
                return place
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        here, out = files_of(self.folder, self.name), []
        for number, (stop, head, digest) in sorted(end.items()):
            if start.get(number, [None])[0] == stop and start[number][2] == digest:
                continue
            found = here.get(int(number))
            if found is None or found[1] < stop or digest_of(found[0], head) != digest:
                if self.strict:
                    raise LinesLost(f"{self.folder}/{self.name}: file {number} was planned up to byte {stop} and is gone or begins anew")
                continue
            at = self.begins(number, found[0], stop, start)
            while at < stop:
                out.append(Span(self.folder, self.name, int(number), at, min(stop, at + self.split)))
                at += self.split
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        found = files_of(partition.folder, partition.name).get(partition.number)
        if found is None:
            raise LinesLost(f"{partition.folder}/{partition.name}: file {partition.number} is gone")
        with open(found[0], "rb") as f:
            at = partition.start
            if at:  # a line that began before belongs to the span before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    raise LinesLost(f"{found[0]}: shorter than planned")
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), str(partition.number), at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class RotatingLines(DataSource):
    """``path`` a folder, ``name`` the file's name; ``failOnDataLoss`` and ``splitBytes`` if not the defaults."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> RotatingReader:
        return RotatingReader(self.options)


def lines(spark: SparkSession, folder: str, name: str, strict: bool = True, split: int = SPLIT) -> DataFrame:
    """A stream of value, file (its number) and at (the byte its line begins)."""
    spark.dataSource.register(RotatingLines)
    return spark.readStream.format(FORMAT).options(path=folder, name=name, failOnDataLoss=str(strict).lower(), splitBytes=str(split)).load()


def records(rows: DataFrame, value: str = "value") -> DataFrame:
    """Lines that hold a JSON object, be they lines of their own or items of an array over many lines: brackets and trailing commas go, and what is no object."""
    bare = F.regexp_replace(F.trim(F.col(value)), "[,\\s]+$", "")
    return rows.withColumn(value, bare).filter(F.col(value).rlike("^\\{.*\\}$") & F.try_parse_json(F.col(value)).isNotNull())
