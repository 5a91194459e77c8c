"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_OPEN: list["Workspace"] = []
#: Keys with more than one row in so many are hot; there are at most so many of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode (tests); on a cluster, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="packetloom-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, unless the session has its own limit: texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(4 << 20))


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str = "c") -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key of ``on`` and says how many of ``rows`` have it.

    Keys that hold more than one row in HOT_SHARE are at most HOT_SHARE in number: they are broadcast, and
    so stay where they are. The others meet by shuffle, in groups of bounded share.
    """
    hot = keyed.filter(F.col(count) * HOT_SHARE > rows.count())
    if hot.isEmpty():
        return rows.join(keyed.drop(count), on)
    names = hot.select(*on)
    rest = rows.join(F.broadcast(names), on, "left_anti").join(keyed.join(F.broadcast(names), on, "left_anti").drop(count), on)
    return rows.join(F.broadcast(hot.drop(count)), on).unionByName(rest)


class Workspace:
    """Tables of one operator call: ``save`` writes and rereads, ``drop`` deletes early.

    What is left is deleted when the interpreter ends, since a lazy result may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/packetloom/{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    while _OPEN:
        space = _OPEN.pop()
        try:
            if space.spark.sparkContext._jsc is not None:
                space.drop()
        except Exception:  # the session is gone; its folder is the cluster's to clean
            pass
