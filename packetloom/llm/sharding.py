"""Sharding by extendible hashing (native).

A document's place is the 60-bit hash of its key. The directory starts with one bucket; a
bucket whose bytes exceed the limit splits on the next hash bit, and only such buckets do.
Byte sums per hash prefix are gathered in one pass over (hash, bytes) rows, at a depth some
bits beyond what even hashing needs; only buckets still too large there are refined further.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ._store import Workspace

BITS = 60
LIMIT_BYTES = 64 << 20
#: Directory rows up to which the directory is broadcast (about 40 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
NAMES = ("shard_id", "shard_depth", "shard_prefix", "shard_bytes")
#: Bits that a pass looks beyond the depth at which even hashing would fit.
SLACK_BITS = 6


def hash_bits(key):
    """60 hash bits of a key column, as a non-negative long; a null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def prefix(bits, depth):
    """The leading ``depth`` bits (int or column)."""
    down = F.lit(BITS - depth) if isinstance(depth, int) else F.lit(BITS) - depth
    return F.call_function("shiftright", bits, down.cast("int"))


def directory(light: DataFrame, limit: int, ws: Workspace) -> tuple[list[tuple[int, DataFrame]], bool]:
    """Leaves of the directory over rows (bits, bytes), as (depth, table) per pass.

    A table maps each prefix of that many bits to its leaf: depth, prefix and shard_bytes.
    The flag tells whether buckets of one single hash value exceed the limit (depth is then 60).
    """
    total = light.agg(F.sum("bytes")).first()[0] or 0
    start, deep = 0, min(BITS, max(8, math.ceil(math.log2(max(1, total / limit))) + SLACK_BITS))
    passes, rest = [], light
    while True:
        sums = rest.groupBy(prefix(F.col("bits"), deep).alias("at")).agg(F.sum("bytes").alias("bytes"))
        step = (
            sums.select("at", "bytes", F.explode(F.sequence(F.lit(start), F.lit(deep))).alias("depth"))
            .select("at", "bytes", "depth", F.call_function("shiftright", F.col("at"), (F.lit(deep) - F.col("depth")).cast("int")).alias("prefix"))
        )
        step = ws.save(step, f"steps-{deep}")
        node = step.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
        # sums shrink with depth, so a prefix's leaf is the first of its buckets that fits
        fits = node.filter((F.col("shard_bytes") <= limit) | ((F.col("depth") == deep) & F.lit(deep == BITS)))
        first = F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf")
        found = ws.save(step.join(fits, ["depth", "prefix"]).groupBy("at").agg(first).select("at", "leaf.*"), f"leaves-{deep}")
        passes.append((deep, found))
        if deep == BITS:
            return passes, not found.filter((F.col("shard_bytes") > limit)).isEmpty()
        large = sums.join(found, "at", "left_anti").select(F.col("at").alias("__pl_at"))
        large = ws.save(large, f"large-{deep}")
        if large.isEmpty():
            return passes, False
        rest = ws.save(rest.join(large, prefix(F.col("bits"), deep) == F.col("__pl_at"), "left_semi"), f"rest-{deep}")
        start, deep = deep + 1, min(BITS, deep + 16)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard_id, shard_depth, shard_prefix and shard_bytes.

    Every shard's texts fit ``limit`` bytes of UTF-8 (null: none), but for a single text that is
    larger than the limit itself. Rows with one key share all hash bits; where they exceed the
    limit, a second directory splits them by the hash of key and text (``text:`` in shard_id, and
    depth and prefix are those of that hash). Rows that repeat key and text are then dealt to numbered
    pages (``:page`` in shard_id) of as many rows as fit, and shard_bytes is the page's; one task
    numbers the repetitions of a row. Columns of ``docs`` with these names are replaced.
    """
    own = [c for c in docs.columns if c not in NAMES]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    out, full = _assigned(docs.select(own), hash_bits(F.col(key)), size, limit, "")
    if full is not None:
        whole = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        split, still = _assigned(full.select(own), hash_bits(whole), size, limit, "text:")
        out = out.unionByName(split)
        if still is not None:
            out = out.unionByName(_pages(still, limit, size, own))
    return out.select(*own, *NAMES)


def _assigned(docs: DataFrame, bits, size, limit: int, mark: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their shards by a hash, and, apart, the rows of hash values that exceed the limit, if there are any."""
    ws = Workspace(docs.sparkSession, "sharding")
    own = docs.columns
    light = ws.save(docs.select(bits.alias("bits"), size.alias("bytes")), "light")
    passes, overflow = directory(light, limit, ws)
    row = docs.select(*own, bits.alias("__pl_bits"))
    leaf = [F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")]
    for deep, found in passes:
        t = found.select(F.col("at").alias("__pl_at"), F.struct("depth", "prefix", "shard_bytes").alias(f"__pl_leaf{deep}"))
        t = F.broadcast(t) if found.count() <= BROADCAST_ROWS else t
        row = row.join(t, prefix(F.col("__pl_bits"), deep) == F.col("__pl_at"), "left").drop("__pl_at")
        here = F.col(f"__pl_leaf{deep}")
        leaf = [F.coalesce(leaf[0], here["depth"]), F.coalesce(leaf[1], here["prefix"]), F.coalesce(leaf[2], here["shard_bytes"])]
    name = F.concat(F.lit(mark), leaf[0].cast("string"), F.lit(":"), leaf[1].cast("string"))
    out = row.select(*own, "__pl_bits", name.alias("shard_id"), leaf[0].alias("shard_depth"), leaf[1].alias("shard_prefix"), leaf[2].alias("shard_bytes"))
    if not overflow:
        return out.select(*own, *NAMES), None
    full = (F.col("shard_depth") == BITS) & (F.col("shard_bytes") > limit)
    return out.filter(~full).select(*own, *NAMES), out.filter(full)


def _pages(rows: DataFrame, limit: int, size, own: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("__pl_bits")
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("__pl_size").over(w))))
    numbered = rows.withColumn("__pl_size", size).withColumn("__pl_fit", fit)
    numbered = numbered.withColumn("__pl_page", F.floor((F.row_number().over(w.orderBy("__pl_size")) - 1) / F.col("__pl_fit")))
    return numbered.select(
        *own, F.concat_ws(":", F.col("shard_id"), F.col("__pl_page").cast("string")).alias("shard_id"), "shard_depth", "shard_prefix",
        F.sum("__pl_size").over(Window.partitionBy("__pl_bits", "__pl_page")).alias("shard_bytes"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "shard_id", "shard_depth", "shard_prefix", "shard_bytes")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits FROM documents),
 n AS (SELECT g.depth, CASE WHEN g.depth = 0 THEN 0 ELSE d.bits >> (60 - g.depth) END AS prefix, sum(bytes)::BIGINT AS shard_bytes
       FROM d, range(0, 61) g(depth) GROUP BY ALL),
 f AS (SELECT d.doc_id, d.bits, min(n.depth) AS depth FROM d JOIN n
         ON n.prefix = CASE WHEN n.depth = 0 THEN 0 ELSE d.bits >> (60 - n.depth) END
       WHERE n.shard_bytes <= {LIMIT_BYTES} GROUP BY ALL)
SELECT f.doc_id, n.depth || ':' || n.prefix AS shard_id, n.depth::INT AS shard_depth, n.prefix::BIGINT AS shard_prefix, n.shard_bytes
FROM f JOIN n ON n.depth = f.depth AND n.prefix = CASE WHEN f.depth = 0 THEN 0 ELSE f.bits >> (60 - f.depth) END
"""
