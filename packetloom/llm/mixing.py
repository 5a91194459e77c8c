"""Mixing sources to target weights by Poisson replication (native).

Each document is repeated n times, n drawn from a Poisson distribution whose mean is its
source's target repetition rate. The draw inverts the distribution at a number hashed from
the seed and doc_id, so it needs no state, no order and no coordination, and a retried task
draws the same. Copies are then shuffled globally by a hash of (seed, doc_id, copy).

A large mean is a sum of parts, each drawn by itself. Where a document has very many parts, they are
dealt out in blocks before any is drawn: a block's draws say how many copies it makes, and running sums over
the blocks say which numbers these copies have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._store import Workspace, join_counted

#: A larger mean is drawn as a sum of independent draws of at most this mean each.
PART_MEAN = 32.0
#: Entries of a part's cumulative distribution; beyond, the probability is under 1e-40.
TERMS = 160
#: Copies of a document that one task makes, and parts that are drawn in one row; blocks of parts are listed so many in a row.
BLOCK_COPIES = 1_000
BLOCK_PARTS = 1_000
#: Sources up to which the rate table (about 1.4 kB a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 5_000
SEED = "mix-1"


def rates(docs: DataFrame, weights: DataFrame | None = None, total_bytes: int | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """Per source: src, n_docs, n_bytes, mean repetition rate, parts and their cumulative distribution.

    weights (src, weight): target shares of bytes, scaled to 1 over the sources present; a source
    without a weight gets none. Default: equal shares. total_bytes: the mixture's mean size;
    default: that of the input. A source without bytes has rate 0.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    stats = docs.groupBy(F.col(source).alias("src")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes"))
    if weights is None:
        stats = stats.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("src").alias("__pl_src"), F.col("weight").cast("double").alias("__pl_weight"))
        stats = stats.join(w, F.col("src").eqNullSafe(F.col("__pl_src")), "left").withColumn("weight", F.coalesce("__pl_weight", F.lit(0.0))).drop("__pl_src", "__pl_weight")
    stats = stats.withColumn("weight", F.when(F.col("n_bytes") > 0, F.col("weight")).otherwise(0.0))
    whole = stats.agg(F.sum("weight").alias("__pl_weights"), F.sum("n_bytes").alias("__pl_bytes"))
    size_out = F.lit(total_bytes) if total_bytes is not None else F.col("__pl_bytes")
    rate = F.when((F.col("n_bytes") > 0) & (F.col("__pl_weights") > 0), F.col("weight") / F.col("__pl_weights") * size_out / F.col("n_bytes")).otherwise(0.0)
    out = stats.join(F.broadcast(whole)).withColumn("rate", rate)
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("long"))
    mean = F.col("rate") / F.col("parts")
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"),
        ),
        lambda s: s["c"],
    )
    return out.select("src", "n_docs", "n_bytes", "rate", "parts", term.alias("cdf"))


def _unit(*parts):
    """A number in (0, 1) from 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _draws(name, first, last, seed: str):
    """Copies that the parts from first to last make, by the distribution in __pl_cdf. Each number is hashed once, then compared with its steps."""
    number = F.transform(F.sequence(first, last), lambda j: _unit(F.lit(seed), name, j.cast("string")))
    return F.aggregate(F.transform(number, lambda u: F.size(F.filter("__pl_cdf", lambda c: c < u))), F.lit(0).cast("long"), lambda a, b: a + b)


def _large(row: DataFrame, key: str, seed: str) -> DataFrame:
    """(__pl_key, __pl_k, n_copies, __pl_from, __pl_n): blocks of copies of each key of a source, where it has more than BLOCK_PARTS parts.

    The parts of a key are dealt out twice, in blocks of blocks and then in blocks, so that no row lists many.
    """
    tasks = int(row.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["__pl_key", "__pl_k"]
    one = row.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__pl_key"), "__pl_k", "__pl_parts", "__pl_cdf")
    one = one.groupBy(*at).agg(F.first("__pl_parts").alias("__pl_parts"), F.first("__pl_cdf").alias("__pl_cdf"))
    blocks = F.floor((F.col("__pl_parts") - 1) / BLOCK_PARTS)
    one = one.withColumn("__pl_far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(blocks / BLOCK_PARTS))))
    one = one.repartition(tasks, *at, "__pl_far").withColumn("__pl_block", F.explode(F.sequence(F.col("__pl_far") * BLOCK_PARTS, F.least(blocks, F.col("__pl_far") * BLOCK_PARTS + BLOCK_PARTS - 1))))
    one = one.repartition(tasks, *at, "__pl_block")
    first, last = F.col("__pl_block") * BLOCK_PARTS + 1, F.least(F.col("__pl_parts"), (F.col("__pl_block") + 1) * BLOCK_PARTS)
    one = one.select(*at, "__pl_block", _draws(F.col("__pl_key"), first, last, seed).alias("__pl_n"))
    own = Window.partitionBy(*at)  # a row a block, about PART_MEAN * BLOCK_PARTS copies each
    upto = F.sum("__pl_n").over(own.orderBy("__pl_block").rowsBetween(Window.unboundedPreceding, -1))
    return one.select(*at, F.sum("__pl_n").over(own).alias("n_copies"), F.coalesce(upto, F.lit(0)).alias("__pl_from"), "__pl_n").filter("__pl_n > 0")


def mix(docs: DataFrame, weights: DataFrame | None = None, total_bytes: int | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", shuffle: bool = True) -> DataFrame:
    """``docs`` with each row repeated n_copies times, numbered by copy (from 1), in random order.

    Rows drawn 0 times go. A null source is a source of its own; a null key counts as ''. Rows
    with one key are drawn alike. Rows of a partition lie in the order of shuffle_key, a random
    hash by which they were dealt out. A source's rate has no bound: one short document may stand for
    a source's whole share, in as many copies as that takes. Columns of ``docs`` named copy, n_copies, rate or
    shuffle_key are replaced.
    """
    own = [c for c in docs.columns if c not in ("copy", "n_copies", "rate", "shuffle_key")]
    ws = Workspace(docs.sparkSession, "mix")
    # no source is another's name: the null one is the empty string, all others begin with a mark
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    table = rates(docs, weights, total_bytes, source, text)
    table = ws.save(table.select(named("src").alias("__pl_k"), "n_docs", "rate", F.col("parts").alias("__pl_parts"), F.col("cdf").alias("__pl_cdf")), "rates")
    row = docs.select(*own, named(source).alias("__pl_k"))
    if table.count() <= BROADCAST_SOURCES:
        row = row.join(F.broadcast(table.drop("n_docs")), "__pl_k")
    else:  # large sources stay where they are, the others meet by shuffle
        row = join_counted(row, table, ["__pl_k"], "n_docs")
    name, one = F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(1).cast("long")
    large, row = row.filter(F.col("__pl_parts") > BLOCK_PARTS), row.filter(F.col("__pl_parts") <= BLOCK_PARTS)
    row = row.select(*own, "rate", _draws(name, one, F.col("__pl_parts"), seed).alias("n_copies")).filter("n_copies > 0")
    few, many = row.filter(F.col("n_copies") <= BLOCK_COPIES), row.filter(F.col("n_copies") > BLOCK_COPIES)
    few = few.withColumn("copy", F.explode(F.sequence(one, F.col("n_copies"))))
    many = many.select("*", F.lit(0).cast("long").alias("__pl_from"), F.col("n_copies").alias("__pl_n"))
    if not table.filter(F.col("__pl_parts") > BLOCK_PARTS).isEmpty():
        blocks = _large(large, key, seed)
        more = large.withColumn("__pl_key", name).join(blocks, ["__pl_key", "__pl_k"]).select(*own, "rate", "n_copies", "__pl_from", "__pl_n")
        many = many.unionByName(more)
    # documents with very many copies are dealt out in blocks of copies first, so that no task makes all of one
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.least(F.col("__pl_n"), (F.col("__pl_block") + 1) * BLOCK_COPIES)
    many = many.withColumn("__pl_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__pl_n") - 1) / BLOCK_COPIES))))
    many = many.repartition(tasks, F.xxhash64(key, "__pl_from", "__pl_block")).withColumn("copy", F.explode(F.sequence(F.col("__pl_from") + F.col("__pl_block") * BLOCK_COPIES + 1, F.col("__pl_from") + last)))
    many = many.drop("__pl_block", "__pl_from", "__pl_n")
    row = few.unionByName(many)
    row = row.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string"))))
    if shuffle:
        row = row.repartition("shuffle_key").sortWithinPartitions("shuffle_key", key)
    return row.select(*own, "rate", "n_copies", "copy", "shuffle_key")


def op10(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "n_copies", "copy", "shuffle_key")


ORACLE = f"""
WITH RECURSIVE s AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM documents GROUP BY source),
 w AS (SELECT source, n_bytes, CASE WHEN n_bytes > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM s),
 r AS (SELECT source, CASE WHEN n_bytes > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(n_bytes) FROM w)::DOUBLE / n_bytes::DOUBLE ELSE 0.0 END AS rate FROM w),
 q AS (SELECT source, greatest(1, ceil(rate / {PART_MEAN}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {PART_MEAN})) AS mean FROM r),
 t AS (SELECT source, mean, parts, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM q
       UNION ALL SELECT source, mean, parts, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM t WHERE k < {TERMS}),
 d AS (SELECT doc_id, source, j, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0::DOUBLE AS u
       FROM documents JOIN q USING (source), LATERAL (SELECT unnest(range(1, parts + 1)) AS j)),
 n AS (SELECT d.doc_id, d.source, count(*)::BIGINT AS n_copies FROM d JOIN t ON t.source = d.source AND t.c < d.u GROUP BY ALL)
SELECT doc_id, source, n_copies, copy, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1))::BIGINT AS copy FROM n)
"""
