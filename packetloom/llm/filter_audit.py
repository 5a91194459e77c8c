"""Audit of how quality filters interact, from one CUBE over their failure flags.

Each document is read once and becomes a handful of flags. Counts by part and flags are then
expanded by SQL's CUBE: the grouping-set row in which every *selected* flag is false counts
the documents that survive that subset of filters, whatever the others say. Any order of the
filters walks through subsets, so a step is a join of two of them: what is there before, and
what is left with one filter more. The CUBE runs over counts (two to the number of filters, a
part), never over documents.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import HOT_SHARE, Workspace

SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders are listed in full, so there are at most so many filters.
MOST = 6
MEASURES = ("n", "good", "toxic")


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def repetitive(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * 80


def shouting(text: Column, words: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, UPPER, ""))) * 100 > F.length(text) * 10


def symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions by letter, over a text without null and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
#: The letter of the filter that needs the table: the text is that of a smaller doc_id.
COPY = "E"


def flags(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, copy: str = COPY) -> DataFrame:
    """doc_id, part and a boolean for each filter, true where the row fails it; one row a row of ``docs``.

    A null text is the empty one; a null lang is the part of the empty string. A row fails ``copy`` if a row with
    a smaller doc_id has the same bytes; a null doc_id is neither smaller nor larger than another.
    """
    filters = FILTERS if filters is None else filters
    ws = Workspace(docs.sparkSession, "filter-audit")
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    row = base.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[f(F.col("text"), F.col("words")).alias(x) for x, f in filters.items()])
    row = ws.save(row, "rows")
    copies = ws.save(row.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1), "copies")
    hot = copies.filter(F.col("c") * HOT_SHARE > row.count()).drop("c")  # at most HOT_SHARE digests
    cold = copies.filter(F.col("c") * HOT_SHARE <= row.count()).drop("c")
    if hot.isEmpty():
        met = row.join(cold, "digest", "left")
    else:
        rest = row.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")
        met = row.join(F.broadcast(hot), "digest").unionByName(rest)
    return met.select("doc_id", "part", *filters, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias(copy))


def counts(rows: DataFrame, labels: DataFrame, letters: list[str]) -> DataFrame:
    """Documents by part and flags: n, and of these ``good`` (quality 1) and ``toxic`` (toxic 1).

    A doc_id counts as good or toxic if any of its rows in ``labels`` says so. Repeated rows come together before the join.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    known = known.groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    tally = rows.groupBy("doc_id", "part", *letters).agg(F.count(F.lit(1)).alias("n"))
    return (
        tally.join(known, "doc_id", "left").groupBy("part", *letters)
        .agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(x) for x, c in (("good", "quality"), ("toxic", "toxic"))])
    )


def survivors(table: DataFrame, letters: list[str]) -> DataFrame:
    """part, subset (bit i: the filter letters[i] is applied), and the MEASURES of what no filter of the subset removes; zeros too."""
    chosen = sum(((F.lit(1) - F.grouping(x).cast("int")) * (1 << i) for i, x in enumerate(letters)), F.lit(0))
    cube = table.cube("part", *letters).agg(chosen.alias("subset"), F.grouping("part").alias("all_parts"), *[F.sum(m).alias(m) for m in MEASURES])
    # a flag that the set leaves out is null in its row; a selected one must be false
    passed = cube.filter((F.col("all_parts") == 0) & ~F.greatest(F.lit(False), *[F.coalesce(x, F.lit(False)) for x in letters]))
    grid = table.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("subset"))
    return grid.join(passed.select("part", "subset", *MEASURES), ["part", "subset"], "left").na.fill(0, list(MEASURES))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, copy: str = COPY) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter removes in that order.

    part, filter_order, step, and as long document counts kept, removed, redundant (fails the filter but is gone
    already), unique_fails (fails this filter only), good_lost and toxic_lost (removed here, by ``labels``), and
    shapley (removed by the filter, summed over all orders). Columns besides doc_id, text and lang, and doc_id,
    quality and toxic, are not looked at. Empty ``docs`` give no rows; without labels nothing good or toxic is lost.
    """
    filters = FILTERS if filters is None else filters
    letters = sorted([*filters, copy])
    if len(letters) > MOST or len(set(letters)) < len(letters) or any(len(x) != 1 for x in letters):
        raise ValueError(f"filters need different letters, {MOST} at most")
    spark, k = docs.sparkSession, len(letters)
    ws = Workspace(spark, "filter-audit")
    left = ws.save(survivors(ws.save(counts(flags(docs, filters, copy), labels, letters), "counts"), letters), "survivors")
    # pairs of subsets that differ in one filter, with the number of orders that go from the one to the other
    edges = [
        (b, b | 1 << i, letters[i], factorial(b.bit_count()) * factorial(k - 1 - b.bit_count()))
        for b in range(1 << k) for i in range(k) if not b >> i & 1
    ]
    edges = F.broadcast(spark.createDataFrame(edges, "before int, after int, letter string, orders long"))
    before = left.select("part", F.col("subset").alias("before"), *[F.col(m).alias(f"{m}_before") for m in MEASURES])
    after = left.select("part", F.col("subset").alias("after"), *MEASURES)
    pair = before.join(edges, "before").join(after, ["part", "after"])
    pair = pair.select("part", "before", "after", "letter", "orders", F.col("n").alias("kept"), *[(F.col(f"{m}_before") - F.col(m)).alias(f"{m}_lost") for m in MEASURES])
    own = Window.partitionBy("part", "letter")  # two to the number of filters rows at most
    lost, last = F.col("n_lost"), (1 << k) - 1
    pair = pair.select(
        "*",
        F.max(F.when(F.col("before") == 0, lost)).over(own).alias("fails"),
        F.max(F.when(F.col("after") == last, lost)).over(own).alias("unique_fails"),
        F.sum(lost * F.col("orders")).over(own).alias("shapley"),
    )
    steps = []
    for order in permutations(range(k)):
        gone = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, gone, letters[i]))
            gone |= 1 << i
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, letter string"))
    return pair.join(steps, ["before", "letter"]).select(
        "part", "filter_order", "step", "kept", lost.alias("removed"), (F.col("fails") - lost).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def op11(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part,
         (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS bits
  FROM w
), l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits
), x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS ls, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
  FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT array_to_string(ls, '') AS filter_order, k AS step, bs[k] AS bit, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS gone
  FROM o, (SELECT unnest(range(1, 6))::INT AS k)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN bits & (gone | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bits & gone > 0 AND bits & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bits & gone = 0 AND bits & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
