"""Line dedup by prefix doubling over line sequences (native).

Every line gets a rank among the distinct lines that occur more than once; other lines end all
runs. Prefix doubling then ranks blocks of 2, 4, 8, ... lines by pairs of ranks of their halves:
a block's rank is its place in the sorted order of all repeated blocks of that length, which is
the suffix array cut at that depth, and equal ranks are the LCP intervals of that depth. The
ranks of two overlapping blocks name an interval of any depth in between.

A run of lines is removed where it has at least ``min_words`` words and occurs at an earlier
place too, places ordered by (doc_id, line); a run that overlaps its first place is no copy of it, so
one whole copy stays of a line that repeats on and on. A maximal repeated run is removed whole: it is
covered by the shortest runs of ``min_words`` words that start, or end, at each of its lines, and
how far those reach depends on their content alone, so that all copies have the same. Doubling
stops at the longest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import Workspace, join_counted

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _variant(text: Column) -> Column:
    """Tells texts under one doc_id apart; rows that repeat both are one document."""
    return F.xxhash64(text)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """A rank, in sorted order, for each combination of values that occurs more than once."""
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return many.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def repeated_lines(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Level 0: (d, v, pos, words, r) of every line that occurs more than once in the corpus."""
    # the hash of a text is taken before its lines are listed, or each line would take it anew
    text = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), _variant(F.col("text")).alias("v"), "text")
    line = text.select("d", "v", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # 128 bits, from two seeds
    line = ws.save(
        line.select(
            "d", "v", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"),
            F.regexp_count("line", F.lit("\\S+")).alias("words"),
        ),
        "lines",
    )
    names = ws.save(_ranked(line, ["h1", "h2"]), "names-0")
    base = join_counted(line, names, ["h1", "h2"]).select("d", "v", "pos", "words", F.col("rank").alias("r"))
    base = ws.save(base.dropDuplicates(["d", "v", "pos"]), "level-0")
    ws.drop("lines", "names-0")
    return base


def double(level: DataFrame, k: int, ws: Workspace) -> DataFrame:
    """Ranks of the repeated blocks of 2 ** k lines from those of 2 ** (k - 1) lines."""
    half = 1 << (k - 1)
    w = Window.partitionBy("d", "v").orderBy("pos").rangeBetween(half, half)
    pair = ws.save(level.select("d", "v", "pos", "r", F.max("r").over(w).alias("s")).filter("s IS NOT NULL"), f"pairs-{k}")
    names = ws.save(_ranked(pair, ["r", "s"]), f"names-{k}")
    out = ws.save(join_counted(pair, names, ["r", "s"]).select("d", "v", "pos", F.col("rank").alias("r")), f"level-{k}")
    ws.drop(f"pairs-{k}", f"names-{k}")
    return out


def windows(base: DataFrame, min_words: int) -> DataFrame:
    """(d, v, pos, n): the shortest runs of repeated lines with min_words words that start or end at each line."""
    line = Window.partitionBy("d", "v").orderBy("pos")
    row = base.withColumn("island", F.col("pos") - F.row_number().over(line))
    island = Window.partitionBy("d", "v", "island")
    row = row.withColumn("upto", F.sum("words").over(island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    row = row.withColumn("before", F.col("upto") - F.col("words")).withColumn("first", F.min("pos").over(island)).withColumn("last", F.max("pos").over(island))
    row = row.withColumn("all", F.max("upto").over(island))
    # the first line by which min_words words have passed, and the last from which they have
    # both frames grow with their row from the partition's start, so a window costs one pass however long the document
    past = F.min("pos").over(island.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -min_words))
    ahead = F.max("pos").over(island.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    end = F.coalesce(past - 1, F.when(F.col("all") - F.col("before") >= min_words, F.col("last")))
    start = F.coalesce(ahead + 1, F.when(F.col("upto") >= min_words, F.col("first")))
    row = row.select("d", "v", "pos", end.alias("end"), start.alias("start"))
    runs = F.array(
        F.struct(F.col("pos").alias("pos"), (F.col("end") - F.col("pos") + 1).alias("n")),
        F.struct(F.col("start").alias("pos"), (F.col("pos") - F.col("start") + 1).alias("n")),
    )
    return row.select("d", "v", F.explode(runs).alias("w")).select("d", "v", "w.pos", "w.n").filter("pos IS NOT NULL AND n IS NOT NULL").distinct()


def later_copies(docs: DataFrame, min_words: int, ws: Workspace) -> DataFrame:
    """(d, v, pos, n): runs that occur at an earlier place too."""
    base = repeated_lines(docs, ws)
    run = ws.save(windows(base, min_words), "windows")
    longest = run.agg(F.max("n")).first()[0] or 0
    level, k, found = base.select("d", "v", "pos", "r"), 0, []
    while (1 << k) <= longest:
        if k:
            level = double(level, k, ws)
            if level.isEmpty():
                break
        # runs of 2^k to 2^(k+1) - 1 lines, named by the ranks of their first and last 2^k lines
        here = run.filter(F.col("n").between(1 << k, (2 << k) - 1))
        same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("v") == F.col("v2"))  # d may be null
        head = level.select(F.col("d").alias("d2"), F.col("v").alias("v2"), F.col("pos").alias("at"), "r")
        named = here.join(head, same & (F.col("pos") == F.col("at"))).select("d", "v", "pos", "n", "r")
        tail = level.select(F.col("d").alias("d2"), F.col("v").alias("v2"), F.col("pos").alias("at"), F.col("r").alias("r2"))
        named = named.join(tail, same & (F.col("pos") + F.col("n") - (1 << k) == F.col("at")))
        named = ws.save(named.select("d", "v", "pos", "n", "r", "r2"), f"named-{k}")
        place = F.struct("d", "v", "pos")
        first = ws.save(named.groupBy("n", "r", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"), f"first-{k}")
        inside = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("v") == F.col("first.v")) & (F.col("pos") < F.col("first.pos") + F.col("n"))
        found.append(join_counted(named, first, ["n", "r", "r2"]).filter((place > F.col("first")) & ~inside).select("d", "v", "pos", "n"))
        k += 1
    out = found[0] if found else run.filter("false")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated line runs; n_lines, n_removed and removed are added.

    removed lists the removed runs as (first, last) line numbers from 0. A document whose lines
    all go keeps its row, with an empty text; a null text stays null, with no lines. Lines are
    what line feeds separate, compared byte for byte. Documents are ordered by doc_id (null
    first); texts under one doc_id by hash. Rows that repeat a document exactly are one document,
    not copies of each other. Columns of ``docs`` with the added names are replaced.
    """
    ws = Workspace(docs.sparkSession, "line-dedup")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    gone = later_copies(docs.select("doc_id", "text"), min_words, ws)
    gone = gone.select("d", "v", "pos", (F.col("pos") + F.col("n") - 1).alias("end"))
    # runs that touch or overlap become one
    order = Window.partitionBy("d", "v").orderBy("pos", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("fresh", F.when(F.col("pos") <= reach + 1, 0).otherwise(1))
    gone = gone.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gone = gone.groupBy("d", "v", "part").agg(F.struct(F.min("pos").alias("first"), F.max("end").alias("last")).alias("run"))
    gone = ws.save(gone.groupBy("d", "v").agg(F.array_sort(F.collect_list("run")).alias("__pl_runs")), "removed")
    row = docs.select(*own, F.col("doc_id").alias("__pl_d"), _variant(F.col("text")).alias("__pl_v"))
    # one shuffle of the texts at any size: how many documents lose lines does not change the plan
    gone = gone.select(F.col("d").alias("__pl_gd"), F.col("v").alias("__pl_gv"), "__pl_runs")
    row = row.join(gone.hint("merge"), F.col("__pl_d").eqNullSafe(F.col("__pl_gd")) & (F.col("__pl_v") == F.col("__pl_gv")), "left")
    line = _lines(F.col("text"))
    # runs are in order and apart, so a flag a line comes from the gaps between them; lines behind the last have none
    before = lambda i: F.coalesce(F.get(F.col("__pl_runs"), i - 1)["last"] + 1, F.lit(0))
    keep = F.flatten(F.transform("__pl_runs", lambda r, i: F.concat(F.array_repeat(F.lit(True), r["first"] - before(i)), F.array_repeat(F.lit(False), r["last"] - r["first"] + 1))))
    kept = F.zip_with(line, keep, lambda x, k: F.when(F.coalesce(k, F.lit(True)), x))  # what goes is null, and array_join leaves it out
    text = F.when(F.col("__pl_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lost = F.aggregate("__pl_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return row.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(line)).alias("n_lines"),
        F.coalesce(lost, F.lit(0)).alias("n_removed"),
        F.coalesce("__pl_runs", F.array().cast("array<struct<first:int,last:int>>")).alias("removed"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
 w AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM l),
 c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
 s AS (SELECT a.doc_id, a.pos, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - (a.upto - a.words) >= {MIN_WORDS} GROUP BY ALL
       UNION SELECT b.doc_id, max(a.pos), b.pos FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - (a.upto - a.words) >= {MIN_WORDS} GROUP BY b.doc_id, b.pos),
 x AS (SELECT s.doc_id, s.pos, s.e, string_agg(l.line, chr(10) ORDER BY l.pos) AS body FROM s JOIN l ON l.doc_id = s.doc_id AND l.pos BETWEEN s.pos AND s.e GROUP BY ALL),
 y AS (SELECT *, min(struct_pack(d := doc_id, p := pos, e := e)) OVER (PARTITION BY body) AS first FROM x),
 gone AS (SELECT DISTINCT y.doc_id, l.pos FROM y JOIN l ON l.doc_id = y.doc_id AND l.pos BETWEEN y.pos AND y.e WHERE y.doc_id > y.first.d OR (y.doc_id = y.first.d AND y.pos > y.first.e))
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text, count(*)::INT AS n_lines, count(g.pos)::INT AS n_removed
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
"""
