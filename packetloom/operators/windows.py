"""Time windows: tumbling distinct counts, sessions, intervals from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tumbling_distinct(df: DataFrame, key: list[str], member: Column, ts: str, width: str, least: int) -> DataFrame:
    """Windows (aligned to the epoch) and keys with at least ``least`` distinct members: window_start, n.

    The distinct members are found by a two-level aggregate, so a hot key's rows shrink before they meet.
    """
    w = F.window(F.col(ts).cast("timestamp"), width)
    row = df.select(*key, w.start.alias("window_start"), member.alias("_member")).filter("_member IS NOT NULL").distinct()
    return row.groupBy(*key, "window_start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def sessions(df: DataFrame, key: list[str], ts: str, gap: str, ids: str) -> DataFrame:
    """Sessions of rows at most ``gap`` apart: session_start, session_end (last row), n, first_id.

    session_id is an MD5 of key and start. Rows exactly one gap apart belong together.
    """
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    out = df.groupBy(*key, w.alias("_s")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n"), F.min(ids).alias("first_id"))
    name = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.unix_seconds(F.col("session_start").cast("timestamp")).cast("string")))
    return out.drop("_s").withColumn("session_id", name)


def ownership_intervals(leases: DataFrame, key: list[str], owner: str, start: str, end: str, tie: list[str]) -> DataFrame:
    """Half-open intervals during which one owner holds a key: key, owner, valid_from, valid_to (null: open).

    Of claims with one start, the smallest by (tie, owner) holds; it ends at the next start or its own
    end, whichever comes first. Neighbouring intervals of one owner become one. The result does not
    depend on the order of arrival.
    """
    first = F.min(F.struct(*tie, owner, end)).alias("_c")
    # a claim without an end is never shorter than one with an end only because of sorting nulls first
    claim = leases.groupBy(*key, start).agg(first).select(*key, F.col(start).alias("valid_from"), F.col(f"_c.{owner}").alias(owner), F.col(f"_c.{end}").alias("_end"))
    w = Window.partitionBy(*key).orderBy("valid_from")
    nxt = F.lead("valid_from").over(w)
    claim = claim.withColumn("valid_to", F.least(nxt, F.col("_end"))).filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    joined = (F.lag(owner).over(w) == F.col(owner)) & (F.lag("valid_to").over(w) == F.col("valid_from"))
    claim = claim.withColumn("_fresh", F.when(joined, 0).otherwise(1)).withColumn("_part", F.sum("_fresh").over(w))
    last = F.max_by(F.struct(F.col("valid_to").alias("e")), "valid_from")["e"]
    return claim.groupBy(*key, owner, "_part").agg(F.min("valid_from").alias("valid_from"), last.alias("valid_to")).drop("_part")


def fact_intervals(facts: DataFrame, key: list[str], value: str, ts: str, expires: str, rank: list[Column]) -> DataFrame:
    """Intervals of constant values from facts with optional leases: key, value, valid_from, valid_to, n.

    Per instant the first fact by ``rank`` holds. A run of one value is one interval while each fact
    falls before the lease known so far (the largest expiry of the run; none: unlimited); a fact at or
    after it starts anew. An interval ends at the next value or when its lease does, whichever is first.
    """
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col(expires).alias("x")), F.struct(*rank)).alias("_f")
    row = facts.groupBy(*key, ts).agg(best).select(*key, F.col(ts).alias("_t"), F.col("_f.v").alias(value), F.col("_f.x").alias("_x"))
    # gaps and islands twice: runs of equal values, then runs within leases
    w = Window.partitionBy(*key).orderBy("_t")
    row = row.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag("_t").over(w).isNotNull(), 0).otherwise(1))
    row = row.withColumn("_run", F.sum("_new").over(w))
    row = row.withColumn("_next_run", F.lead("_t").over(w))
    run = Window.partitionBy(*key, "_run").orderBy("_t")
    # null expiry at the start of an island stays unlimited until a later fact sets one
    reach = F.max("_x").over(run.rowsBetween(Window.unboundedPreceding, -1))
    row = row.withColumn("_gap", F.when(F.lag("_t").over(run).isNotNull() & reach.isNotNull() & (F.col("_t") >= reach), 1).otherwise(0))
    row = row.withColumn("_part", F.sum("_gap").over(run))
    out = row.groupBy(*key, "_run", "_part", value).agg(F.min("_t").alias("valid_from"), F.max("_x").alias("_lease"), F.max_by("_next_run", "_t").alias("_after"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("valid_to", F.least("_lease", "_after")).select(*key, value, "valid_from", "valid_to", "n")


def owner_at(points: DataFrame, intervals: DataFrame, key: list[str], ts: str, owner: str, block: int = 86_400) -> DataFrame:
    """``points`` with the owner of their key at their instant, null in gaps: intervals do not overlap, so an as-of join does, in blocks of a day."""
    from .joins import asof_join

    at = asof_join(points, intervals.withColumnRenamed("valid_from", "_from"), key, ts, "_from", [owner, "valid_to"], block=block)
    held = F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to"))
    return at.withColumn(owner, F.when(held, F.col(owner))).drop("valid_to")


def rising_stages(findings: DataFrame, key: list[str], stage: str, ts: str) -> DataFrame:
    """Per key: how often the kill-chain stage reached a new maximum over time, distinct stages, and whether that is an ordered chain."""
    w = Window.partitionBy(*key).orderBy(ts, stage).rowsBetween(Window.unboundedPreceding, -1)
    row = findings.filter(F.col(stage).isNotNull()).withColumn("_peak", F.max(stage).over(w))
    rise = F.count_if(F.col("_peak").isNull() | (F.col(stage) > F.col("_peak")))
    return row.groupBy(*key).agg(rise.alias("n_rises"), F.countDistinct(stage).alias("n_stages")).withColumn("is_chain", (F.col("n_rises") >= 2) & (F.col("n_stages") >= 2))


def trailing_distinct(df: DataFrame, key: list[str], value: str, ts: str, seconds: int) -> DataFrame:
    """``df`` with n_recent: distinct values of the key in the ``seconds`` up to and including the row's time.

    Counted as events, without gathering values: a value counts at a time if its last occurrence up
    to then is within reach, so each occurrence adds 1 from its time and takes 1 away when it is
    renewed or expires.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    reach = seconds * 1_000_000
    seen = df.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"), t.alias("_t")).distinct()
    nxt = F.lead("_t").over(Window.partitionBy(*key, "_v").orderBy("_t"))
    # a value is live on [_t, min(next, _t + reach]]; the end of its last instant is just after _t + reach
    seen = seen.withColumn("_end", F.least(nxt, F.col("_t") + reach + 1))
    step = seen.select(*key, F.explode(F.array(F.struct(F.col("_t").alias("_t"), F.lit(1).alias("_d")), F.struct(F.col("_end").alias("_t"), F.lit(-1).alias("_d")))).alias("_e"))
    step = step.groupBy(*key, F.col("_e._t").alias("_t")).agg(F.sum("_e._d").alias("_d"))
    run = step.withColumn("n_recent", F.sum("_d").over(Window.partitionBy(*key).orderBy("_t"))).select(*[F.col(k).alias(f"_{k}") for k in key], "_t", "n_recent")
    cond = F.col("_t") == t
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.filter(F.col(value).isNotNull()).join(run, cond).drop("_t", *[f"_{k}" for k in key])
