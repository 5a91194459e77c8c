"""Novelty against what an entity, a group or a fleet has shown before: scored before learned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules, time


def prior_counts(df: DataFrame, key: list[str], value: str, ts: str) -> DataFrame:
    """``df`` with n_prior (rows of the key before), n_prior_distinct, first_seen of the key, and is_new (value not seen before).

    Rows of one time are ordered by value. Distinct values are counted as a running sum of first
    occurrences, so no set is gathered.
    """
    order = Window.partitionBy(*key).orderBy(ts, value)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.row_number().over(Window.partitionBy(*key, value).orderBy(ts)) == 1, 1).otherwise(0)
    out = df.withColumn("_fresh", fresh)
    return out.select(
        *df.columns, (F.row_number().over(order) - 1).alias("n_prior"), F.coalesce(F.sum("_fresh").over(before), F.lit(0)).alias("n_prior_distinct"),
        F.min(ts).over(Window.partitionBy(*key)).alias("first_seen"), (F.col("_fresh") == 1).alias("is_new"),
    )


def fleet_count(df: DataFrame, key: list[str], entity: str, value: str, ts: str) -> DataFrame:
    """``df`` with n_fleet: how many entities of the key (a tenant) had shown the value up to the row's time."""
    first = df.groupBy(*key, value, entity).agg(F.min(ts).alias("_first"))
    w = Window.partitionBy(*key, value).orderBy("_first").rangeBetween(Window.unboundedPreceding, 0)
    # entities by the time they joined; the latest count at or before a row is an as-of lookup
    from .joins import asof_join

    steps = first.withColumn("n_fleet", F.count(F.lit(1)).over(w)).select(*key, value, "_first", "n_fleet").distinct()
    return asof_join(df, steps, [*key, value], ts, "_first", ["n_fleet"], block=86_400)


def ja4_novelty(df: DataFrame, tenant: list[str], entity: str, fp: str, ts: str, min_observations: int = 100, min_span: int = 86_400, rare: int = 2) -> DataFrame:
    """First sightings of a valid JA4 by a mature entity: severity, confidence, reasons.

    Mature: enough earlier observations, the first long enough ago. New and rare in the fleet is 5 / .5,
    new but common 2 / .3; an earlier fingerprint with equal first and last part lowers both.
    """
    ok = df.filter(rules.ja4_valid(F.col(fp)))
    row = prior_counts(ok, [*tenant, entity], fp, ts)
    row = row.withColumn("_ac", rules.ja4_ac(F.col(fp)))
    w = Window.partitionBy(*tenant, entity, "_ac").orderBy(ts, fp)
    row = row.withColumn("_similar", F.row_number().over(w) > 1)
    row = fleet_count(row, tenant, entity, fp, ts)
    age = time.epoch(F.col(ts)) - time.epoch(F.col("first_seen"))
    hit = row.filter(F.col("is_new") & (F.col("n_prior") >= min_observations) & (age >= min_span) & (F.col("n_prior_distinct") >= 1))
    is_rare = F.col("n_fleet") <= rare
    severity = F.when(is_rare, 5).otherwise(2) - F.when(F.col("_similar"), 1).otherwise(0)
    confidence = F.when(is_rare, 0.5).otherwise(0.3) * F.when(F.col("_similar"), 0.5).otherwise(1.0)
    reasons = F.array_compact(F.array(F.lit("JA4_NEW_TO_ENTITY"), F.when(is_rare, F.lit("JA4_RARE_IN_FLEET")), F.when(F.col("_similar"), F.lit("JA4_AC_SIMILARITY"))))
    return hit.select(*df.columns, "n_prior", "n_fleet", F.greatest(F.lit(1), severity).alias("severity"), confidence.alias("confidence"), reasons.alias("reasons"))


def rare_values(df: DataFrame, key: list[str], value: str, ts: str, min_known: int = 5, forget: int | None = None) -> DataFrame:
    """Rows whose value the key has not shown (within ``forget`` seconds before), with n_prior_distinct: how many distinct values it had shown before, at least ``min_known``.

    Fingerprint rarity within a tenant and new masters of an outstation are both this. Rows without a value or a time are left out;
    of rows of one value and time, one is taken. Only the first row of each value and stretch of ``forget`` seconds can be new, so
    rows come together in these before anything is ordered: a common value, and a tenant of very many rows, are a few rows by then.
    """
    known = df.filter((F.coalesce(F.col(value).cast("string"), F.lit("")) != "") & F.col(ts).isNotNull())
    stretch = F.lit(0).cast("long") if forget is None else time.bucket(F.col(ts), forget)
    one = known.groupBy(*key, F.col(value).alias("_value"), stretch.alias("_stretch")).agg(
        F.min_by(F.struct(*df.columns), F.col(ts)).alias("_row"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    last = F.lag("_last").over(Window.partitionBy(*key, "_value").orderBy("_stretch"))
    one = one.withColumn("_before", last)
    if forget is not None:
        one = one.filter(F.col("_before").isNull() | (time.epoch(F.col("_first")) - time.epoch(F.col("_before")) > forget))
    else:
        one = one.filter(F.col("_before").isNull())
    fresh = F.col("_before").isNull().cast("long")
    upto = F.sum(fresh).over(Window.partitionBy(*key).orderBy("_first", "_value"))
    one = one.withColumn("n_prior_distinct", upto - fresh).filter(F.col("n_prior_distinct") >= min_known)
    return one.select("_row.*", "n_prior_distinct")
