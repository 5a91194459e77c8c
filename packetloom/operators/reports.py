"""Reports and exports: record kinds, delivery ledgers, contributors, coverage, detector tables, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .health import discounted
from .joins import asof_join


def record_kind(kind: Column, schema: Column, case_id: Column, verdict: Column, finding_id: Column) -> Column:
    """finding, investigation or verdict: as a record says, else by what it has; null for a kind that is none of these."""
    guess = F.when(schema == "investigation.v1", "investigation").when(case_id.isNotNull() & (verdict.isNotNull() | finding_id.isNull()), "verdict").otherwise("finding")
    out = F.coalesce(kind, guess)
    return F.when(out.isin("finding", "investigation", "verdict"), out)


def exportable_records(records: DataFrame) -> DataFrame:
    """Records (record_kind, schema, tenant, finding_id, revision, investigation_id, case_id, verdict, verdict_revision) that may be
    exported, with kind and identity. Investigations and verdicts need a tenant and an identity of their own, verdicts a revision too."""
    c = F.col
    kind = record_kind(c("record_kind"), c("schema"), c("case_id"), c("verdict"), c("finding_id"))
    named = lambda v: F.coalesce(F.trim(v) != "", F.lit(False))
    sound = (
        F.when(kind == "finding", F.lit(True)).when(kind == "investigation", named(c("tenant")) & named(c("investigation_id")))
        .when(kind == "verdict", named(c("tenant")) & named(c("case_id")) & named(c("verdict")) & F.coalesce(c("verdict_revision") >= 0, F.lit(False))).otherwise(F.lit(False))
    )
    ident = F.when(kind == "investigation", c("investigation_id")).when(kind == "verdict", F.concat_ws(":", "case_id", "verdict_revision")).otherwise(F.concat_ws(":", "finding_id", "revision"))
    return records.withColumns({"kind": kind, "identity": ident}).filter(sound)


def undelivered(records: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """One row for each obligation (``key``) that the ledger does not know as delivered or dead-lettered: a replay sends nothing twice."""
    done = ledger.filter(F.col("outcome").isin("delivered", "dead_lettered")).select(*key).distinct()
    return records.dropDuplicates(key).join(done, key, "left_anti")


def settled(attempts: DataFrame, key: list[str], most: int = 5, backoff: float = 1.0) -> DataFrame:
    """The ledger compacted: per obligation its outcome by its attempts (at in seconds, accepted).

    delivered once an attempt was accepted, dead_lettered after ``most`` that were not, else retry, due ``backoff`` times 2 to
    the number of failures after the last one.
    """
    one = attempts.groupBy(*key).agg(F.bool_or("accepted").alias("_ok"), F.count_if(~F.col("accepted")).alias("failures"), F.max("at").alias("last_at"))
    outcome = F.when(F.col("_ok"), "delivered").when(F.col("failures") >= most, "dead_lettered").otherwise("retry")
    due = F.when(outcome == "retry", F.col("last_at") + backoff * F.pow(F.lit(2.0), F.col("failures") - 1))
    return one.withColumns({"outcome": outcome, "due_at": due}).drop("_ok")


def contributors(events: DataFrame, key: list[str], member: str, ts: str, most: int = 100) -> DataFrame:
    """Per key: n rows, the distinct members in the order they were first seen (the first ``most``), n_members, truncated."""
    first = events.groupBy(*key, member).agg(F.min(ts).alias("_at"), F.count(F.lit(1)).alias("_n"))
    some = F.filter(F.array_sort(F.collect_list(F.struct("_at", F.col(member).alias("m")))), lambda x: x["m"].isNotNull())
    one = first.groupBy(*key).agg(F.sum("_n").alias("n"), some.alias("_m"))
    return one.select(*key, "n", F.slice("_m", 1, most)["m"].alias("members"), F.size("_m").alias("n_members"), (F.size("_m") > most).alias("truncated"))


def contained(required: DataFrame, found: DataFrame, key: list[str], member: str) -> DataFrame:
    """Per key of ``required``: how many members it has, how many of them ``found`` lacks, and whether it has all."""
    have = found.select(*key, member).distinct().withColumn("_have", F.lit(1))
    row = required.select(*key, member).distinct().join(have, [*key, member], "left")
    return row.groupBy(*key).agg(F.count(F.lit(1)).alias("n_required"), F.count_if(F.col("_have").isNull()).alias("n_missing")).withColumn("complete", F.col("n_missing") == 0)


def asset_lookup(rows: DataFrame, on: str, table: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with the values of a lookup table under the same name, case aside; of several entries the smallest counts."""
    known = table.groupBy(F.lower(on).alias("_key")).agg(F.min(F.struct(*values)).alias("_v"))
    return rows.join(known, F.lower(F.col(on)) == F.col("_key"), "left").select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def quality_at(findings: DataFrame, quality: DataFrame, sensor: str, ts: str, at: str, within: int = 900) -> DataFrame:
    """Findings with the label that their sensor's quality had at their time (null beyond ``within`` seconds), and confidence discounted by it."""
    row = asof_join(findings, quality, [sensor], ts, at, ["quality"], within=within)
    return row.withColumn("discounted", discounted(F.col("confidence"), F.coalesce("quality", F.lit("unknown"))))


def overlap_table(expected: DataFrame, got: DataFrame, by: str, entities: str) -> DataFrame:
    """Per detector: tp, fp, fn, precision and recall (1 for empty denominators), an expectation and a finding matching if they share an entity."""
    want = expected.select(by, F.monotonically_increasing_id().alias("_i"), F.col(entities))
    have = got.select(by, F.monotonically_increasing_id().alias("_i"), F.col(entities))
    one = lambda df: df.select(by, "_i", F.explode_outer(entities).alias("_e"))

    def hits(a: DataFrame, b: DataFrame, hit: str, miss: str) -> DataFrame:
        seen = one(b).filter("_e IS NOT NULL").select(by, "_e").distinct().withColumn("_hit", F.lit(True))
        each = one(a).join(seen, [by, "_e"], "left").groupBy(by, "_i").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit"))
        return each.groupBy(by).agg(F.count_if("_hit").alias(hit), F.count_if(~F.col("_hit")).alias(miss))

    out = hits(want, have, "tp", "fn").join(hits(have, want, "_t", "fp").drop("_t"), by, "full_outer").fillna(0, ["tp", "fp", "fn"])
    ratio = lambda n: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(n)), F.lit(1.0))
    return out.select(by, "tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))


def class_counts(coverage: DataFrame, column: str, classes: tuple[str, ...] = ("full", "partial", "none")) -> DataFrame:
    """One row: how many entries are of each class, 0 where there are none."""
    return coverage.agg(*[F.count_if(F.col(column) == c).alias(f"n_{c}") for c in classes])


def campaign(scores: DataFrame, rates: tuple[str, ...], means: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    """One row over scored tasks: tasks, the share of true flags, means of numbers (both to three digits, 0 without tasks), and counts of true flags."""
    share = lambda v: F.coalesce(F.round(F.avg(v), 3), F.lit(0.0))
    return scores.agg(
        F.count(F.lit(1)).alias("tasks"), *[share(F.col(c).cast("int")).alias(f"{c}_rate") for c in rates], *[share(F.col(c)).alias(f"mean_{c}") for c in means],
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in counts],
    )


def recovery(findings: DataFrame, key: list[str], order: list[str], state: str, waiting: tuple[str, ...], most: int = 10_000) -> tuple[DataFrame, bool]:
    """Current findings that still wait for enrichment, in order of their key, and whether that is all of them.

    A recovery that stops at ``most`` rows is not complete, and says so.
    """
    from .latest import current

    rows = current(findings, key, order).filter(F.col(state).isin(*waiting)).orderBy(*key)
    return rows.limit(most), rows.limit(most + 1).count() <= most


def eve_lines(records: DataFrame) -> DataFrame:
    """Records as JSON lines of the sensor's form: compact, without absent fields."""
    return records.select(F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value"))
