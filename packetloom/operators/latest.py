"""Latest-version semantics: current rows, last write wins, tombstones, replay-safe dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def current(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the largest in ``order``; remaining ties go to the largest row as a whole.

    An aggregate over structs, so each task passes on one row a key.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in df.columns if c not in key]).select(df.columns)


def live_facts(df: DataFrame, key: list[str], version: str, deleted: str) -> DataFrame:
    """Current facts without tombstones; at one version a tombstone beats the fact it ends."""
    return current(df, key, [version, deleted]).filter(F.col(deleted) == 0)


def last_write(df: DataFrame, key: list[str], identity: list[str], order: str, values: list[str]) -> DataFrame:
    """Per key and identity, the values of the last record: later cumulative records replace earlier ones."""
    pick = F.max(F.struct(order, *values)).alias("_last")
    return df.groupBy(*key, *identity).agg(pick).select(*key, *identity, *[F.col(f"_last.{v}").alias(v) for v in values])


def admitted(df: DataFrame, key: list[str], identity: list[str], order: str, cap: int) -> DataFrame:
    """``df`` with admitted: whether the row's identity is among the first ``cap`` of its key by first arrival.

    Batch plans do not need the cap; this exists for parity with a capped store.
    """
    first = df.groupBy(*key, *identity).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*key).orderBy("_first", *identity)
    ranked = first.withColumn("_rank", F.row_number().over(w)).drop("_first")
    return df.join(ranked, [*key, *identity]).withColumn("admitted", F.col("_rank") <= cap).drop("_rank")


def evidence_union(*tables: DataFrame) -> DataFrame:
    """Union of evidence tables without byte-identical replays and without empty observations."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.filter(F.col("observation") != "").distinct()
