"""The queryable evidence plane: pages, timelines, reconstruction, coverage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ENTITY = re.compile(r"^[A-Za-z0-9_.:@/\-]{1,256}$")
HASH = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
MOST_ROWS = 1000
MOST_SECONDS = 86_400


def checked_request(entity: str | None = None, file_hash: str | None = None, page: int = 100, start: float | None = None, end: float | None = None) -> None:
    """Raises ValueError unless a read request's parameters are well-formed and within bounds."""
    if entity is not None and not ENTITY.match(entity):
        raise ValueError("entity is malformed")
    if file_hash is not None and not HASH.match(file_hash.lower()):
        raise ValueError("hash is malformed")
    if not 1 <= page <= MOST_ROWS:
        raise ValueError(f"page size must be 1 to {MOST_ROWS}")
    if start is not None and end is not None and not 0 < end - start <= MOST_SECONDS:
        raise ValueError("the time range must be positive, and a day at most")


def page_after(df: DataFrame, ts: str, ident: str, after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` + 1 rows in order of (ts, ident) after a cursor; the extra row tells that more follow.

    One TakeOrderedAndProject: each task passes on at most that many rows.
    """
    rows = df
    if after is not None:
        t, i = F.lit(after[0]).cast(dict(df.dtypes)[ts]), F.lit(after[1]).cast(dict(df.dtypes)[ident])
        rows = df.filter((F.col(ts) > t) | ((F.col(ts) == t) & (F.col(ident) > i)))
    return rows.orderBy(ts, ident).limit(size + 1)


def observations(df: DataFrame, tenants: list[str], entity: str | None = None, kind: str | None = None, file_hash: str | None = None) -> DataFrame:
    """Observations of the granted tenants that hold an entity, are of a type, or have a digest in any of three slots."""
    out = df.filter(F.col("tenant").isin(*tenants))
    if entity is not None:
        out = out.filter(F.array_contains("entity_values", entity))
    if kind is not None:
        out = out.filter(F.col("type") == kind)
    if file_hash is not None:
        out = out.filter(F.lit(file_hash.lower()).isin(F.col("sha256"), F.col("sha1"), F.col("md5")))
    return out


def findings_of(findings: DataFrame, key: list[str], order: list[str], entity: str, start: Column, end: Column) -> DataFrame:
    """Current findings that name an entity and overlap [start, end): the current revision is picked before any filter."""
    from .latest import current

    now = current(findings, key, order)
    named = F.exists("entities", lambda e: e["value"] == entity)
    return now.filter(named & (F.col("first_seen") < end) & (F.col("last_seen") >= start))


def timeline(**tables: DataFrame) -> DataFrame:
    """Rows of several kinds (each with ts and entity) as one timeline: kind is the table's name; order by ts, kind, then content."""
    parts = [t.withColumn("kind", F.lit(k)) for k, t in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (id) and edges (from, to, relation, label) of a reconstruction."""
    e = edges.select("from", "to", "relation", "label").distinct()
    return e.select(F.explode(F.array("from", "to")).alias("id")).distinct(), e


def attack_coverage(catalog: DataFrame, detectors: DataFrame, observed: DataFrame) -> DataFrame:
    """Techniques of a catalog, of detectors (technique, detector_id) and of findings, with what is known of each.

    detectors: how many claim it; gap: in the catalog but unclaimed.
    """
    c = catalog.select("technique").distinct().withColumn("in_catalog", F.lit(True))
    d = detectors.groupBy("technique").agg(F.countDistinct("detector_id").alias("n_detectors"))
    o = observed.select("technique").filter(F.col("technique").rlike("^T[0-9]{4}(\\.[0-9]{3})?$")).groupBy("technique").agg(F.count(F.lit(1)).alias("n_observed"))
    out = c.join(d, "technique", "full_outer").join(o, "technique", "full_outer")
    out = out.select("technique", F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"), F.coalesce("n_detectors", F.lit(0)).alias("n_detectors"), F.coalesce("n_observed", F.lit(0)).alias("n_observed"))
    return out.withColumn("gap", F.col("in_catalog") & (F.col("n_detectors") == 0))
