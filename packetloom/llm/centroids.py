"""Centroid clustering in exact integers, with Drake's adaptive bounds.

Each vector keeps its centroid, lower bounds of the distances to the few centroids next
nearest, and one more for all the rest. When centroids move, the bounds move by as much as
their centroid did. Where the distance to the own centroid stays under every bound, nothing
else is computed; where it does not, only the centroids whose bounds could be undercut are
measured again, and all of them where the bound of the rest is. Bounds are rounded outwards and
compared strictly, distances are exact, so assignments (ties included) are those of measuring
every distance. The number of bounds adapts: from a quarter of the centroids down to an
eighth, as deep as the last round had to look.

Only centroids (a fixed number) and per-cluster sums leave the executors. Vectors stay in one
table, rewritten with their bounds in every round; nothing is shuffled but the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import Workspace, small_batches

SCALE, SIZE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components are held within this, so that a squared distance of up to 64 components fits a long.
LARGEST = 1 << 27
#: Below this, doubles hold all sums exactly.
DOUBLE = 1 << 22
CHUNK = 16_384
#: What bounds are widened by, far above the rounding of a square root.
OUT = 1e-9


def grid(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and ``x``, the integers floor(scale * component), of vectors with exactly ``size`` components, none null or non-finite."""
    small_batches(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            if not pa.types.is_list(column.type):
                column = column.cast(pa.list_(column.type.value_type))
            flat, off = column.values, column.offsets.to_numpy().astype(np.int64)
            real = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            keep = np.flatnonzero((np.diff(off) == size) & np.asarray(column.is_valid()))
            at = off[:-1][keep][:, None] + np.arange(size)
            value = real[at] if len(keep) else np.empty((0, size))
            good = np.isfinite(value).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(value[good] * float(scale)), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep[good])), _lists(x)], ["vec_id", "x"])

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("x", T.ArrayType(T.IntegerType()))])
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def seeds(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order; fewer where there are fewer. Rows of one vec_id follow in the order of their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(key, "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the rows of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < DOUBLE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = (d * d).sum(axis=1)
    return out


def own_squared(x: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    d = x - c[a]
    return (d * d).sum(axis=1)


class Bounds:
    """Of a chunk of vectors: ``near`` (the centroid, then those next nearest), ``low`` (their lower bounds, the first unused) and ``rest`` (of all others)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.near, self.low, self.rest = near, low, rest


def scan(x: np.ndarray, c: np.ndarray, keep: int) -> tuple[np.ndarray, Bounds]:
    """All distances: the own one, and fresh bounds with ``keep`` centroids besides the own."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable").astype(np.int8 if len(c) < 128 else np.int32)  # ties: the smaller number first
    root = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64)) * (1 - OUT)
    rest = root[:, keep + 1] if len(c) > keep + 1 else np.full(len(x), np.inf)
    return np.take_along_axis(d, order[:, :1].astype(np.int64), axis=1)[:, 0], Bounds(order[:, : keep + 1], root[:, : keep + 1], rest)


def assign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds, keep: int) -> tuple[np.ndarray, Bounds, np.ndarray]:
    """Exact distances to the nearest centroids ``c``, the bounds after them, and how many other centroids each vector had measured.

    ``moved`` is how far each centroid is from where it was when the bounds were right.
    """
    n, k = len(x), len(c)
    near = old.near.astype(np.int64)
    width = near.shape[1]
    own = own_squared(x, c, near[:, 0])
    upper = np.sqrt(own.astype(np.float64)) * (1 + OUT)
    low = np.maximum(old.low - moved[near], 0)
    rest = np.maximum(old.rest - moved.max(initial=0), 0)
    # a bound of each place that holds for it and all behind it
    tail = np.minimum.accumulate(np.concatenate([low[:, 1:], rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    # the first place from which on everything is farther than the own centroid: what comes before has to be measured
    sure = upper[:, None] < tail
    depth = np.where(sure.any(axis=1), sure.argmax(axis=1), width)
    for want in range(1, width):
        rows = np.flatnonzero(depth == want)
        if not len(rows):
            continue
        # measure the own and the next ``want`` centroids; the others are farther than the own, so than the nearest of these
        some = near[rows, : want + 1]
        d = np.empty(some.shape, np.int64)
        d[:, 0] = own[rows]
        for j in range(1, want + 1):
            d[:, j] = own_squared(x[rows], c, some[:, j])
        order = np.lexsort((some, d), axis=1)
        some, d = np.take_along_axis(some, order, axis=1), np.take_along_axis(d, order, axis=1)
        near[rows, : want + 1], own[rows] = some, d[:, 0]
        low[rows, : want + 1] = np.sqrt(d.astype(np.float64)) * (1 - OUT)
    deep = np.flatnonzero(depth == width)
    if len(deep):
        own[deep], fresh = scan(x[deep], c, width - 1)
        near[deep], low[deep], rest[deep] = fresh.near, fresh.low, fresh.rest
        depth[deep] = k - 1
    if keep + 1 < width:  # fewer bounds from now on: those given up join the rest
        rest = np.minimum(rest, low[:, keep + 1 :].min(axis=1))
        near, low = near[:, : keep + 1], low[:, : keep + 1]
    return own, Bounds(near.astype(old.near.dtype), low, rest), depth


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width or 1, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(dtype) if n else np.empty((0, 0), dtype)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _round(points: DataFrame, c: np.ndarray, moved: np.ndarray | None, keep: int) -> DataFrame:
    """``points`` with cluster, distance, bounds and the number of other centroids measured (``seen``)."""

    def run(batches):
        for b in _chunks(batches):
            x = _matrix(b.column("x"), np.int64)
            if moved is None:
                own, bounds = scan(x, c, keep)
                seen = np.full(len(x), len(c) - 1)
            else:
                old = Bounds(_matrix(b.column("near"), np.int32), _matrix(b.column("low"), np.float64), b.column("rest").to_numpy())
                own, bounds, seen = assign(x, c, moved, old, keep)
            near = bounds.near.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("x"), pa.array(near[:, 0]), pa.array(own), _lists(near), _lists(bounds.low), pa.array(bounds.rest), pa.array(seen.astype(np.int32))],
                ["vec_id", "x", "cluster", "distance", "near", "low", "rest", "seen"],
            )

    kind = T._parse_datatype_string("x array<int>, cluster int, distance long, near array<int>, low array<double>, rest double, seen int")
    return points.mapInArrow(run, T.StructType([points.schema["vec_id"], *kind.fields]))


def _sums(points: DataFrame, clusters: int, size: int) -> dict[int, tuple[int, list[int], int]]:
    """Of each cluster that has vectors: their number, the componentwise sums, and the most centroids that one of them measured."""

    def run(batches):
        count, total, seen = np.zeros(clusters, np.int64), np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int32)
        for b in _chunks(batches):
            at = b.column("cluster").to_numpy()
            count += np.bincount(at, minlength=clusters)
            np.add.at(total, at, _matrix(b.column("x"), np.int64))
            np.maximum.at(seen, at, b.column("seen").to_numpy())
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(seen[used]), _lists(total[used])], ["cluster", "n", "seen", "total"])

    part = points.select("cluster", "x", "seen").mapInArrow(run, "cluster int, n long, seen int, total array<long>")
    flat = part.select("cluster", "n", "seen", *[F.element_at("total", j + 1).alias(f"t{j}") for j in range(size)])
    found = flat.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"), *[F.sum(f"t{j}").alias(f"t{j}") for j in range(size)])
    return {r["cluster"]: (r["n"], [r[f"t{j}"] for j in range(size)], r["seen"]) for r in found.collect()}  # a row a cluster


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, watch: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, or with a null or non-finite component, are left out. Components become floor(scale * x);
    beyond 2^27 either way they count as 2^27, so that squared distances fit a long. The first centroids are the vectors with
    the smallest SHA-256 of ``1:<vec_id>`` (a null vec_id is the empty string there); with fewer vectors than ``clusters`` there
    are as many centroids as vectors. A round assigns every vector to its nearest centroid (ties: the smaller number) and moves
    centroids to the floor of the mean; a centroid without vectors stays. Repeated rows count as often as they come.
    ``watch`` is shown each round's table (with ``seen``, the number of other centroids that a vector had measured).
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    points = ws.save(grid(vectors, size, scale), "points")
    c = seeds(points, clusters)
    k = len(c)
    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    if not k:
        return spark.createDataFrame([], schema)
    keep, least, moved = max(1, k // 4), max(1, k // 8), None
    keep, least = min(keep, k - 1), min(least, k - 1)
    for step in range(rounds + 1):
        table = ws.save(_round(points, c, moved, keep), f"round-{step}")
        if watch:
            watch(table)
        ws.drop(f"round-{step - 1}" if step else "points")
        points = table
        if step == rounds:
            break
        found = _sums(table, k, size)
        was = c
        c = np.array([[s // found[j][0] for s in found[j][1]] if j in found else was[j].tolist() for j in range(k)], dtype=np.int64).reshape(k, size)
        moved = np.sqrt(np.diag(squared(was, c)).astype(np.float64)) * (1 + OUT)
        if step:  # as many bounds as the last round looked behind, within a quarter and an eighth of the centroids
            keep = max(least, min(keep, max(seen for _, _, seen in found.values())))
    sums = points.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row a cluster
    total = sum(r["s"] for r in sums)
    named = [(r["cluster"], r["s"], total, hashlib.sha256(",".join(map(str, c[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return points.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select(*schema.names)


def op13(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""
d{i} AS (SELECT r, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{i} c USING (j) GROUP BY r, k),
a{i} AS MATERIALIZED (SELECT r, k, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)""")
        if i < ROUNDS:
            rounds.append(f"""
s{i} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT k, j, coalesce((s - (s % n + n) % n) // n, c.x) AS x FROM c{i} c LEFT JOIN s{i} USING (k, j))""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT r, unnest(range(1, {SIZE + 1})) AS j, unnest(list_transform(e, lambda x: floor({SCALE} * x)::BIGINT)) AS x FROM e),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM e QUALIFY k < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT k, j, x FROM f JOIN v USING (r)),{",".join(rounds)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)
"""


ORACLE = _oracle()
