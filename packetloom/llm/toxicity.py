"""Toxicity as a severity grade, by cumulative-link ordinal regression.

For grades 0 < 1 < ... < G - 1 the model has one weight vector w and increasing thresholds t:
P(grade <= g) = logistic(t[g] - w . x), the weights shared by all thresholds. x tells which words
a text has (each hashed to one of 2 ** ``BITS`` places); words get a weight only if the training
rows show that they go with the grade (a likelihood-ratio test), which keeps x sparse and the many
words that say nothing from adding up. A text's severity is its expected grade.

Labels that only say toxic or not are graded first: toxic training rows by how many of the words
that go with toxicity they have (see ``MARKERS``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text
from ._store import small_batches

BITS = 20
#: Labelled rows that training uses at most: those whose ids hash lowest. What the driver holds of
#: one is 4 bytes per distinct word.
TRAIN_ROWS = 10_000
#: A word needs this many training rows, and this likelihood ratio (G, chance level about 4), to get a weight.
LEAST_ROWS = 3
LEAST_RATIO = 16.0
#: Markers from which a toxic row of yes-or-no labels has grade 2, 3, ...; with fewer it has grade 1.
MARKERS = (3, 6)
STEPS = 200
PENALTY = 1e-4


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word places of each text, one text after another, with offsets."""
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    h, off = _text.word_hashes(data, _text.ALNUM)
    key = (np.repeat(np.arange(len(texts)), np.diff(off)) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(key)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(texts) + 1))


def likelihood_ratio(with_word: np.ndarray, high: np.ndarray, n: int, n_high: int) -> np.ndarray:
    """G statistic of words: rows with the word, and those of them with a grade of 1 or more, of n and n_high rows."""

    def term(seen, rows, share):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(rows * share, 1e-300)), 0.0)

    p = n_high / n
    low, rest, rest_high = with_word - high, n - with_word, n_high - high
    return 2 * (term(high, with_word, p) + term(low, with_word, 1 - p) + term(rest_high, rest, p) + term(rest - rest_high, rest, 1 - p))


def refined(places: np.ndarray, off: np.ndarray, toxic: np.ndarray, markers: tuple[int, ...] = MARKERS, least: int = LEAST_ROWS, ratio: float = LEAST_RATIO) -> np.ndarray:
    """Grades of yes-or-no labels: 0 if not toxic, else 1 more for each number of ``markers`` that the row's markers reach."""
    kept, inverse, count = np.unique(places, return_inverse=True, return_counts=True)
    high = np.bincount(inverse, np.repeat(toxic > 0, np.diff(off)).astype(float), len(kept))
    n, n_high = len(toxic), int((toxic > 0).sum())
    mark = (count >= least) & (high * n > count * n_high) & (likelihood_ratio(count.astype(float), high, n, n_high) >= ratio)
    found = np.bincount(np.repeat(np.arange(n), np.diff(off)), mark[inverse].astype(float), n)
    return np.where(toxic > 0, 1 + (found[:, None] >= np.array(markers)).sum(axis=1), 0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class CumulativeLink:
    """Weights by word place, and the thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, places: np.ndarray, off: np.ndarray, grade: np.ndarray, grades: int, steps: int = STEPS, penalty: float = PENALTY, least: int = LEAST_ROWS, ratio: float = LEAST_RATIO) -> CumulativeLink:
        """Adam on the mean log-likelihood of the grades, over all rows in every step."""
        kept, inverse, count = np.unique(places, return_inverse=True, return_counts=True)
        high = np.bincount(inverse, np.repeat(grade > 0, np.diff(off)).astype(float), len(kept))
        use = (count >= least) & (likelihood_ratio(count.astype(float), high, len(grade), int((grade > 0).sum())) >= ratio)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[use[inverse]]
        col = (np.cumsum(use) - 1)[inverse[use[inverse]]]
        n, d = len(grade), int(use.sum())
        freq = np.array([(grade <= g).sum() for g in range(grades - 1)], float)
        start = np.log((freq + 0.5) / (n - freq + 0.5))
        # thresholds t[g] = p[0] + sum of exp(p[1..g]) increase for any p
        p = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2)), np.zeros(d)])
        k, m, v = grades - 1, np.zeros(grades - 1 + d), np.zeros(grades - 1 + d)
        for step in range(1, steps + 1):
            t = np.cumsum(np.concatenate([p[:1], np.exp(p[1:k])]))
            z = np.bincount(row, p[k:][col], n)
            upper = np.where(grade < k, _logistic(np.append(t, np.inf)[grade] - z), 1.0)
            lower = np.where(grade > 0, _logistic(np.append(-np.inf, t)[grade] - z), 0.0)
            prob = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
            dz = (du - dl) / n  # of the negative log-likelihood by z
            dt = np.bincount(grade, -du / n, grades)[:k] + np.bincount(grade, dl / n, grades)[1:]
            tail = np.cumsum(dt[::-1])[::-1]
            g = np.concatenate([tail[:1], tail[1:] * np.exp(p[1:k]), np.bincount(col, dz[row], d) + penalty * p[k:]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.zeros(1 << BITS, np.float32)
        w[kept[use]] = p[k:]
        return cls(w, np.cumsum(np.concatenate([p[:1], np.exp(p[1:k])])))

    def severity(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and P(grade >= 1), of each text."""
        places, off = features(texts)
        run = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=float)])
        above = _logistic((run[off[1:]] - run[off[:-1]])[:, None] - self.thresholds)
        return above.sum(axis=1), above[:, 0]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, grades: int | None = None) -> CumulativeLink:
    """A model from labels (doc_id, grade from 0), on at most ``rows`` of them; null grades are left out.

    An id counts once: with its highest grade and, of several texts under it, one. Labels with the grades 0 and 1 alone are refined. Without two grades among the labels every
    text gets the labels' only grade, or 0.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("doc_id"), F.lit(4))
    pick = labels.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    pick = pick.orderBy(key, "doc_id").limit(rows).select(F.col("doc_id").alias("__pl_id"), F.col("grade").cast("int").alias("__pl_grade"))
    texts = docs.join(F.broadcast(pick), F.col("doc_id") == F.col("__pl_id")).select("doc_id", F.col("__pl_grade").alias("grade"), "text")

    def run(batches):
        for batch in batches:
            text = _text.strings(batch.column("text"))
            for a, b in _text.groups_of([len(t or "") for t in text], _text.SLAB):
                places, off = features(text[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("grade").slice(a, b - a), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(places))], ["doc_id", "grade", "places"])

    schema = T.StructType([texts.schema["doc_id"], *T._parse_datatype_string("grade int, places array<int>").fields])
    got = texts.mapInArrow(run, schema).groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("places").alias("places"))
    got = got.orderBy("doc_id").toArrow()
    grade = got.column("grade").to_numpy()
    top = grades or (int(grade.max()) + 1 if len(grade) else 1)
    if len(np.unique(grade)) < 2:
        only = int(grade[0]) if len(grade) else 0
        return CumulativeLink(np.zeros(1 << BITS, np.float32), np.where(np.arange(max(1, top - 1)) < only, -50.0, 50.0))
    lists = got.column("places").combine_chunks()
    flat = lists.flatten().to_numpy()
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    grade = grade.astype(np.int64)
    if top == 2:
        grade = refined(flat, off, grade)
    return CumulativeLink.fit(flat, off, grade, max(top, int(grade.max()) + 1))


def score(docs: DataFrame, model: CumulativeLink, cut: float = 0.5) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic (of grade 1 or more) and toxic (p_toxic >= cut).

    A null or empty text is scored as one without words; bytes that are no UTF-8 as replacement characters. Columns of ``docs`` with these names are
    replaced.
    """
    kept = docs.select([c for c in docs.columns if c not in ("severity", "p_toxic", "toxic")])
    more = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = _text.strings(batch.column("text"))
            for a, b in _text.groups_of([len(t or "") for t in text], _text.SLAB):
                value, p = shared.value.severity(text[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(p)], names=[*part.schema.names, "severity", "p_toxic"])

    out = kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))
    return out.withColumn("toxic", F.col("p_toxic") >= cut)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("grade")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "toxic")
