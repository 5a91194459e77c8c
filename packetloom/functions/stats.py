"""Robust statistics over arrays, and scores built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let


def _at(xs: Column, i: Column) -> Column:
    return F.get(xs, i.cast("int"))


def sorted_median(xs: Column) -> Column:
    """Median of a sorted array; null if it is empty."""

    def middle(v: Column) -> Column:
        n = F.size(v)
        half = F.floor(n / 2)
        return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, _at(v, half)).otherwise((_at(v, half - 1) + _at(v, half)) / 2.0).cast("double")

    return let(xs, middle)


def quartiles(xs: Column) -> tuple[Column, Column, Column]:
    """Q1, median and Q3 of a sorted array: medians of the halves on either side of the median (Tukey).

    The middle element of an odd number belongs to neither half; a single element is all three.
    """
    n = F.size(xs)
    half = F.floor(n / 2).cast("int")
    low = F.slice(xs, F.lit(1), F.greatest(half, F.lit(1)))
    high = F.slice(xs, F.greatest(n - half + 1, F.lit(1)), F.greatest(half, F.lit(1)))
    one = _at(xs, F.lit(0)).cast("double")
    pick = lambda part: F.when(n < 2, one).otherwise(sorted_median(part))
    return pick(low), sorted_median(xs), pick(high)


def _quartile_struct(xs: Column) -> Column:
    q1, q2, q3 = quartiles(xs)
    return F.struct(q1.alias("q1"), q2.alias("q2"), q3.alias("q3"))


def bowley_score(xs: Column) -> Column:
    """1 - |Bowley skewness| of a sorted array, 0 at least; 1 without spread."""

    def score(q: Column) -> Column:
        spread = q["q3"] - q["q1"]
        return F.when(spread == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs((q["q3"] + q["q1"] - 2.0 * q["q2"]) / spread)))

    return let(xs, lambda v: let(_quartile_struct(v), score))


def madm_score(xs: Column) -> Column:
    """1 - median absolute deviation / median of a sorted array, 0 at least; 0 for a median of 0 or less."""

    def score(v: Column, mid: Column) -> Column:
        mad = sorted_median(F.array_sort(F.transform(v, lambda x: F.abs(x - mid))))
        return F.when(mid <= 0, F.lit(0.0)).otherwise(1.0 - F.least(mad / mid, F.lit(1.0)))

    return let(xs, lambda v: let(sorted_median(v), lambda mid: score(v, mid)))


def regularity(xs: Column) -> Column:
    """How regular the values of a sorted array are, 0 to 1."""
    return let(xs, lambda v: (bowley_score(v) + madm_score(v)) / 2.0)


def gaps(sorted_ts: Column, keep_zero: bool = False) -> Column:
    """Differences of neighbours in a sorted array of seconds."""
    d = F.transform(F.slice(sorted_ts, F.lit(2), F.greatest(F.size(sorted_ts) - 1, F.lit(0))), lambda x, i: x - F.get(sorted_ts, i))
    return d if keep_zero else F.filter(d, lambda x: x > 0)


def beacon_score(ts: Column, sizes: Column | None = None, min_conns: int = 6, target: int = 12, half_up: bool = True) -> Column:
    """(2 * regularity + count score) / 3, to three digits; 0 for too few connections or no gap.

    Gaps of zero are left out. With at least ``min_conns`` sizes, the regularity is the mean of that
    of the gaps and that of the sizes. ``half_up`` False rounds ties to even.
    """
    count = F.least(F.lit(1.0), F.size(ts) / float(target))
    near = F.round if half_up else F.bround

    def score(gap: Column) -> Column:
        reg = regularity(gap)
        if sizes is not None:
            both = let(reg, lambda r: 0.5 * r + 0.5 * regularity(F.array_sort(sizes)))
            reg = F.when(F.size(sizes) >= min_conns, both).otherwise(reg)
        return F.when((F.size(ts) >= min_conns) & (F.size(gap) > 0), near((2.0 * reg + count) / 3.0, 3)).otherwise(F.lit(0.0))

    return let(F.array_sort(ts), lambda at: let(F.array_sort(gaps(at)), score))


def capped(value: Column, full: float) -> Column:
    """value / full, 1 at most, to three digits."""
    return F.round(F.least(F.lit(1.0), value / F.lit(float(full))), 3)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column, Column]:
    """Rate and its Wilson interval (low, high); null for n = 0."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    some = lambda c: F.when(n > 0, c)
    return some(p), some(F.greatest(F.lit(0.0), mid - half)), some(F.least(F.lit(1.0), mid + half))


def decayed(value: Column, age: Column, half_life: float) -> Column:
    """value halved every ``half_life`` seconds of age; a negative age counts as 0."""
    return value * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / float(half_life))
