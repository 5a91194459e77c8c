"""Building blocks of expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Without this, a nested expression repeats its parts at each mention and grows exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
