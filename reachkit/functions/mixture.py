"""The mixture-of-deltas reach curve as a column expression.

``R(g) = sum_i alpha_i * (1 - exp(-x_i * g))`` where ``g`` is impressions per
person; evaluated with higher-order array functions so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def params_array(values: Sequence[float]) -> Column:
    """A literal ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def mixture_reach(alphas, rates, g) -> Column:
    """Reached share of the population at ``g`` impressions per person."""
    alphas = F.col(alphas) if isinstance(alphas, str) else alphas
    rates = F.col(rates) if isinstance(rates, str) else rates
    g = F.col(g) if isinstance(g, str) else g
    terms = F.zip_with(alphas, rates, lambda a, x: a * (F.lit(1.0) - F.exp(-x * g)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def array_sum(arr) -> Column:
    """Sum of a numeric array column (left to right)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
