"""Rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_int(c) -> Column:
    """Round half away from zero to a BIGINT (weights -> person counts)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double")).cast("bigint")


def stochastic_round(x, u) -> Column:
    """``floor(x) + 1`` with probability ``frac(x)``, else ``floor(x)``; ``u`` is a
    uniform draw in [0, 1), so the expected value is ``x``."""
    x = F.col(x) if isinstance(x, str) else x
    u = F.col(u) if isinstance(u, str) else u
    base = F.floor(x)
    return (base + F.when(u <= x - base, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
