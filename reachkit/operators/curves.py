"""Curve views: every ``jump``-th point of a reach curve, the head of a frequency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.plans.prefix import bucketed_row_number
from reachkit.sources.schema import as_list, require_columns


def reach_points(reach: DataFrame, demo_cols=None, jump: int = 100, bucket=None) -> DataFrame:
    """Points 1, 1 + jump, 1 + 2*jump, ... of each curve in time order
    (``point`` = 1-based position).  Positions come from the bucketed rank, so
    a long un-segmented curve is not sorted in one task."""
    demos = as_list(demo_cols)
    require_columns(reach, [*demos, "timestamp"])
    ranked = bucketed_row_number(reach, demos, ["timestamp"], "point", bucket)
    return ranked.where((F.col("point") - 1) % F.lit(int(jump)) == 0)


def frequency_head(frequency: DataFrame, demo_cols=None, n_bars: int = 20) -> DataFrame:
    """The ``n_bars`` lowest frequencies of each curve (a top-k per segment)."""
    demos = as_list(demo_cols)
    require_columns(frequency, [*demos, "frequency_total"])
    if not demos:
        return frequency.orderBy("frequency_total").limit(int(n_bars))
    w = Window.partitionBy(*demos).orderBy("frequency_total")
    return (frequency.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") <= int(n_bars)).drop("__rn"))
