"""Frequency tables: how many ids were exposed exactly k times (overall or per segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.sources.schema import as_list, require_columns


def generate_frequency_table(df: DataFrame, id_col: str = "user_id", demo_cols=None) -> DataFrame:
    """``[demos], frequency_total, "<id_col> counts"`` sorted by segment and frequency.

    ``frequency_total`` counts all rows of an id.  With segments, an id seen in
    several segments counts once in each of them, with its overall frequency.
    Two partially aggregated ``groupBy``s; the per-id window only runs over the
    (id, segment) pairs, never over raw rows.
    """
    demos = as_list(demo_cols)
    require_columns(df, [id_col], "id_col")
    require_columns(df, demos)
    count_col = f"{id_col} counts"
    if not demos:
        per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("frequency_total"))
    else:
        pairs = df.groupBy(id_col, *demos).agg(F.count(F.lit(1)).alias("__n"))
        per_id = pairs.withColumn("frequency_total", F.sum("__n").over(Window.partitionBy(id_col)))
    return (
        per_id.groupBy(*demos, "frequency_total")
        .agg(F.count(F.lit(1)).alias(count_col))
        .orderBy(*demos, "frequency_total")
    )
