"""Exposure windows: the n-th exposure of an id, its total frequency, first-exposure flag.

A hot id (the NULL id, VID 0) may hold a third of all rows, all of them within a day, a second or an
instant, so the rows are cut into ranges at keys drawn from the data, ranked per id and range, and the id's
rows in earlier ranges are added (``plans.prefix.ranked_by_ranges``): one shuffle of the rows and no join.
``bucket=`` names a rule of fixed buckets of the order column instead (``plans.prefix.time_bucket``), and
``bucket=None`` ranks each id in one window, for tables known to have no hot id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachkit.plans.prefix import bucketed_row_number, ranked_by_ranges
from reachkit.sources.schema import as_list, require_columns

RANGES = "ranges"


def add_exposure_index(df: DataFrame, id_col: str = "user_id", order_col: str = "timestamp",
                       tiebreak=None, bucket=RANGES) -> DataFrame:
    """Add ``exposure_index``: 1 for the id's earliest row, 2 for the next, ...

    NULL ids form one group; NULL times come first.  Rows tied on ``order_col`` are
    ordered by ``tiebreak`` columns when given (otherwise arbitrarily).
    """
    return _ranked(df, id_col, order_col, tiebreak, bucket, None)


def add_frequency_total(df: DataFrame, id_col: str = "user_id", order_col: str = "timestamp",
                        tiebreak=None, bucket=RANGES) -> DataFrame:
    """Add ``exposure_index`` and ``frequency_total`` (number of rows of the id)."""
    return _ranked(df, id_col, order_col, tiebreak, bucket, "frequency_total")


def add_first_exposure(df: DataFrame, id_col: str = "user_id", order_col: str = "timestamp",
                       tiebreak=None, bucket=RANGES) -> DataFrame:
    """Add ``exposure_index`` and ``is_first`` (1 on the id's first row, else 0)."""
    out = add_exposure_index(df, id_col, order_col, tiebreak, bucket)
    return out.withColumn("is_first", F.when(F.col("exposure_index") == 1, 1).otherwise(0))


def _ranked(df, id_col, order_col, tiebreak, bucket, total_col) -> DataFrame:
    require_columns(df, [id_col], "id_col")
    require_columns(df, [order_col], "order_col")
    order = [order_col, *as_list(tiebreak)]
    if bucket == RANGES:
        return ranked_by_ranges(df, [id_col], order, "exposure_index", total_col)
    if bucket is not None:
        return bucketed_row_number(df, [id_col], order, "exposure_index", bucket, total_col)
    out = df.withColumn("exposure_index", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)).cast("bigint"))
    return out if total_col is None else out.withColumn(total_col, F.count(F.lit(1)).over(Window.partitionBy(id_col)))
