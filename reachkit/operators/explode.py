"""Weights to persons: each impression becomes ``round(weight)`` rows with derived ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.functions.rounding import half_up_int
from reachkit.sources.schema import require_columns

CHUNK = 4096  # rows of an impression that are expanded at once


def explode_weights_to_impressions(df: DataFrame, id_col: str = "user_id", sep: str = "") -> DataFrame:
    """Replace every row by ``n = round(weight)`` (half up) rows whose id is
    ``str(id) + sep + str(i)`` for ``i = 1..n``.  Rows with ``n < 1`` or a NULL
    weight vanish.  ``sep=""`` keeps the historical ids (``"1"+"11"`` equals
    ``"11"+"1"``); pass e.g. ``sep="_"`` for collision-free ids.  The other
    columns are kept, ``weight`` included, with the id column first.
    """
    require_columns(df, [id_col, "weight"])
    rest = [c for c in df.columns if c != id_col]
    n = half_up_int("weight")
    return (
        df.withColumn("__n", n)
        .where(F.col("__n") >= 1)
        # two short arrays instead of one of n elements
        .withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / CHUNK).cast("bigint"))))
        .withColumn("__i", F.explode(F.sequence(F.col("__c") * CHUNK + 1, F.least(F.col("__n"), (F.col("__c") + 1) * CHUNK))))
        .select(F.concat(F.col(id_col).cast("string"), F.lit(sep), F.col("__i").cast("string")).alias(id_col),
                *rest)
    )
