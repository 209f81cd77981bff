"""Model rows given by the user as literals (a fitted or hand-picked mixture)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MIXTURE_SCHEMA_FIELDS = [
    T.StructField("population", T.LongType(), True),
    T.StructField("alphas", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("rates", T.ArrayType(T.DoubleType(), False), False),
]


def mixture_table(spark: SparkSession, alphas: Sequence[float], rates: Sequence[float],
                  population: int | None = None, segments: Sequence[tuple] | None = None,
                  demo_cols: Sequence[str] = ()) -> DataFrame:
    """A mixture table from literal parameters.

    Without ``segments`` one row ``(population, alphas, rates)`` is returned; with
    ``segments`` (tuples of demo values, each followed by its population) one row per
    segment carrying the same parameters.
    """
    if len(alphas) != len(rates):
        raise ValueError("alphas and rates must have the same length")
    a = [float(x) for x in alphas]
    r = [float(x) for x in rates]
    demo_cols = list(demo_cols)
    fields = [T.StructField(c, T.StringType(), True) for c in demo_cols] + MIXTURE_SCHEMA_FIELDS
    if segments is None:
        rows = [(population, a, r)]
    else:
        rows = [(*seg[:-1], int(seg[-1]), a, r) for seg in segments]
    return spark.createDataFrame(rows, T.StructType(fields))
