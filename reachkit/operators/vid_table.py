"""VID assignment tables: per segment and pool, a probability bucket and a VID range.

Pool j of a segment with population P and mixture (alpha, x):
  * probability bucket ``[sum_{i<j} a_i x_i, sum_{i<=j} a_i x_i)`` (divided by
    kappa = sum a_i x_i when normalised);
  * ``total_VID = ceil(alpha_j * P)`` VIDs starting at ``start_VID``; ranges are
    consecutive from 1, pool after pool, segment after segment (segments in
    ascending demo order);
  * without normalisation a *null pool* ``[kappa, 1.0)`` maps to VID 0.

The prefix sums inside a segment run over the parameter arrays
(higher-order functions, summed left to right).  The table is built in one pass
over the mixture: the null pool is one more element of the exploded pool array,
and a segment's VID offset is a window sum over the mixture table, which has one
row per segment (a model table; people and impressions never pass through it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachkit.functions.mixture import array_sum
from reachkit.sources.schema import as_list, require_columns

VID_COLUMNS = ["prob_>=", "prob_<", "alpha", "rate", "start_VID", "total_VID"]


def _prefix(arr: Column, k: Column) -> Column:
    """Sum of the first ``k`` elements (left to right)."""
    return F.aggregate(F.slice(arr, 1, k), F.lit(0.0), lambda acc, v: acc + v)


def _prefix_long(arr: Column, k: Column) -> Column:
    return F.aggregate(F.slice(arr, 1, k), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def _segment_arrays(mixture: DataFrame, demos: list[str], population: Column) -> DataFrame:
    """Per segment: kappa, pool totals and the VID offset of the segment."""
    aks = F.zip_with("alphas", "rates", lambda a, x: a * x)
    totals = F.transform("alphas", lambda a: F.ceil(a * population).cast("bigint"))
    seg = mixture.select(
        *demos,
        F.col("alphas"), F.col("rates"),
        aks.alias("__ak"),
        totals.alias("__tot"),
    ).withColumn("__kappa", array_sum("__ak")) \
     .withColumn("__used", F.aggregate("__tot", F.lit(0).cast("bigint"), lambda acc, v: acc + v))
    if not demos:
        return seg.withColumn("__offset", F.lit(0).cast("bigint"))
    # VIDs used by all earlier segments, in demo order (one row per segment)
    earlier = Window.orderBy(*demos).rowsBetween(Window.unboundedPreceding, -1)
    return seg.withColumn("__offset", F.coalesce(F.sum("__used").over(earlier), F.lit(0)).cast("bigint"))


def generate_vid_assignment_table(mixture: DataFrame, population_size: int | None = None,
                                  demo_cols=None, normalize: bool = False) -> DataFrame:
    """VID table ``[demos], prob_>=, prob_<, alpha, rate, start_VID, total_VID``.

    ``mixture`` has ``alphas``/``rates`` arrays (any length, per segment) and, for
    segments or when ``population_size`` is None, a ``population`` column.
    ``normalize=True`` divides the buckets by kappa and emits no null pool
    (kappa = 0 then raises).  The table has (segments x pools) rows: a model table,
    small by construction.
    """
    demos = as_list(demo_cols)
    require_columns(mixture, ["alphas", "rates", *demos])
    if demos or population_size is None:
        require_columns(mixture, ["population"])
        population = F.col("population").cast("double")
    else:
        population = F.lit(float(population_size))
    seg = _segment_arrays(mixture, demos, population)

    kappa = F.col("__kappa")
    if normalize:
        guard = F.when(kappa == 0, F.raise_error(F.lit("kappa = sum(alpha * rate) is 0: cannot normalize")))

    def pool(lower: Column, upper: Column, alpha: Column, rate: Column, start: Column, total: Column) -> Column:
        return F.struct(lower.cast("double").alias("prob_>="), upper.cast("double").alias("prob_<"),
                        alpha.cast("double").alias("alpha"), rate.cast("double").alias("rate"),
                        start.cast("bigint").alias("start_VID"), total.cast("bigint").alias("total_VID"))

    def fitted(p: Column, pos: Column) -> Column:
        lower, upper = _prefix(F.col("__ak"), pos), _prefix(F.col("__ak"), pos + 1)
        if normalize:
            lower, upper = F.coalesce(guard, lower / kappa), upper / kappa
        return pool(lower, upper, p.getField("alphas"), p.getField("rates"),
                    F.lit(1) + F.col("__offset") + _prefix_long(F.col("__tot"), pos), F.get("__tot", pos))

    pools = F.transform(F.arrays_zip("alphas", "rates"), fitted)
    if not normalize:
        null_pool = pool(kappa, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(1))
        pools = F.concat(pools, F.array(null_pool))
    return seg.select(*demos, F.explode(pools).alias("__pool")).select(
        *demos, *[F.col("__pool").getField(c).alias(c) for c in VID_COLUMNS])


def packed_vid_table(mixture: DataFrame, population_size: int | None = None, demo_cols=None) -> DataFrame:
    """One row per segment: kappa-normalised bucket bounds, alphas, rates, start VIDs
    and pool sizes as arrays (same numbers as the normalised VID table)."""
    demos = as_list(demo_cols)
    require_columns(mixture, ["alphas", "rates", *demos])
    if demos or population_size is None:
        population = F.col("population").cast("double")
    else:
        population = F.lit(float(population_size))
    seg = _segment_arrays(mixture, demos, population)
    idx = F.sequence(F.lit(0), F.size("alphas") - 1)
    kappa = F.col("__kappa")
    return seg.select(
        *demos,
        F.transform(idx, lambda i: _prefix(F.col("__ak"), i) / kappa).alias("prob_lower"),
        F.transform(idx, lambda i: _prefix(F.col("__ak"), i + 1) / kappa).alias("prob_upper"),
        F.col("alphas"),
        F.col("rates"),
        F.transform(idx, lambda i: F.lit(1) + F.col("__offset") + _prefix_long(F.col("__tot"), i)).alias("start_VIDs"),
        F.col("__tot").alias("total_VIDs"),
    )
