"""Mixture tables and what is read off them: population totals, uniform penetration
into segments, the fitted curve beside the observed one, fit summaries and the
long form of a mixture (one row per delta)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachkit.functions.mixture import array_sum, mixture_reach, params_array
from reachkit.sources.schema import as_list, join_null_safe, require_columns


def population_total(census: DataFrame) -> DataFrame:
    """One row: ``population`` = sum over the census."""
    require_columns(census, ["population"])
    return census.agg(F.sum("population").cast("bigint").alias("population"))


def penetrate_uniform_reach(census: DataFrame, alphas, rates=None, demo_cols=None,
                            digits: int = 8) -> DataFrame:
    """Give every census segment the same mixture (uniform reach penetration).

    ``alphas``/``rates`` are sequences of numbers, or ``alphas`` is a one-row
    mixture DataFrame (e.g. a total fit) with ``alphas`` and ``rates`` columns.
    Parameters are rounded to ``digits`` decimals.  Output
    ``[demos], population, alphas, rates`` sorted by the demos.
    """
    demos = as_list(demo_cols)
    require_columns(census, ["population", *demos])
    seg = census.groupBy(*demos).agg(F.sum("population").cast("bigint").alias("population"))
    if isinstance(alphas, DataFrame):
        params = one_row(alphas, "the mixture",
                         F.transform("alphas", lambda a: F.round(a, digits)).alias("alphas"),
                         F.transform("rates", lambda x: F.round(x, digits)).alias("rates"))
        out = seg.withColumn("alphas", params.getField("alphas")).withColumn("rates", params.getField("rates"))
    else:
        out = seg.select(
            *demos, "population",
            F.transform(params_array(alphas), lambda a: F.round(a, digits)).alias("alphas"),
            F.transform(params_array(rates), lambda x: F.round(x, digits)).alias("rates"))
    return out.select(*demos, "population", "alphas", "rates").orderBy(*demos)


def one_row(df: DataFrame, what: str, *cols: Column) -> Column:
    """The columns of a table that must have exactly one row, as a struct for use in other frames: a
    scalar subquery, which itself fails on more rows; no row raises when the value is read."""
    row = df.select(F.struct(*cols)).scalar()
    return F.coalesce(row, F.raise_error(F.lit(f"{what} must have exactly one row, got none")))


def _with_model(reach: DataFrame, mixture: DataFrame, demos: list[str],
                population_size: int | None) -> DataFrame:
    cols = ["alphas", "rates"] + (["population"] if (demos or population_size is None) else [])
    # A mixture has one row per segment: a model table, joined by the demos
    # (broadcast by Spark when small); NULL segments match NULL segments.
    if demos:
        return join_null_safe(reach, mixture.select(*demos, *cols), demos)
    model = one_row(mixture, "an un-segmented mixture", *[F.col(x) for x in cols])
    out = reach.withColumns({x: model.getField(x) for x in cols})
    if population_size is not None:
        out = out.withColumn("population", F.lit(int(population_size)).cast("bigint"))
    return out


def fit_overlay(reach: DataFrame, mixture: DataFrame, demo_cols=None,
                population_size: int | None = None, with_origin: bool = False) -> DataFrame:
    """Observed and fitted reach per curve point:
    ``[demos], timestamp, impression, reach, fit`` with
    ``fit = R(impression / population) * population``.  ``with_origin`` adds the
    point (0, 0) (NULL timestamp) to every curve, as plotted curves start there."""
    demos = as_list(demo_cols)
    require_columns(reach, [*demos, "timestamp", "impression", "reach"])
    points = reach.select(*demos, "timestamp", "impression", "reach")
    if with_origin:
        origins = points.select(*demos).distinct().select(
            *demos, F.lit(None).cast(reach.schema["timestamp"].dataType).alias("timestamp"),
            F.lit(0).cast(reach.schema["impression"].dataType).alias("impression"),
            F.lit(0).cast(reach.schema["reach"].dataType).alias("reach"))
        points = origins.unionByName(points)
    joined = _with_model(points, mixture, demos, population_size)
    pop = F.col("population").cast("double")
    fit = mixture_reach("alphas", "rates", F.col("impression") / pop) * pop
    return joined.select(*demos, "timestamp", "impression", "reach", fit.alias("fit"))


def fit_summary(reach: DataFrame, mixture: DataFrame, demo_cols=None,
                population_size: int | None = None) -> DataFrame:
    """Per curve: reached share ``100 * sum(alphas)`` (percent of the population),
    number of points and RMSE of the fit over the full curve (people)."""
    demos = as_list(demo_cols)
    overlay = fit_overlay(reach, mixture, demos, population_size)
    err = (F.col("fit") - F.col("reach")).cast("double")
    stats = overlay.groupBy(*demos).agg(
        F.count(F.lit(1)).alias("points"),
        F.sqrt(F.avg(err * err)).alias("rmse"))
    reached = F.lit(100.0) * array_sum("alphas")
    if demos:
        return join_null_safe(stats, mixture.select(*demos, reached.alias("reached_pct")), demos)
    return stats.withColumn("reached_pct", one_row(mixture, "an un-segmented mixture", reached.alias("x")).getField("x"))


def delta_points(mixture: DataFrame, demo_cols=None) -> DataFrame:
    """Long form of a mixture: ``[demos], delta, rate, amplitude`` where
    ``amplitude = alpha * population / total population`` (just ``alpha``
    without segments)."""
    demos = as_list(demo_cols)
    require_columns(mixture, ["alphas", "rates", *demos])
    if demos:
        total = mixture.agg(F.sum("population").cast("double")).scalar()  # scalar subquery
        scale = F.col("population").cast("double") / total
    else:
        scale = F.lit(1.0)
    return (
        mixture.select(*demos, scale.alias("__scale"),
                       F.posexplode(F.arrays_zip("alphas", "rates")).alias("__pos", "__p"))
        .select(*demos, (F.col("__pos") + 1).alias("delta"), F.col("__p.rates").alias("rate"),
                (F.col("__p.alphas") * F.col("__scale")).alias("amplitude"))
    )


def mixture_eval(reach: DataFrame, alphas: Sequence[float], rates: Sequence[float],
                 population) -> DataFrame:
    """Evaluate ``R(g)`` at ``g = impression / population`` on a curve's points:
    ``timestamp, g, share, fit``."""
    pop = F.lit(float(population)) if not isinstance(population, str) else F.col(population).cast("double")
    g = F.col("impression") / pop
    share = mixture_reach(params_array(alphas), params_array(rates), g)
    return reach.select("timestamp", g.alias("g"), share.alias("share"), (share * pop).alias("fit"))
