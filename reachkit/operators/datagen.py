"""Synthetic people and impressions from a census, as Spark jobs.

* people: ``population`` persons per census segment; person ``i`` of a segment
  gets the Lomax (Pareto II) quantile ``rate = m * ((1 - i / P) ** (-1 / alpha) - 1)``;
  ``user_id`` numbers persons 1.. in (demos, rate) order;
* impression counts: rates rescaled to mean 1, ``rate_impressions = rate * I / P_total``,
  rounded stochastically (keep persons with at least one impression);
* impressions: each person's count becomes rows with uniform times in
  ``[start_ts, end_ts)`` (whole seconds).

Randomness is a seeded hash of the person (and impression number), so a rerun,
a retried task or a lost executor gives the same rows.  Row generation is
chunked (``plans.generate.explode_count``) so a big segment or a very active
person is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.functions.hashing import seeded_uniform
from reachkit.functions.rounding import stochastic_round
from reachkit.plans.generate import DEFAULT_CHUNK, explode_count
from reachkit.plans.prefix import exclusive_running_total
from reachkit.sources.schema import as_list, require_columns

# Lomax scale m and shape alpha of the activity rates.
LOMAX_M = 1.0
LOMAX_ALPHA = 20.0


def gen_people_table(census: DataFrame, demo_cols, m: float = LOMAX_M, alpha: float = LOMAX_ALPHA,
                     chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``user_id, demos, population, ratio, rate``: exactly ``population`` rows per
    segment (duplicate census rows of a segment are summed first)."""
    demos = as_list(demo_cols)
    require_columns(census, [*demos, "population"])
    seg = census.groupBy(*demos).agg(F.sum("population").cast("bigint").alias("population"))
    # A running total in demo order gives each segment its first user id
    # (bucketed prefix sum, so a census of millions of segments is fine too).
    seg = exclusive_running_total(seg, demos, "population", "__offset")
    total = seg.agg(F.sum("population")).scalar()  # scalar subquery: one value, no join
    seg = seg.withColumn("ratio", F.col("population") / total)
    people = explode_count(seg, "population", "__i", chunk=chunk, spread_by=demos)
    share = F.col("__i") / F.col("population")
    rate = F.lit(float(m)) * (F.pow(F.lit(1.0) - share, F.lit(-1.0 / float(alpha))) - F.lit(1.0))
    return people.select(
        (F.col("__offset") + F.col("__i") + 1).cast("bigint").alias("user_id"),
        *demos, "population", "ratio", rate.alias("rate"))


def add_n_impressions(people: DataFrame, impressions_total: float | None = None,
                      population_total: int | None = None, seed: int = 0,
                      impressions_per_person: float | None = None) -> DataFrame:
    """Add ``rate_impressions`` and ``n_impressions`` (stochastic rounding with a
    per-person seeded draw); persons with no impression are dropped.  The rate is
    rescaled so its mean over the people table is 1.  Give the expected number of
    impressions either in total (``impressions_total``) or per person."""
    require_columns(people, ["user_id", "rate"])
    if (impressions_total is None) == (impressions_per_person is None):
        raise ValueError("give exactly one of impressions_total and impressions_per_person")
    # one scalar subquery (a struct of both values; Spark evaluates it once)
    # rates are summed as decimals: exactly, so the sum does not depend on the order of partitions
    exact = F.sum(F.col("rate").cast("decimal(28,18)")).cast("double")
    stats = people.agg(F.struct(exact.alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    total = F.lit(float(population_total)) if population_total is not None else stats.getField("n").cast("double")
    scaled = F.col("rate") * total / stats.getField("s")
    per_person = (F.lit(float(impressions_per_person)) if impressions_per_person is not None
                  else F.lit(float(impressions_total)) / total)
    out = (
        people
        .withColumn("rate", scaled)
        .withColumn("rate_impressions", F.col("rate") * per_person)
        .withColumn("n_impressions", stochastic_round("rate_impressions", seeded_uniform(seed, "user_id")))
        .where(F.col("n_impressions") > 0)
    )
    return out


def gen_synthetic_impressions(people_n: DataFrame, start_ts: str, end_ts: str, demo_cols,
                              seed: int = 0, sort: bool = False, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``user_id, demos, timestamp_int, timestamp``: ``n_impressions`` rows per person
    with uniform whole-second times in ``[start_ts, end_ts)``; ``start_ts``/``end_ts``
    are wall-clock strings, ``timestamp`` is TIMESTAMP_NTZ and ``timestamp_int``
    its seconds since 1970-01-01 00:00:00 (independent of the session time zone)."""
    demos = as_list(demo_cols)
    require_columns(people_n, ["user_id", "n_impressions", *demos])
    # Wall-clock (TIMESTAMP_NTZ) arithmetic: the result does not depend on the
    # session time zone or on daylight-saving changes inside the window.
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    start = F.expr(f"timestampdiff(SECOND, {epoch}, to_timestamp_ntz('{start_ts}'))")
    end = F.expr(f"timestampdiff(SECOND, {epoch}, to_timestamp_ntz('{end_ts}'))")
    rows = explode_count(people_n.select("user_id", *demos, "n_impressions"), "n_impressions", "__k",
                         chunk=chunk, spread_by=["user_id"])
    u = seeded_uniform(seed, "user_id", "__k")
    ts_int = (start + F.floor(u * (end - start))).cast("bigint")
    out = rows.select("user_id", *demos, ts_int.alias("timestamp_int")).withColumn(
        "timestamp", F.expr(f"timestampadd(SECOND, timestamp_int, {epoch})"))
    return out.orderBy("timestamp") if sort else out
