"""The registered queries: every operator run over the provided test tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built on the
EVENTS / LINES / CENSUS views (see ``reachkit.sources.tables``), so its work
grows with the tables.  Columns that involve transcendental functions or sums
of doubles in data-dependent order are rounded, so the DuckDB cross-check
(``catalog_sql``) can compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachkit.functions.hashing import hash_uniform
from reachkit.functions.mixture import mixture_reach, params_array
from reachkit.operators import (
    add_exposure_index,
    add_first_exposure,
    add_frequency_total,
    add_n_impressions,
    assign_vids,
    delta_points,
    explode_weights_to_impressions,
    fit_mixture_of_deltas,
    fit_overlay,
    fit_summary,
    frequency_head,
    gen_people_table,
    gen_synthetic_impressions,
    generate_frequency_table,
    generate_reach_table,
    generate_vid_assignment_table,
    mixture_eval,
    mixture_of_delta_pool_info,
    packed_vid_table,
    penetrate_uniform_reach,
    population_total,
    reach_points,
)
from reachkit.sources.literals import mixture_table
from reachkit.sources.tables import census_from_customers, event_impressions, line_impressions

# The mixture used by the model queries (3 deltas, kappa = 0.68),
# the segment column, synthetic-data settings and rounding digits.
ALPHAS = [0.25, 0.2, 0.1]
RATES = [2.0, 0.8, 0.2]
DEMO = "age_range"
HOT_SEGMENT = "BUILDING"
TWO = ["age_range", "gender"]  # gender is NULL for a third of the census
ASSUMED_POPULATION = 5_000_000
# a steep pool beside a slow one, on axes of so many impressions per person; a pool slower than is kept
STEEP_ALPHAS, STEEP_RATES, STEEP_TOPS, STEEP_FIRST = [0.3, 0.4], [0.1, 2.0], [900, 3000, 10000], 1e-3
SLOW_ALPHAS, SLOW_RATES = [0.3, 0.5], [0.004, 1.0]
KNOWN_DIGITS = 4  # digits to which a fit must recover a known mixture
GEN_SEED = 7
GEN_IMPRESSIONS_PER_PERSON = 10.0
GEN_START = "2020-03-01 00:00:00"
GEN_END = "2020-07-01 00:00:00"
DIGITS = 9
FIT_DIGITS = 6


def _r(c, digits: int = DIGITS):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- model tables built from the data ------------------------------------------------

def total_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """One-row mixture: the literal parameters with the census population total."""
    return population_total(census_from_customers(spark, sf)).select(
        "population", params_array(ALPHAS).alias("alphas"), params_array(RATES).alias("rates"))


def segment_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return penetrate_uniform_reach(census_from_customers(spark, sf), ALPHAS, RATES, [DEMO])


def total_vid_table(spark: SparkSession, sf: str) -> DataFrame:
    return generate_vid_assignment_table(total_mixture(spark, sf))


def segment_vid_table(spark: SparkSession, sf: str) -> DataFrame:
    return generate_vid_assignment_table(segment_mixture(spark, sf), demo_cols=[DEMO])


def _assigned(spark, sf, mode, segmented):
    events = event_impressions(spark, sf)
    if segmented:
        return assign_vids(events, segment_vid_table(spark, sf), demo_cols=[DEMO], mode=mode)
    return assign_vids(events, total_vid_table(spark, sf), mode=mode)


def _people(spark, sf):
    return gen_people_table(census_from_customers(spark, sf), [DEMO])


def _people_n(spark, sf):
    return add_n_impressions(_people(spark, sf), impressions_per_person=GEN_IMPRESSIONS_PER_PERSON,
                             seed=GEN_SEED)


def _generated(spark, sf):
    return gen_synthetic_impressions(_people_n(spark, sf), GEN_START, GEN_END, [DEMO], seed=GEN_SEED)


def _long_mixture(mix: DataFrame, demos: list[str]) -> DataFrame:
    return mix.select(*demos, "population", F.posexplode(F.arrays_zip("alphas", "rates")).alias("pos", "p")) \
        .select(*demos, "population", (F.col("pos") + 1).alias("delta"),
                F.col("p.alphas").alias("alpha"), F.col("p.rates").alias("rate"))


# --- queries ---------------------------------------------------------------------

def q_population_total(spark, sf):
    return population_total(census_from_customers(spark, sf))


def q_penetrate_uniform(spark, sf):
    return _long_mixture(segment_mixture(spark, sf), [DEMO])


def q_exposure_index(spark, sf):
    return add_exposure_index(event_impressions(spark, sf))


def q_frequency_total(spark, sf):
    return add_frequency_total(event_impressions(spark, sf))


def q_first_exposure(spark, sf):
    return add_first_exposure(event_impressions(spark, sf))


def q_reach_count(spark, sf):
    return generate_reach_table(line_impressions(spark, sf))


def q_reach_weighted(spark, sf):
    return generate_reach_table(line_impressions(spark, sf), mode="weighted")


def q_reach_segment_count(spark, sf):
    return generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO])


def q_reach_segment_weighted(spark, sf):
    return generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO], mode="weighted")


def q_reach_hourly_segments(spark, sf):
    return generate_reach_table(event_impressions(spark, sf, hourly=True), demo_cols=[DEMO, "gender"])


def q_frequency_table(spark, sf):
    return generate_frequency_table(line_impressions(spark, sf))


def q_frequency_segment_table(spark, sf):
    return generate_frequency_table(line_impressions(spark, sf), demo_cols=["device_type"])


def q_explode_weights(spark, sf):
    return explode_weights_to_impressions(event_impressions(spark, sf))


def q_exploded_reach(spark, sf):
    return generate_reach_table(explode_weights_to_impressions(event_impressions(spark, sf, hourly=True)))


def q_mixture_eval(spark, sf):
    reach = generate_reach_table(line_impressions(spark, sf)).withColumn(
        "population", population_total(census_from_customers(spark, sf)).scalar())
    out = mixture_eval(reach, ALPHAS, RATES, "population")
    return out.select("timestamp", "g", _r("share").alias("share"), _r("fit").alias("fit"))


def q_fit_overlay(spark, sf):
    reach = generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO])
    out = fit_overlay(reach, segment_mixture(spark, sf), [DEMO])
    return out.withColumn("fit", _r("fit", FIT_DIGITS))


def q_fit_summary(spark, sf):
    reach = generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO])
    out = fit_summary(reach, segment_mixture(spark, sf), [DEMO])
    return out.withColumn("rmse", _r("rmse", FIT_DIGITS)).withColumn("reached_pct", _r("reached_pct"))


def q_fit_total(spark, sf):
    """Two deltas on the observed curve: a profile search over both rates has the same answer."""
    reach = generate_reach_table(line_impressions(spark, sf))
    fit = fit_mixture_of_deltas(reach, census_from_customers(spark, sf), n_deltas=2)
    return _rounded(fit).withColumn("rmse", F.round("rmse", KNOWN_DIGITS))


def q_fit_segment(spark, sf):
    reach = generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO])
    return fit_mixture_of_deltas(reach, census_from_customers(spark, sf), n_deltas=3, demo_cols=[DEMO])


def q_reach_points(spark, sf):
    reach = generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO])
    return reach_points(reach, [DEMO], jump=100)


def q_frequency_head(spark, sf):
    freq = generate_frequency_table(line_impressions(spark, sf), demo_cols=["device_type"])
    return frequency_head(freq, ["device_type"], n_bars=20)


def q_delta_points(spark, sf):
    return delta_points(segment_mixture(spark, sf), [DEMO])


def q_vid_table(spark, sf):
    return total_vid_table(spark, sf)


def q_vid_table_segment(spark, sf):
    return segment_vid_table(spark, sf)


def q_vid_table_normalized(spark, sf):
    return generate_vid_assignment_table(segment_mixture(spark, sf), demo_cols=[DEMO], normalize=True)


def q_vid_table_packed(spark, sf):
    packed = packed_vid_table(segment_mixture(spark, sf), demo_cols=[DEMO])
    z = F.arrays_zip("prob_lower", "prob_upper", "alphas", "rates", "start_VIDs", "total_VIDs")
    return packed.select(DEMO, F.posexplode(z).alias("pos", "p")).select(
        DEMO, (F.col("pos") + 1).alias("pool"),
        F.col("p.prob_lower").alias("prob_lower"), F.col("p.prob_upper").alias("prob_upper"),
        F.col("p.alphas").alias("alpha"), F.col("p.rates").alias("rate"),
        F.col("p.start_VIDs").alias("start_VID"), F.col("p.total_VIDs").alias("total_VID"))


def q_hash_uniform(spark, sf):
    ev = event_impressions(spark, sf)
    return ev.select("user_id", "timestamp",
                     hash_uniform("user_id").alias("p_uid"),
                     hash_uniform(F.concat(F.col("user_id"), F.col("timestamp").cast("string"))).alias("p_uid_time"))


def q_assign_uid(spark, sf):
    return _assigned(spark, sf, "uid", False)


def q_assign_uid_segment(spark, sf):
    return _assigned(spark, sf, "uid", True)


def q_assign_uid_time(spark, sf):
    return _assigned(spark, sf, "uid_time", False)


def q_assign_uid_time_segment(spark, sf):
    return _assigned(spark, sf, "uid_time", True)


def q_assign_weighted(spark, sf):
    return _assigned(spark, sf, "weighted", False)


def q_assign_weighted_segment(spark, sf):
    return _assigned(spark, sf, "weighted", True)


def q_vid_reach_count(spark, sf):
    return generate_reach_table(_assigned(spark, sf, "uid_time", False), id_col="vid")


def q_vid_reach_segment(spark, sf):
    return generate_reach_table(_assigned(spark, sf, "uid_time", True), id_col="vid", demo_cols=[DEMO])


def q_vid_frequency(spark, sf):
    return generate_frequency_table(_assigned(spark, sf, "uid_time", False), id_col="vid")


def q_vid_frequency_segment(spark, sf):
    return generate_frequency_table(_assigned(spark, sf, "uid_time", True), id_col="vid", demo_cols=[DEMO])


def q_pool_info(spark, sf):
    return mixture_of_delta_pool_info(_assigned(spark, sf, "uid_time", False), total_vid_table(spark, sf))


def q_pool_info_segment(spark, sf):
    return mixture_of_delta_pool_info(_assigned(spark, sf, "uid_time", True), segment_vid_table(spark, sf))


def q_gen_people(spark, sf):
    return _people(spark, sf).withColumn("rate", _r("rate"))


def q_gen_n_impressions(spark, sf):
    return (_people_n(spark, sf).withColumn("rate", _r("rate"))
            .withColumn("rate_impressions", _r("rate_impressions")))


def q_gen_impressions(spark, sf):
    return _generated(spark, sf)


def q_gen_reach(spark, sf):
    return generate_reach_table(_generated(spark, sf), demo_cols=[DEMO])


# --- fits against known answers --------------------------------------------------------

def _known_curve(reach: DataFrame, population) -> DataFrame:
    """A reach table whose ``reach`` is the known mixture's curve on its impression axis."""
    share = mixture_reach(params_array(ALPHAS), params_array(RATES), F.col("impression") / F.col("__pop"))
    return (reach.withColumn("__pop", population.cast("double"))
            .withColumn("reach", share * F.col("__pop")).drop("__pop"))


def _recovered_total(spark, sf) -> DataFrame:
    census = census_from_customers(spark, sf)
    known = _known_curve(generate_reach_table(line_impressions(spark, sf)), population_total(census).scalar())
    return _rounded(fit_mixture_of_deltas(known, census, n_deltas=len(ALPHAS)))


def _recovered_segment(spark, sf) -> DataFrame:
    census = census_from_customers(spark, sf)
    reach = generate_reach_table(line_impressions(spark, sf), demo_cols=[DEMO]).join(census, DEMO)
    known = _known_curve(reach, F.col("population")).drop("population")
    return _rounded(fit_mixture_of_deltas(known, census, n_deltas=len(ALPHAS), demo_cols=[DEMO]))


def _rounded(fit: DataFrame) -> DataFrame:
    return (fit.withColumn("alphas", F.transform("alphas", lambda a: F.round(a, KNOWN_DIGITS)))
            .withColumn("rates", F.transform("rates", lambda x: F.round(x, KNOWN_DIGITS))))


def q_fit_recovery_total(spark, sf):
    return _long_mixture(_recovered_total(spark, sf), [])


def q_fit_recovery_segment(spark, sf):
    return _long_mixture(_recovered_segment(spark, sf), [DEMO])


def _axis_curves(spark, sf) -> DataFrame:
    """The steep known mixture on axes of up to 10,000 impressions per person, evenly and geometrically
    spaced by the impressions of the log: ``axis, top, population, impression, reach``."""
    reach = generate_reach_table(line_impressions(spark, sf))
    total = reach.agg(F.max("impression")).scalar()
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(t)).alias("top")) for a in ("even", "geometric") for t in STEEP_TOPS])
    part = F.col("impression") / total
    pts = reach.select(part.alias("part"), F.explode(axes).alias("a")).select("part", "a.axis", "a.top")
    g = F.when(F.col("axis") == "even", F.col("top") * F.col("part")).otherwise(
        F.lit(STEEP_FIRST) * F.pow(F.col("top") / F.lit(STEEP_FIRST), F.col("part")))
    pop = population_total(census_from_customers(spark, sf)).scalar()
    share = mixture_reach(params_array(STEEP_ALPHAS), params_array(STEEP_RATES), F.col("g"))
    return (pts.withColumn("g", g).withColumn("population", pop)
            .select("axis", "top", "population", (F.col("g") * F.col("population")).alias("impression"),
                    (share * F.col("population")).alias("reach")))


def q_fit_recovery_steep(spark, sf):
    """No range of the log hides a rate: a steep pool beside a slow one on long axes."""
    curves = _axis_curves(spark, sf)
    census = curves.groupBy("axis", "top").agg(F.max("population").alias("population"))
    fit = fit_mixture_of_deltas(curves, census, n_deltas=len(STEEP_ALPHAS), demo_cols=["axis", "top"])
    return _long_mixture(_rounded(fit), ["axis", "top"])


def _slow_curve(spark, sf) -> DataFrame:
    """A curve with a pool below the smallest rate that is kept."""
    pop = population_total(census_from_customers(spark, sf)).scalar()
    share = mixture_reach(params_array(SLOW_ALPHAS), params_array(SLOW_RATES), F.col("impression") / F.col("__pop"))
    return (generate_reach_table(line_impressions(spark, sf)).withColumn("__pop", pop.cast("double"))
            .withColumn("reach", share * F.col("__pop")).drop("__pop"))


def q_fit_drops_delta(spark, sf):
    """Two deltas on a curve whose second pool is too slow to keep: it is dropped and the curve fitted by one."""
    fit = fit_mixture_of_deltas(_slow_curve(spark, sf), census_from_customers(spark, sf), n_deltas=2)
    return fit.select("population", "n_fitted", F.size("alphas").alias("n_deltas"), F.col("alphas")[0].alias("dropped"),
                      F.round(F.col("alphas")[1], KNOWN_DIGITS).alias("alpha"),
                      F.round(F.col("rates")[1], KNOWN_DIGITS).alias("rate"), F.round("rmse", KNOWN_DIGITS).alias("rmse"))


def q_fit_one_delta(spark, sf):
    """One delta on the observed curve: a one-dimensional search has the same answer."""
    fit = fit_mixture_of_deltas(generate_reach_table(line_impressions(spark, sf)), census_from_customers(spark, sf), n_deltas=1)
    return fit.select("population", F.round(F.col("alphas")[0], KNOWN_DIGITS).alias("alpha"),
                      F.round(F.col("rates")[0], KNOWN_DIGITS).alias("rate"), F.round("rmse", KNOWN_DIGITS).alias("rmse"))


def q_flow_recovered_total(spark, sf):
    """Recovered mixture -> VID table -> assignment -> reach over VIDs."""
    table = generate_vid_assignment_table(_recovered_total(spark, sf))
    return generate_reach_table(assign_vids(event_impressions(spark, sf), table, mode="uid_time"), id_col="vid")


def q_flow_recovered_segment(spark, sf):
    table = generate_vid_assignment_table(_recovered_segment(spark, sf), demo_cols=[DEMO])
    assigned = assign_vids(event_impressions(spark, sf), table, demo_cols=[DEMO], mode="uid_time")
    return generate_reach_table(assigned, id_col="vid", demo_cols=[DEMO])


# --- two demo columns, NULL demos, ties, hot ids, other weights and orders ---------------

def two_demo_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return penetrate_uniform_reach(census_from_customers(spark, sf, TWO), ALPHAS, RATES, TWO)


def two_demo_vid_table(spark: SparkSession, sf: str) -> DataFrame:
    return generate_vid_assignment_table(two_demo_mixture(spark, sf), demo_cols=TWO)


def q_vid_table_two_demos(spark, sf):
    return two_demo_vid_table(spark, sf)


def q_assign_uid_time_two_demos(spark, sf):
    return assign_vids(event_impressions(spark, sf), two_demo_vid_table(spark, sf), demo_cols=TWO, mode="uid_time")


def q_assign_uid_segment_cells(spark, sf):
    """The join key of the shuffle form: segments and cells of [0, 1)."""
    return assign_vids(event_impressions(spark, sf), segment_vid_table(spark, sf), demo_cols=[DEMO], mode="uid", cells=64)


def _one_segment_events(spark, sf):
    """EVENTS with nine tenths of the users in one segment."""
    ev = event_impressions(spark, sf)
    return ev.withColumn(DEMO, F.when(F.col("user_id").cast("bigint") % 10 != 0, F.lit(HOT_SEGMENT)).otherwise(F.col(DEMO)))


def q_assign_uid_time_hot_segment(spark, sf):
    """Hot segments found by counting get cells of their own in the join key."""
    return assign_vids(_one_segment_events(spark, sf), segment_vid_table(spark, sf), demo_cols=[DEMO], mode="uid_time", cells="measured")


def q_assign_uid_literal_model(spark, sf):
    """Literal model rows with an assumed population."""
    table = generate_vid_assignment_table(mixture_table(spark, ALPHAS, RATES), population_size=ASSUMED_POPULATION)
    return assign_vids(event_impressions(spark, sf), table, mode="uid")


def q_pool_info_two_demos(spark, sf):
    return mixture_of_delta_pool_info(q_assign_uid_time_two_demos(spark, sf), two_demo_vid_table(spark, sf), demo_cols=TWO)


def q_fit_overlay_two_demos(spark, sf):
    reach = generate_reach_table(event_impressions(spark, sf, hourly=True), demo_cols=TWO)
    out = fit_overlay(reach, two_demo_mixture(spark, sf), TWO, with_origin=True)
    return out.withColumn("fit", _r("fit", FIT_DIGITS))


def q_gen_people_two_demos(spark, sf):
    return gen_people_table(census_from_customers(spark, sf, TWO), TWO).withColumn("rate", _r("rate"))


def q_reach_weighted_fractions(spark, sf):
    halves = line_impressions(spark, sf).withColumn("weight", F.col("weight") / 2.0)
    return generate_reach_table(halves, mode="weighted")


def q_exposure_index_ties(spark, sf):
    return add_exposure_index(line_impressions(spark, sf), tiebreak=["device_type", "weight"])


def q_frequency_total_hot_id(spark, sf):
    """A third of the rows without an id: the NULL id is one hot group."""
    ev = event_impressions(spark, sf)
    hot = ev.withColumn("user_id", F.when(F.col("user_id").cast("bigint") % 3 != 0, F.col("user_id")))
    return add_frequency_total(hot)


def q_flow_generated(spark, sf):
    """Synthetic impressions through assignment and reach over VIDs."""
    return generate_reach_table(assign_vids(_generated(spark, sf), total_vid_table(spark, sf), mode="uid_time"), id_col="vid")


def q_flow_total(spark, sf):
    """Fit the total curve, build its VID table, assign by user and time, and
    recompute the reach over VIDs (one lazy plan but for the model table)."""
    lines = line_impressions(spark, sf)
    census = census_from_customers(spark, sf)
    fit = fit_mixture_of_deltas(generate_reach_table(lines), census, n_deltas=2)
    table = generate_vid_assignment_table(fit)
    return generate_reach_table(assign_vids(lines, table, mode="uid_time"), id_col="vid")


def q_flow_segment(spark, sf):
    """In-segment fits -> segmented VID table -> assignment -> VID reach per segment."""
    lines = line_impressions(spark, sf)
    census = census_from_customers(spark, sf)
    fit = fit_mixture_of_deltas(generate_reach_table(lines, demo_cols=[DEMO]), census, n_deltas=3,
                                demo_cols=[DEMO])
    table = generate_vid_assignment_table(fit, demo_cols=[DEMO])
    assigned = assign_vids(lines, table, demo_cols=[DEMO], mode="uid_time")
    return generate_reach_table(assigned, id_col="vid", demo_cols=[DEMO])


def q_flow_uniform(spark, sf):
    """Total fit -> uniform penetration into segments -> segmented VID table ->
    assignment -> VID reach per segment (the uniform-reach assumption)."""
    lines = line_impressions(spark, sf)
    census = census_from_customers(spark, sf)
    fit = fit_mixture_of_deltas(generate_reach_table(lines), census, n_deltas=3)
    table = generate_vid_assignment_table(penetrate_uniform_reach(census, fit, demo_cols=[DEMO]),
                                          demo_cols=[DEMO])
    assigned = assign_vids(lines, table, demo_cols=[DEMO], mode="uid_time")
    return generate_reach_table(assigned, id_col="vid", demo_cols=[DEMO])


def q_flow_exploded(spark, sf):
    """Weights exploded to persons -> reach -> fit -> VID table -> per-user
    assignment -> VID frequency."""
    persons = explode_weights_to_impressions(event_impressions(spark, sf, hourly=True))
    census = census_from_customers(spark, sf, scale=5)
    fit = fit_mixture_of_deltas(generate_reach_table(persons), census, n_deltas=2)
    assigned = assign_vids(persons, generate_vid_assignment_table(fit), mode="uid")
    return generate_frequency_table(assigned, id_col="vid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
