import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachkit import (
    add_n_impressions,
    delta_points,
    fit_curve,
    fit_mixture_of_deltas,
    fit_overlay,
    fit_summary,
    frequency_head,
    gen_people_table,
    gen_synthetic_impressions,
    generate_frequency_table,
    generate_reach_table,
    penetrate_uniform_reach,
    population_total,
    reach_points,
)
from reachkit.functions import mixture_reach, params_array


def curve(alphas, rates, g):
    return (1 - np.exp(-np.outer(g, rates))) @ np.asarray(alphas)


@pytest.mark.parametrize("alphas,rates", [([0.6, 0.3], [0.4, 2.5]), ([0.5, 0.3, 0.1], [3.0, 0.7, 0.1])])
def test_fit_recovers_noiseless_mixture(alphas, rates):
    g = np.linspace(0.01, 25, 300)
    a, x, m, sse = fit_curve(g, curve(alphas, rates, g), len(alphas))
    assert m == len(alphas)
    order = np.argsort(rates)
    assert np.allclose(x, np.asarray(rates)[order], rtol=1e-4)
    assert np.allclose(a, np.asarray(alphas)[order], rtol=1e-4)


def test_fit_drops_pools_and_pads():
    g = np.linspace(0.01, 10, 200)
    a, x, m, _ = fit_curve(g, curve([0.7], [1.3], g), 3)
    assert m == 1 and a[:2].tolist() == [0.0, 0.0] and x[-1] == pytest.approx(1.3, rel=1e-5)
    # flat curve and a two-point curve still give a finite answer
    a, x, m, _ = fit_curve(np.array([1.0, 2.0, 3.0]), np.array([0.5, 0.5, 0.5]), 2)
    assert m >= 1 and np.isfinite(a).all()
    a, x, m, _ = fit_curve(np.array([0.5, 1.0]), np.array([0.2, 0.3]), 2)
    assert m >= 1 and np.isfinite(x).all()


def test_mixture_reach_expression(spark):
    df = spark.range(1).select(mixture_reach(params_array([0.5, 0.25]), params_array([2.0, 0.5]),
                                             F.lit(1.5)).alias("r"))
    assert df.first()["r"] == pytest.approx(curve([0.5, 0.25], [2.0, 0.5], [1.5])[0])


@pytest.fixture(scope="module")
def census(spark):
    return spark.createDataFrame([("X", 0), ("A", 1), ("B", 49), ("C", 103), ("C", 4), ("D", 103)],
                                 "seg string, population bigint")


def test_gen_people_exact_counts(spark, census):
    people = gen_people_table(census, ["seg"], chunk=16)
    rows = people.collect()
    counts = {}
    for r in rows:
        counts[r["seg"]] = counts.get(r["seg"], 0) + 1
    assert counts == {"A": 1, "B": 49, "C": 107, "D": 103}
    ids = sorted(r["user_id"] for r in rows)
    assert ids == list(range(1, 261))
    # ids follow (demos, rate) order, rates rise within a segment, start at 0
    by_id = sorted(rows, key=lambda r: r["user_id"])
    assert [r["seg"] for r in by_id] == sorted(r["seg"] for r in rows)
    for seg in "ABCD":
        rates = [r["rate"] for r in by_id if r["seg"] == seg]
        assert rates[0] == 0.0 and all(b > a for a, b in zip(rates, rates[1:]))
    assert rows[0]["ratio"] == pytest.approx(counts[rows[0]["seg"]] / 260)


def test_impressions_generation(spark, census):
    people = gen_people_table(census, ["seg"])
    people_n = add_n_impressions(people, impressions_total=5000, seed=3)
    total = people_n.agg(F.sum("n_impressions")).first()[0]
    assert abs(total - 5000) < 400
    assert people_n.where("n_impressions <= 0").count() == 0
    imps = gen_synthetic_impressions(people_n, "2020-03-01 00:00:00", "2020-07-01 00:00:00", ["seg"],
                                     seed=3, chunk=7)
    assert imps.count() == total
    lo, hi = imps.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert lo >= dt.datetime(2020, 3, 1) and hi < dt.datetime(2020, 7, 1)
    again = gen_synthetic_impressions(people_n, "2020-03-01 00:00:00", "2020-07-01 00:00:00", ["seg"],
                                      seed=3, chunk=1000)
    assert sorted(map(tuple, imps.collect())) == sorted(map(tuple, again.collect()))  # chunking-independent
    with pytest.raises(ValueError):
        add_n_impressions(people)


def test_grouped_fit_and_views(spark, census):
    # synthetic segments with known mixtures -> reach curves -> grouped fit
    people = gen_people_table(census.where("seg in ('C', 'D')"), ["seg"])
    imps = gen_synthetic_impressions(add_n_impressions(people, impressions_per_person=6, seed=2),
                                     "2020-03-01 00:00:00", "2020-03-03 00:00:00", ["seg"], seed=2)
    reach = generate_reach_table(imps, demo_cols=["seg"])
    cen = census.where("seg in ('C', 'D')")
    fits = fit_mixture_of_deltas(reach, cen, n_deltas=2, demo_cols=["seg"])
    rows = {r["seg"]: r for r in fits.collect()}
    assert set(rows) == {"C", "D"}
    for r in rows.values():
        assert len(r["alphas"]) == 2 and 1 <= r["n_fitted"] <= 2
        assert 0 < sum(r["alphas"]) <= 1.05
    summary = fit_summary(reach, fits, ["seg"]).collect()
    assert all(s["rmse"] < 0.05 * 107 for s in summary)
    overlay = fit_overlay(reach, fits, ["seg"])
    assert overlay.count() == reach.count()
    origin = fit_overlay(reach, fits, ["seg"], with_origin=True).where("impression = 0").collect()
    assert len(origin) == 2 and all(r["fit"] == 0.0 and r["reach"] == 0 for r in origin)
    total_fit = fit_mixture_of_deltas(generate_reach_table(imps), 210, n_deltas=2)
    assert total_fit.count() == 1
    pen = penetrate_uniform_reach(cen, total_fit, demo_cols=["seg"])
    assert pen.count() == 2 and population_total(cen).first()["population"] == 210
    dp = delta_points(pen, ["seg"]).collect()
    assert len(dp) == 4
    # uniform penetration: per delta, the segment amplitudes add up to its alpha
    alpha = dict(enumerate(pen.first()["alphas"], 1))
    for d in (1, 2):
        assert sum(r["amplitude"] for r in dp if r["delta"] == d) == pytest.approx(alpha[d])
    pts = reach_points(reach, ["seg"], jump=10).collect()
    assert all((p["point"] - 1) % 10 == 0 for p in pts)
    head = frequency_head(generate_frequency_table(imps, demo_cols=["seg"]), ["seg"], n_bars=3).collect()
    assert len(head) <= 6


def test_fit_uses_every_point(spark):
    """The sums that Spark aggregates give the fit of all points, however they are partitioned."""
    g = np.linspace(0.01, 12, 5000)
    r = curve([0.4, 0.2], [2.0, 0.3], g) + np.random.default_rng(4).normal(0, 0.01, len(g))
    want = fit_curve(g, r, 2)
    df = spark.createDataFrame([(float(a * 1000), float(b * 1000)) for a, b in zip(g, r)], "impression double, reach double")
    for parts in (1, 7):
        row = fit_mixture_of_deltas(df.repartition(parts), 1000, n_deltas=2).first()
        assert row["alphas"] == pytest.approx(want[0].tolist(), rel=1e-5)
        assert row["rates"] == pytest.approx(want[1].tolist(), rel=1e-5)
        assert row["rmse"] == pytest.approx(1000 * np.sqrt(want[3] / len(g)), rel=1e-5)
    residual = np.sqrt(np.mean((curve(want[0], want[1], g) - r) ** 2))
    assert row["rmse"] == pytest.approx(1000 * residual, rel=1e-5)


def test_fit_null_segments_and_errors(spark):
    rows = [(s, i, float(100.0 * (1 - np.exp(-1.5 * i / 100)))) for s in ("A", None) for i in range(1, 300)]
    reach = spark.createDataFrame(rows, "seg string, impression long, reach double")
    cen = spark.createDataFrame([("A", 100), (None, 100), ("B", 5)], "seg string, population long")
    fits = {r["seg"]: r for r in fit_mixture_of_deltas(reach, cen, n_deltas=1, demo_cols=["seg"]).collect()}
    assert set(fits) == {"A", None}
    assert all(r["n_fitted"] == 1 and r["rates"][-1] == pytest.approx(1.5, rel=1e-4) for r in fits.values())
    assert fit_overlay(reach.withColumn("timestamp", F.lit(1)), fit_mixture_of_deltas(reach, cen, 1, ["seg"]), ["seg"]).count() == len(rows)
    with pytest.raises(Exception, match="no census row"):
        fit_mixture_of_deltas(reach, cen.where("seg is not null"), demo_cols=["seg"]).collect()
    with pytest.raises(ValueError):
        fit_curve([], [], 1)


def test_solver_out_of_evaluations_is_a_failure():
    from reachkit.operators.fit import fit_sums, sums_of_points

    angle = np.linspace(0, np.pi, 400)
    g = 10 * ((np.cos(angle) + 1) / 2) ** 2
    r = curve([0.5, 0.2], [2.0, 0.4], g)
    sums = sums_of_points(g, r)
    assert fit_sums(sums, 2)[2] == 2
    with pytest.raises(ValueError, match="cannot be fitted"):
        fit_sums(sums, 2, max_eval=2)


def test_array_sum(spark):
    from reachkit.functions import array_sum

    df = spark.createDataFrame([([0.25, 0.5, 1.0],)], "a array<double>")
    assert df.select(array_sum("a").alias("s")).first()["s"] == 1.75


def test_person_offsets_of_any_census(spark):
    rows = [(f"s{i:04d}" if i else None, i % 7) for i in range(500)]
    people = gen_people_table(spark.createDataFrame(rows, "seg string, population long"), ["seg"])
    first = {r["seg"]: r["lo"] for r in people.groupBy("seg").agg(F.min("user_id").alias("lo")).collect()}
    at, want = 1, {}
    for seg, n in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        if n:
            want[seg] = at
        at += n
    assert first == want


def test_census_csv_and_catalog_table(spark, tmp_path):
    from reachkit.sources import read_census_csv, read_table

    path = tmp_path / "census.csv"
    path.write_text("gender,age_range,population\nmale,18_24,10\nfemale,18_24,12\n,25_34,7\n")
    census = read_census_csv(spark, str(path), ["gender", "age_range"])
    assert census.schema["population"].dataType.typeName() == "long"
    rows = sorted((r["gender"] or "", r["population"]) for r in census.collect())
    assert rows == [("", 7), ("female", 12), ("male", 10)]
    census.createOrReplaceTempView("census_tbl")
    assert population_total(read_table(spark, "census_tbl", catalog=True)).first()["population"] == 29


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    g = np.sort(rng.random(400) * 30) + 1e-3
    share = curve([0.4, 0.3], [0.2, 1.7], g) + rng.normal(0, 0.004, 400)
    rows = [("x", i, int(a * 1000), int(max(b, 0) * 1000)) for i, (a, b) in enumerate(zip(g, share))]
    reach = spark.createDataFrame(rows, "seg string, i int, impression bigint, reach bigint")
    cen = spark.createDataFrame([("x", 1000)], "seg string, population bigint")
    fits = [fit_mixture_of_deltas(reach.repartition(n, F.col("i") % p), cen, n_deltas=2, demo_cols=["seg"]).first()
            for n, p in ((1, 1), (7, 5), (64, 61))]
    assert fits[0] == fits[1] == fits[2]  # to the last bit


@pytest.mark.parametrize("top", [900, 3000, 10000])
def test_fit_has_no_ceiling_on_long_axes(top):
    for g in (np.linspace(top / 2500, top, 2500), np.geomspace(1e-3, top, 2500)):
        a, x, m, _ = fit_curve(g, curve([0.3, 0.4], [0.1, 2.0], g), 2)
        assert m == 2 and np.allclose(a, [0.3, 0.4], rtol=1e-4) and np.allclose(x, [0.1, 2.0], rtol=1e-4)


def test_a_rate_that_the_points_cannot_tell_raises():
    g = np.linspace(40, 100_000, 2500)
    with pytest.raises(ValueError, match="rate cannot be told"):
        fit_curve(g, curve([0.3, 0.4], [0.1, 2.0], g), 2)


def test_octave_sums_are_the_sums_over_the_points(spark):
    """Errors of arbitrary mixtures from the sums against the points themselves."""
    from reachkit.operators.fit import CurveSums, _curve, _points, curve_sums

    rng = np.random.default_rng(5)
    imp = np.sort(rng.integers(0, 40_000, 300))
    r = rng.random(300)
    rows = [(int(i), float(x) * 1000) for i, x in zip(imp, r)]
    reach = spark.createDataFrame(rows, "impression bigint, reach double")
    sums = _curve(curve_sums(_points(reach, 1000, []), []).first()["sums"])
    assert isinstance(sums, CurveSums) and sums.n == 300
    for rates in ([0.01], [0.3, 5.0], [40.0, 900.0]):
        rates = np.array(rates)
        amp = rng.random(len(rates))
        res = sums.columns(rates) @ amp - sums.y
        want = float(((curve(amp, rates, imp / 1000) - r) ** 2).sum())
        assert float(res @ res) + sums.rest == pytest.approx(want, rel=1e-7)


def test_census_csv_goes_by_its_header(spark, tmp_path):
    from reachkit.sources import read_census_csv

    path = tmp_path / "census.csv"
    path.write_text("population,gender,age_range,extra\n10,male,18_24,1\n 7 ,,25_34,x\n,female,18_24,\n")
    census = read_census_csv(spark, str(path), ["age_range", "gender"])
    assert census.columns == ["age_range", "gender", "population"]
    got = sorted(map(tuple, census.collect()), key=repr)
    assert got == sorted([("18_24", "male", 10), ("25_34", None, 7), ("18_24", "female", None)], key=repr)
    with pytest.raises(ValueError, match="education"):
        read_census_csv(spark, str(path), ["education"])
    path.write_text("gender,population\nmale,many\n")
    with pytest.raises(Exception, match="no whole number"):
        read_census_csv(spark, str(path), ["gender"]).collect()


def test_generation_evaluates_the_people_once(spark, census):
    people = add_n_impressions(gen_people_table(census, ["seg"]), impressions_per_person=6, population_total=260, seed=1)
    rows = gen_synthetic_impressions(people, "2020-03-01 00:00:00", "2020-07-01 00:00:00", ["seg"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence(0, cast(FLOOR") <= 2 and "Union" not in plan
