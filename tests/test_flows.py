"""End-to-end properties of the model flows (reach -> fit -> VIDs -> reach) on LINES."""

import pytest
from pyspark.sql import functions as F

from reachkit import (
    assign_vids,
    fit_mixture_of_deltas,
    fit_overlay,
    fit_summary,
    generate_reach_table,
    generate_vid_assignment_table,
    penetrate_uniform_reach,
)
from reachkit.sources import census_from_customers, line_impressions
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def data(spark):
    return line_impressions(spark, SF_CHECK), census_from_customers(spark, SF_CHECK)


def final_reach(df):
    return df.agg(F.max("reach")).first()[0]


def test_uid_underestimates_and_uid_time_follows_the_fit(data):
    lines, census = data
    reach = generate_reach_table(lines)
    fit = fit_mixture_of_deltas(reach, census, n_deltas=2)
    table = generate_vid_assignment_table(fit)
    users = final_reach(reach)
    by_user = final_reach(generate_reach_table(assign_vids(lines, table, mode="uid"), id_col="vid"))
    by_time = final_reach(generate_reach_table(assign_vids(lines, table, mode="uid_time"), id_col="vid"))
    fitted = fit_overlay(reach, fit).agg(F.max("fit")).first()[0]
    assert by_user < users  # one VID per user can only lose reach
    assert abs(by_time - fitted) / fitted < 0.05  # one draw per impression follows the curve


def test_in_segment_fit_beats_uniform_penetration(data):
    lines, census = data
    seg_reach = generate_reach_table(lines, demo_cols=["age_range"])
    total_fit = fit_mixture_of_deltas(generate_reach_table(lines), census, n_deltas=2)
    uniform = penetrate_uniform_reach(census, total_fit, demo_cols=["age_range"])
    in_segment = fit_mixture_of_deltas(seg_reach, census, n_deltas=3, demo_cols=["age_range"])

    def avg_rmse(mix):
        return fit_summary(seg_reach, mix, ["age_range"]).agg(F.avg("rmse")).first()[0]

    assert avg_rmse(in_segment) < avg_rmse(uniform)
