import datetime as dt

import pytest

from reachkit.plans.prefix import time_bucket
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachkit import (
    add_exposure_index,
    add_first_exposure,
    add_frequency_total,
    generate_frequency_table,
    generate_reach_table,
)
from tests import reference_impl as ref

SCHEMA = "user_id string, timestamp timestamp_ntz, age_range string, weight int"
T0 = dt.datetime(2024, 1, 1)


def ts(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


EDGE_ROWS = [
    # tied timestamps for one id, in two segments
    ("a", ts(1), "X", 2), ("a", ts(1), "W", 5), ("a", ts(3), "X", 1),
    # NULL user ids form one group
    (None, ts(2), "X", 1), (None, ts(1), "Y", 3),
    # NULL timestamp sorts first
    ("b", None, "Y", 4), ("b", ts(2), "Y", 1),
    # NULL demo and NULL weight
    ("c", ts(2), None, None), ("c", ts(5), "X", 2),
    # suffix-collision ids
    ("1", ts(4), "X", 1), ("11", ts(4), "X", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


def as_dicts(rows):
    cols = ["user_id", "timestamp", "age_range", "weight"]
    return [dict(zip(cols, r)) for r in rows]


def collect_reach(df, demos):
    return sorted((tuple(r[c] for c in [*demos, "timestamp", "reach_inc", "impression_inc", "reach", "impression"])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("demos", [[], ["age_range"]])
@pytest.mark.parametrize("mode", ["count", "weighted"])
def test_reach_matches_brute_force(edge, demos, mode):
    got = collect_reach(generate_reach_table(edge, demo_cols=demos or None, mode=mode), demos)
    assert got == ref.reach_table(as_dicts(EDGE_ROWS), demos=demos, weighted=mode == "weighted")


def test_reach_totals(edge):
    rows = generate_reach_table(edge).orderBy(F.col("timestamp").asc_nulls_first()).collect()
    last = rows[-1]
    assert last["impression"] == len(EDGE_ROWS)
    assert last["reach"] == len({r[0] for r in EDGE_ROWS})
    assert rows[0]["timestamp"] is None  # NULL slot first


def test_reach_bad_mode_and_columns(edge):
    with pytest.raises(ValueError, match="unexpected mode"):
        generate_reach_table(edge, mode="sum")
    with pytest.raises(ValueError, match="id_col"):
        generate_reach_table(edge, id_col="nope")
    with pytest.raises(ValueError, match="order_col"):
        add_exposure_index(edge, order_col="nope")


def test_exposure_index_matches_window(edge):
    got = add_frequency_total(edge, tiebreak=["age_range", "weight"]).collect()
    want = ref.exposure_index(as_dicts(EDGE_ROWS), order=("timestamp", "age_range", "weight"))
    # rows are distinct, so map each row back to its position
    pos = {r: i for i, r in enumerate(EDGE_ROWS)}
    for r in got:
        i = pos[(r["user_id"], r["timestamp"], r["age_range"], r["weight"])]
        assert r["exposure_index"] == want[i]
        assert r["frequency_total"] == sum(1 for x in EDGE_ROWS if x[0] == r["user_id"])
    firsts = add_first_exposure(edge).where("is_first = 1").count()
    assert firsts == len({r[0] for r in EDGE_ROWS})


@pytest.mark.parametrize("demos", [[], ["age_range"]])
def test_frequency_matches_brute_force(edge, demos):
    got = generate_frequency_table(edge, demo_cols=demos or None)
    assert "user_id counts" in got.columns
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == ref.frequency_table(as_dicts(EDGE_ROWS), demos=demos)


def test_frequency_weighted_sum_equals_rows(edge):
    rows = generate_frequency_table(edge).collect()
    assert sum(r["frequency_total"] * r["user_id counts"] for r in rows) == len(EDGE_ROWS)


@pytest.mark.parametrize("bucket", [time_bucket("day"), time_bucket("minute"), None])
def test_hot_id_rank_matches_brute_force(spark, bucket):
    # one id holds most rows over many hours (plus NULL times); "cold" ids are small
    rows = [("hot", ts(h % 500) if h % 97 else None, "X", h) for h in range(3000)]
    rows += [(f"c{i % 7}", ts(i % 40) if i % 11 else None, "Y", i) for i in range(120)]
    rows += [(None, ts(3), "Z", 1), (None, None, "Z", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = add_frequency_total(df, tiebreak=["weight"], bucket=bucket).collect()
    want = ref.exposure_index(as_dicts(rows), order=("timestamp", "weight"))
    pos = {r: i for i, r in enumerate(rows)}
    totals = {}
    for r in rows:
        totals[r[0]] = totals.get(r[0], 0) + 1
    assert len(got) == len(rows)
    for r in got:
        i = pos[(r["user_id"], r["timestamp"], r["age_range"], r["weight"])]
        assert r["exposure_index"] == want[i]
        assert r["frequency_total"] == totals[r["user_id"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", None]),
                          st.one_of(st.none(), st.integers(0, 30)),
                          st.sampled_from(["X", "Y", None]),
                          st.one_of(st.none(), st.integers(-1, 4))), min_size=1, max_size=40))
def test_reach_property(spark, raw):
    rows = [(u, ts(h), d, w) for u, h, d, w in raw]
    df = spark.createDataFrame(rows, SCHEMA)
    for demos in ([], ["age_range"]):
        for mode in ("count", "weighted"):
            got = collect_reach(generate_reach_table(df, demo_cols=demos or None, mode=mode), demos)
            assert got == ref.reach_table(as_dicts(rows), demos=demos, weighted=mode == "weighted")
