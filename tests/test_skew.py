"""Hot keys: one id holds a third of all rows.  The operators must give exact
results and must not route that id's rows through one task."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reachkit import add_exposure_index, add_frequency_total, generate_frequency_table, generate_reach_table

T0 = dt.datetime(2024, 1, 1)
N_COLD = 4000
N_HOT = 2000


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(f"u{i % 400}", T0 + dt.timedelta(minutes=37 * i), "S" + str(i % 3)) for i in range(N_COLD)]
    rows += [("hot", T0 + dt.timedelta(minutes=53 * i), "S0") for i in range(N_HOT)]
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, seg string")


@pytest.fixture()
def no_coalesce(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def max_partition_share(df):
    # aggregate the ranked column too, or Catalyst prunes the window (and its shuffle)
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("count"), F.max("exposure_index").alias("m")).collect()
    return max(r["count"] for r in counts) / sum(r["count"] for r in counts)


def test_exposure_index_spreads_hot_id(spark, skewed, no_coalesce):
    ours = add_exposure_index(skewed)  # every id is split by day
    hot = ours.where("user_id = 'hot'").orderBy("exposure_index").select("exposure_index").collect()
    assert [r[0] for r in hot] == list(range(1, N_HOT + 1))
    plain = skewed.withColumn("exposure_index", F.row_number().over(Window.partitionBy("user_id").orderBy("timestamp")))
    # the plain window puts the whole hot id (a third of the rows) in one partition
    assert max_partition_share(plain) >= N_HOT / (N_HOT + N_COLD)
    assert max_partition_share(ours) < 0.25


def test_hot_id_with_string_order_is_split(spark, no_coalesce):
    rows = [("hot", f"{i:012d}") for i in range(3000)] + [(f"u{i}", f"{i:012d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id string, t string").withColumn("t", F.reverse("t"))
    out = add_exposure_index(df, order_col="t")
    got = [r.exposure_index for r in out.where("user_id = 'hot'").orderBy("t").collect()]
    assert got == list(range(1, 3001))
    assert max_partition_share(out) < 0.3


def test_plain_window_on_request(spark, skewed):
    a = sorted(map(tuple, add_exposure_index(skewed, bucket=None).collect()))
    assert a == sorted(map(tuple, add_exposure_index(skewed).collect()))


def test_aggregates_combine_before_shuffle(spark, skewed):
    for df in (generate_reach_table(skewed), generate_reach_table(skewed, demo_cols=["seg"]),
               generate_frequency_table(skewed, demo_cols=["seg"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan
        assert "SortAggregate" not in plan.split("Exchange")[-1]  # raw rows are hash-aggregated
    rows = generate_reach_table(skewed).agg(F.max("reach"), F.max("impression")).first()
    assert tuple(rows) == (401, N_HOT + N_COLD)


def test_hot_null_id_inside_one_second(spark, no_coalesce):
    rows = [(f"u{i % 400}", T0 + dt.timedelta(minutes=37 * i), i % 5) for i in range(6000)]
    rows += [(None, T0 + dt.timedelta(microseconds=331 * i), i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, kind int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = add_frequency_total(df)
        assert max_partition_share(out) < 0.1
        got = out.where("user_id is null").orderBy("timestamp").select("exposure_index", "frequency_total").collect()
        assert [tuple(r) for r in got] == [(i, 3000) for i in range(1, 3001)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    plain = add_frequency_total(df, bucket=None)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))


def test_hot_id_at_one_instant_without_a_tiebreak(spark, no_coalesce):
    rows = [("hot", T0, f"d{i}") for i in range(3000)] + [(f"u{i}", T0, "d") for i in range(6000)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, device string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = add_exposure_index(df)
        assert max_partition_share(out) < 0.1
        assert sorted(r[0] for r in out.where("user_id = 'hot'").select("exposure_index").collect()) == list(range(1, 3001))
        assert out.where("user_id != 'hot'").agg(F.max("exposure_index")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_strings_with_a_common_prefix_are_split(spark, no_coalesce):
    rows = [("hot", f"2024-01-01T{i:09d}", i) for i in range(3000)] + [(f"u{i % 700}", f"2024-01-01T{i:09d}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "user_id string, t string, i int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = add_exposure_index(df, order_col="t")
        assert max_partition_share(out) < 0.1
        got = [r[0] for r in out.where("user_id = 'hot'").orderBy("t").select("exposure_index").collect()]
        assert got == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ranges_of_odd_tables(spark):
    empty = spark.createDataFrame([], "user_id string, timestamp timestamp_ntz")
    assert add_frequency_total(empty).collect() == []
    rows = [("a", T0, {"k": 1}), ("a", T0, {"k": 1}), (None, None, None), (None, T0, None)]
    df = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, extra map<string,int>")
    got = sorted((r.user_id or "", r.exposure_index, r.frequency_total) for r in add_frequency_total(df).collect())
    assert got == [("", 1, 2), ("", 2, 2), ("a", 1, 2), ("a", 2, 2)]


def test_hot_segment_is_spread_by_measured_cells(spark, no_coalesce):
    from reachkit import assign_vids, generate_vid_assignment_table

    rows = [(f"u{i}", T0 + dt.timedelta(minutes=i), "S1" if i % 10 == 0 else "S0") for i in range(6000)]
    imps = spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, seg string").repartition(7)
    mix = spark.createDataFrame([(s, 5000, [0.4, 0.2], [0.5, 1.5]) for s in ("S0", "S1", "S2")],
                                "seg string, population bigint, alphas array<double>, rates array<double>")
    table = generate_vid_assignment_table(mix, demo_cols=["seg"])
    want = sorted(map(tuple, assign_vids(imps, table, demo_cols=["seg"], mode="uid_time").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = assign_vids(imps, table, demo_cols=["seg"], mode="uid_time", cells="measured")
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("vid")).collect()
        assert max(r.n for r in parts) < 0.1 * len(rows)
        assert sorted(map(tuple, out.collect())) == want
    finally:
        for key, value in (("spark.sql.shuffle.partitions", "8"), ("spark.sql.autoBroadcastJoinThreshold", "10485760b")):
            spark.conf.set(key, value)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
