import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachkit import (
    assign_vids,
    explode_weights_to_impressions,
    generate_frequency_table,
    generate_vid_assignment_table,
    mixture_of_delta_pool_info,
    packed_vid_table,
)
from reachkit.sources import mixture_table

T0 = dt.datetime(2024, 3, 1)


def test_explode_weights(spark):
    schema = "user_id string, timestamp timestamp_ntz, weight double"
    rows = [("1", T0, None), ("2", T0, -1.0), ("3", T0, 0.0), ("4", T0, 0.4), ("5", T0, 0.5),
            ("6", T0, 1.0), ("7", T0, 2.5), ("1", T0, 11.0), ("11", T0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    out = explode_weights_to_impressions(df)
    assert out.columns == ["user_id", "timestamp", "weight"]
    ids = sorted(r["user_id"] for r in out.collect())
    # 0.5 and 2.5 round half up; NULL, -1, 0, 0.4 vanish
    assert ids.count("51") == 1 and {"71", "72", "73"} <= set(ids)
    assert not any(i.startswith(("2", "3", "4")) and len(i) == 2 for i in ids)
    assert len(ids) == 1 + 3 + 1 + 11 + 1
    assert ids.count("111") == 2  # "1"+"11" and "11"+"1" collide without a separator
    sep = explode_weights_to_impressions(df, sep="_").where("user_id in ('1_11', '11_1')").count()
    assert sep == 2


def vt_rows(df, demos=()):
    return [tuple(r[c] for c in [*demos, "prob_>=", "prob_<", "alpha", "rate", "start_VID", "total_VID"])
            for r in df.orderBy(*demos, F.col("start_VID")).collect()]


def test_vid_table_single(spark):
    mix = mixture_table(spark, [0.0, 0.2, 0.5], [0.0, 1.0, 1.2])  # zero-padded pool first
    rows = vt_rows(generate_vid_assignment_table(mix, population_size=1000))
    # pools sorted by start: null pool (0), padded pool (1, 0 VIDs), ...
    assert rows[0] == (pytest.approx(0.8), 1.0, 0.0, 0.0, 0, 1)
    pools = [r for r in rows if r[5] != 1 or r[4] != 0]
    assert [(r[4], r[5]) for r in pools] == [(1, 0), (1, 200), (201, 500)]
    assert pools[1][0] == 0.0 and pools[1][1] == pytest.approx(0.2)
    assert pools[2][0] == pytest.approx(0.2) and pools[2][1] == pytest.approx(0.8)


def test_vid_table_segments_and_normalize(spark):
    schema = T.StructType([T.StructField("seg", T.StringType()), T.StructField("population", T.LongType()),
                           T.StructField("alphas", T.ArrayType(T.DoubleType())),
                           T.StructField("rates", T.ArrayType(T.DoubleType()))])
    mix = spark.createDataFrame([
        ("b", 3_000_000_000, [0.5, 0.25], [1.0, 2.0]),   # pool sizes above 2**31, kappa = 1
        ("a", 10, [0.3], [0.5]),                        # fewer pools, kappa < 1
        ("c", 7, [0.5, 0.5], [2.0, 2.0]),               # kappa > 1
    ], schema)
    vt = generate_vid_assignment_table(mix, demo_cols=["seg"])
    rows = vt_rows(vt, ["seg"])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    # segment order is by demo value: a first
    assert [(r[5], r[6]) for r in by["a"] if r[5] != 0] == [(1, 3)]
    assert [(r[5], r[6]) for r in by["b"] if r[5] != 0] == [(4, 1_500_000_000), (1_500_000_004, 750_000_000)]
    assert [(r[5], r[6]) for r in by["c"] if r[5] != 0] == [(2_250_000_004, 4), (2_250_000_008, 4)]
    # every segment has a null pool at VID 0 starting at kappa
    nulls = {r[0]: r[1] for r in rows if r[5] == 0}
    assert nulls == {"a": pytest.approx(0.15), "b": pytest.approx(1.0), "c": pytest.approx(2.0)}
    # VID ranges are disjoint and consecutive
    ranges = sorted((r[5], r[6]) for r in rows if r[5] != 0)
    for (s1, n1), (s2, _) in zip(ranges, ranges[1:]):
        assert s1 + n1 == s2
    norm = vt_rows(generate_vid_assignment_table(mix, demo_cols=["seg"], normalize=True), ["seg"])
    for seg in "abc":
        bounds = [(r[1], r[2]) for r in norm if r[0] == seg]
        assert bounds[0][0] == 0.0 and bounds[-1][1] == pytest.approx(1.0)
        for (lo1, hi1), (lo2, _) in zip(bounds, bounds[1:]):
            assert hi1 == lo2
    packed = packed_vid_table(mix, demo_cols=["seg"]).where("seg = 'b'").first()
    assert packed["start_VIDs"] == [4, 1_500_000_004] and packed["prob_upper"][-1] == pytest.approx(1.0)


def test_normalize_zero_kappa_raises(spark):
    mix = mixture_table(spark, [0.5], [0.0])
    with pytest.raises(Exception, match="kappa"):
        generate_vid_assignment_table(mix, population_size=10, normalize=True).collect()


@pytest.fixture(scope="module")
def impressions(spark):
    rows = [(str(u % 37), T0 + dt.timedelta(minutes=7 * i), "X" if u % 2 else "Y", 1 + u % 3)
            for i, u in enumerate(range(400))]
    rows.append(("z", T0, None, 2))  # NULL demo: dropped by the segmented join
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz, seg string, weight int")


@pytest.fixture(scope="module")
def seg_table(spark):
    mix = mixture_table(spark, [0.4, 0.3], [2.0, 0.5], segments=[("X", 100), ("Y", 50)], demo_cols=["seg"])
    return generate_vid_assignment_table(mix, demo_cols=["seg"])


@pytest.mark.parametrize("mode", ["uid", "uid_time", "weighted"])
def test_assign_vid_inside_pool(spark, impressions, seg_table, mode):
    out = assign_vids(impressions, seg_table, demo_cols=["seg"], mode=mode)
    pools = [(r["seg"], r["start_VID"], r["total_VID"], r["prob_>="], r["prob_<"]) for r in seg_table.collect()]
    rows = out.collect()
    n_in = impressions.where("seg is not null")
    expected = n_in.count() if mode != "weighted" else n_in.agg(F.sum("weight")).first()[0]
    assert len(rows) == expected
    for r in rows:
        match = [p for p in pools if p[0] == r["seg"] and p[3] <= r["p1"] < p[4]]
        assert len(match) == 1
        _, start, total, _, _ = match[0]
        assert start <= r["vid"] < start + total
    if mode == "uid":
        per_user = {}
        for r in rows:
            per_user.setdefault((r["user_id"], r["seg"]), set()).add(r["vid"])
        assert all(len(v) == 1 for v in per_user.values())


def test_assign_single_and_pool_info(spark, impressions):
    mix = mixture_table(spark, [0.4, 0.3], [2.0, 0.5])
    vt = generate_vid_assignment_table(mix, population_size=150)
    out = assign_vids(impressions, vt, mode="uid_time")
    assert out.count() == impressions.count()
    info = mixture_of_delta_pool_info(out, vt, bucket_width=16).collect()
    assert sum(r["impressions"] for r in info) == impressions.count()
    for r in info:
        assert r["VID_reach"] <= r["VID_pool_size"]
        assert r["alpha * rate"] == pytest.approx(r["alpha"] * r["rate"])
    freq = generate_frequency_table(out, id_col="vid").collect()
    assert sum(r["frequency_total"] * r["vid counts"] for r in freq) == impressions.count()


def test_pool_info_null_pools_shared(spark, impressions, seg_table):
    out = assign_vids(impressions, seg_table, demo_cols=["seg"], mode="uid_time")
    zero = out.where("vid = 0").count()
    info = mixture_of_delta_pool_info(out, seg_table).where("VID_pool_size = 1 and alpha = 0").collect()
    # default: a VID-0 row counts in the null pool of every segment (here the two
    # null pools have identical columns, so they form one group)
    assert sum(r["impressions"] for r in info) == 2 * zero
    own = mixture_of_delta_pool_info(out, seg_table, demo_cols=["seg"]).where("alpha = 0").collect()
    assert sum(r["impressions"] for r in own) == zero


def test_assign_errors(spark, impressions, seg_table):
    with pytest.raises(ValueError, match="unexpected mode"):
        assign_vids(impressions, seg_table, demo_cols=["seg"], mode="cookie")
    with pytest.raises(ValueError):
        assign_vids(impressions.drop("timestamp"), seg_table, demo_cols=["seg"])


def test_assign_on_stream(spark, impressions, seg_table, tmp_path):
    from reachkit.streaming import assign_vids_stream

    src = tmp_path / "in"
    impressions.write.parquet(str(src))
    stream = spark.readStream.schema(impressions.schema).parquet(str(src))
    q = assign_vids_stream(stream, seg_table, demo_cols=["seg"], mode="uid_time", sink="memory",
                           query_name="vid_stream_test", checkpoint_location=str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = spark.table("vid_stream_test")
    want = assign_vids(impressions, seg_table, demo_cols=["seg"], mode="uid_time")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streaming_resumes_after_a_restart(spark, impressions, seg_table, tmp_path):
    """A second query with the same checkpoint folder, as a new application would start it, goes on
    where the first stopped: every row is written once."""
    from reachkit.streaming import assign_vids_stream

    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    impressions.write.parquet(src)
    for _ in range(2):
        stream = spark.newSession().readStream.schema(impressions.schema).parquet(src)
        q = assign_vids_stream(stream, seg_table, ckpt, demo_cols=["seg"], path=out, trigger={"availableNow": True})
        q.awaitTermination()
        impressions.write.mode("append").parquet(src)  # the next start finds as many new rows
    got = spark.read.parquet(out)
    want = assign_vids(impressions, seg_table, demo_cols=["seg"], mode="uid_time")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(2 * list(map(tuple, want.collect())))
    with pytest.raises(ValueError):
        assign_vids_stream(spark.readStream.schema(impressions.schema).parquet(src), seg_table, "")


def test_shuffle_joins_match_broadcast(spark, impressions, seg_table):
    """Where tables are too large to broadcast the joins shuffle; results are the same."""
    small = {mode: sorted(map(tuple, assign_vids(impressions, seg_table, demo_cols=["seg"], mode=mode).collect()))
             for mode in ("uid", "weighted")}
    assigned = assign_vids(impressions, seg_table, demo_cols=["seg"], mode="uid_time")
    pools = sorted(map(tuple, mixture_of_delta_pool_info(assigned, seg_table).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for mode, want in small.items():
            for cells in (None, 16):
                large = assign_vids(impressions, seg_table, demo_cols=["seg"], mode=mode, cells=cells)
                assert "BroadcastHashJoin" not in large._jdf.queryExecution().sparkPlan().toString()
                assert sorted(map(tuple, large.collect())) == want
        wide = mixture_of_delta_pool_info(assigned, seg_table, bucket_width=8)
        assert sorted(map(tuple, wide.collect())) == pools
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        assign_vids(impressions, seg_table, demo_cols=["seg"], cells=3)


def test_long_hash_chains(spark):
    from reachkit.functions import vid_chain

    df = spark.createDataFrame([(0,), (1,), (2,), (128,), (129,), (1000,), (None,)], "n long").withColumn("h", F.lit(7))
    got = {r.n: r.v for r in df.select("n", vid_chain("n", F.lit(5), F.lit(1 << 40), "h").alias("v")).collect()}
    assert got[None] is None and [len(got[n]) for n in (0, 1, 2, 128, 129, 1000)] == [0, 1, 2, 128, 129, 1000]
    assert all(got[1000][:n] == got[n] for n in (1, 2, 128, 129))
    step = spark.createDataFrame([(v, w) for v, w in zip(got[1000], got[1000][1:])], "v long, w long")
    assert step.where(F.pmod(F.hash(F.col("v").cast("string")).cast("bigint"), F.lit(1 << 40)) + 5 != F.col("w")).count() == 0


def test_single_row_mixture_is_checked(spark, impressions):
    from reachkit import fit_overlay, generate_reach_table

    two = mixture_table(spark, [0.4], [2.0], segments=[("X", 10), ("Y", 10)], demo_cols=["seg"]).drop("seg")
    reach = generate_reach_table(impressions)
    with pytest.raises(Exception, match="(?i)more than one row"):
        fit_overlay(reach, two).collect()
    with pytest.raises(Exception, match="exactly one row"):
        fit_overlay(reach, two.limit(0)).collect()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0.0, 1.0), st.floats(0.0, 3.0)), min_size=1, max_size=4),
       st.integers(1, 5000))
def test_buckets_partition_unit_interval(spark, pools, population):
    alphas = [a for a, _ in pools]
    rates = [x for _, x in pools]
    kappa = sum(a * x for a, x in pools)
    mix = mixture_table(spark, alphas, rates)
    rows = vt_rows(generate_vid_assignment_table(mix, population_size=population))
    if kappa <= 1:
        bounds = sorted((r[0], r[1]) for r in rows)
        assert bounds[0][0] == 0.0 and bounds[-1][1] == 1.0
        for (lo1, hi1), (lo2, hi2) in zip(bounds, bounds[1:]):
            assert hi1 == lo2 and lo1 <= hi1
    sizes = [r[5] for r in rows if r[4] != 0]
    assert sizes == [int(np.ceil(a * population)) for a in alphas] or sum(sizes) == sum(
        int(np.ceil(a * population)) for a in alphas)


def test_chain_pieces_are_the_chain(spark):
    from reachkit.functions.hashing import vid_chain, vid_chain_pieces

    rows = [(n, 10, 7919, 42 + n) for n in (-1, 0, 1, 4, 5, 6, 23, 300)] + [(None, 10, 7919, 1)]
    df = spark.createDataFrame(rows, "n int, start long, size long, seed int")
    pieces = df.select("n", F.explode(vid_chain_pieces("n", "start", "size", "seed", piece=5)).alias("p"), "start", "size")
    parts = pieces.select("n", vid_chain("p.length", "start", "size", "p.seed").alias("v")).collect()
    whole = {r.n: r.v for r in df.select("n", vid_chain("n", "start", "size", "seed").alias("v")).collect()}
    for n in (1, 4, 5, 6, 23, 300):
        assert [x for r in parts if r.n == n for x in r.v] == whole[n]
    assert {r.n for r in parts} == {1, 4, 5, 6, 23, 300}


def test_a_heavy_row_is_never_one_array(spark):
    imps = spark.createDataFrame([("u", dt.datetime(2024, 1, 1), 1_000_000)], "user_id string, timestamp timestamp_ntz, weight int")
    table = spark.createDataFrame([(0.0, 1.0, 1.0, 1.0, 1, 1_000_003)],
                                  "`prob_>=` double, `prob_<` double, alpha double, rate double, start_VID bigint, total_VID bigint")
    out = assign_vids(imps, table, mode="weighted")
    got = out.agg(F.count("vid"), F.min("vid"), F.max("vid")).first()
    assert got[0] == 1_000_000 and got[1] >= 1 and got[2] <= 1_000_003
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(__piece" not in plan and "AS __piece" in plan or "[__piece" in plan  # pieces are rows first
