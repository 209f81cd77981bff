"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (the whole plan runs, nothing
is collected to the driver); the best of ``$BENCH_REPEAT`` runs is reported.
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", "window_form"}.

``window_form`` times the plan shape the reference's operators build (a per-row
``row_number`` window per id, a whole-partition count window, a global running
window), written as Spark SQL over the same views, for comparison with ours at
the same scale ($BENCH_COMPARE=0 skips it).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reachkit.plans.catalog import QUERIES  # noqa: E402
from reachkit.session import local_session  # noqa: E402
from reachkit.sources.tables import event_impressions, line_impressions  # noqa: E402

HEADLINE = [
    "reach_count",
    "reach_segment_count",
    "reach_weighted",
    "frequency_segment_table",
    "exposure_index",
    "explode_weights",
    "assign_uid_time",
    "assign_uid_time_segment",
    "assign_weighted",
    "vid_reach_segment",
    "pool_info",
    "gen_impressions",
    "fit_segment",
    "flow_recovered_total",
    "flow_total",
]


WINDOW_FORM = {
    "reach_count": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS ei FROM lines),
        s AS (SELECT timestamp, sum(CASE WHEN ei = 1 THEN 1 ELSE 0 END) AS reach_inc, count(*) AS impression_inc
              FROM r GROUP BY timestamp)
        SELECT *, sum(reach_inc) OVER (ORDER BY timestamp) AS reach,
               sum(impression_inc) OVER (ORDER BY timestamp) AS impression FROM s""",
    "reach_segment_count": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS ei FROM lines),
        s AS (SELECT age_range, timestamp, sum(CASE WHEN ei = 1 THEN 1 ELSE 0 END) AS reach_inc,
                     count(*) AS impression_inc FROM r GROUP BY age_range, timestamp)
        SELECT *, sum(reach_inc) OVER (PARTITION BY age_range ORDER BY timestamp) AS reach,
               sum(impression_inc) OVER (PARTITION BY age_range ORDER BY timestamp) AS impression FROM s""",
    "frequency_segment_table": """
        SELECT device_type, frequency_total, count(*) AS `user_id counts` FROM (
          SELECT DISTINCT user_id, device_type, count(*) OVER (PARTITION BY user_id) AS frequency_total FROM lines)
        GROUP BY device_type, frequency_total ORDER BY device_type, frequency_total""",
    "reach_weighted": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS ei FROM lines),
        s AS (SELECT timestamp, sum(CASE WHEN ei = 1 THEN weight ELSE 0 END) AS reach_inc, sum(weight) AS impression_inc
              FROM r GROUP BY timestamp)
        SELECT *, sum(reach_inc) OVER (ORDER BY timestamp) AS reach,
               sum(impression_inc) OVER (ORDER BY timestamp) AS impression FROM s""",
    "vid_reach_segment": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY timestamp) AS ei FROM vids_segment),
        s AS (SELECT age_range, timestamp, sum(CASE WHEN ei = 1 THEN 1 ELSE 0 END) AS reach_inc,
                     count(*) AS impression_inc FROM r GROUP BY age_range, timestamp)
        SELECT *, sum(reach_inc) OVER (PARTITION BY age_range ORDER BY timestamp) AS reach,
               sum(impression_inc) OVER (PARTITION BY age_range ORDER BY timestamp) AS impression FROM s""",
    "pool_info": """
        SELECT t.alpha, t.rate, t.start_VID, t.total_VID, count(*) AS impressions,
               count(DISTINCT a.vid) AS VID_reach, count(DISTINCT a.user_id) AS distinct_users
        FROM vids a JOIN vid_table t ON a.vid >= t.start_VID AND a.vid < t.start_VID + t.total_VID
        GROUP BY t.alpha, t.rate, t.start_VID, t.total_VID ORDER BY t.start_VID""",
    "assign_uid_time": """
        SELECT e.vid_seed, e.timestamp, e.user_id, floor(e.p2 * t.total_VID) + t.start_VID AS vid FROM (
          SELECT *, h1 * 2.3283064365386963E-10D + 0.5D AS p1,
                 hash(concat(CAST(h1 AS STRING), CAST(timestamp AS STRING))) * 2.3283064365386963E-10D + 0.5D AS p2, h1 AS vid_seed
          FROM (SELECT *, hash(concat(user_id, CAST(timestamp AS STRING))) AS h1 FROM events)) e
        JOIN vid_table t ON e.p1 >= t.`prob_>=` AND e.p1 < t.`prob_<`""",
    "gen_impressions": """
        SELECT user_id, age_range, k, CAST(1583020800 + floor((hash(concat_ws('|', '7', CAST(user_id AS STRING), CAST(k AS STRING))) * 2.3283064365386963E-10D + 0.5D)
               * 10540800) AS BIGINT) AS timestamp_int
        FROM (SELECT *, explode(sequence(0L, n_impressions - 1)) AS k FROM people_n)""",
    "exposure_index": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp) AS exposure_index FROM events""",
}


def _time(make, repeat):
    best = float("inf")
    for _ in range(repeat):
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 8), app="reachkit-bench")
    QUERIES["population_total"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    timings = {name: _time(lambda n=name: QUERIES[n](spark, sf_dir), repeat) for name in names}
    window_form = {}
    if os.environ.get("BENCH_COMPARE", "1") != "0":
        line_impressions(spark, sf_dir).createOrReplaceTempView("lines")
        event_impressions(spark, sf_dir).createOrReplaceTempView("events")
        for view, name in (("vids", "assign_uid_time"), ("vids_segment", "assign_uid_time_segment"), ("vid_table", "vid_table"),
                           ("people_n", "gen_n_impressions")):
            QUERIES[name](spark, sf_dir).createOrReplaceTempView(view)
        window_form = {name: _time(lambda q=sql: spark.sql(q), repeat) for name, sql in WINDOW_FORM.items()}
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "window_form": window_form,
    }))


if __name__ == "__main__":
    main()
