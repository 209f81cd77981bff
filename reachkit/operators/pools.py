"""Pool statistics of an assignment: impressions, VIDs reached and distinct users per pool.

The pool of a VID is found by a range join ``start_VID <= vid < start_VID +
total_VID``.  Instead of comparing every row with every pool (nested loop), the
VID axis is cut into fixed-width buckets; each pool is listed under the buckets
it spans (about total VIDs / width + 2 x pools rows) and the impressions join it
by equality on the bucket, then keep the rows inside the range.

Both distinct counts come from one pass: an impression becomes one partial row
for its VID and one for its user, one ``groupBy`` on (pool, VID or user) combines
them before the shuffle (VID 0, the null pool, is hot by design), and a second
counts the groups.  So the assignment below runs once.

VID 0 is shared by the null pools of all segments: by default every VID-0 row
counts in each of them.  Rows are counted per first VID of a pool, and all null
pools take the one result of VID 0.  ``demo_cols`` restricts the match to the
row's own segment.  Nothing runs when the operator is called; Spark broadcasts
the pool spans when they are small, else the join key ``(demos, bucket)`` spreads
over the VID axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.operators.vid_table import VID_COLUMNS
from reachkit.sources.schema import as_list, require_columns

DEFAULT_VID_BUCKET = 1 << 20


def mixture_of_delta_pool_info(vid_impressions: DataFrame, vid_table: DataFrame, demo_cols=None,
                               id_col: str = "user_id", bucket_width: int = DEFAULT_VID_BUCKET) -> DataFrame:
    """``alpha, rate, "alpha * rate", VID_pool_size, impressions, VID_reach,
    distinct_users`` per pool, ordered by ``start_VID``."""
    demos = as_list(demo_cols)
    require_columns(vid_impressions, ["vid", id_col, *demos])
    require_columns(vid_table, [*demos, *VID_COLUMNS])
    width = F.lit(int(bucket_width)).cast("bigint")

    # The bucket key and the range test are written NULL-tolerant (coalesce) so
    # Catalyst infers no ``isnotnull(vid)`` and pushes no re-evaluation of the
    # VID expression into the assignment's join; a NULL vid matches no pool.
    rows = vid_impressions.select(*demos, "vid", F.col(id_col).alias("__user")).withColumn(
        "__b", F.coalesce(F.floor(F.col("vid") / width), F.lit(-1).cast("bigint")))
    pools = vid_table.select(*demos, *VID_COLUMNS).where(F.col("total_VID") > 0)
    # with demos a row lies in one pool, known by its columns; without, the null pools of all segments hold
    # the same rows (VID 0): one span and one result for them
    pool = VID_COLUMNS if demos else ["start_VID"]
    spans = pools.groupBy(*demos, *pool).agg(F.max("total_VID").alias("__total"))
    spans = spans.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col("start_VID") / width), F.floor((F.col("start_VID") + F.col("__total") - 1) / width))))
    inside = F.coalesce((F.col("vid") >= F.col("start_VID")) & (F.col("vid") < F.col("start_VID") + F.col("__total")), F.lit(False))
    placed = rows.join(spans, on=[*demos, "__b"]).where(inside)
    none = F.lit(None)
    parts = F.stack(F.lit(2), F.lit(True), F.col("vid").cast("bigint"), none.cast(vid_impressions.schema[id_col].dataType),
                    F.lit(False), none.cast("bigint"), F.col("__user")).alias("__of_vid", "__vid", "__user")
    groups = placed.select(*pool, parts).groupBy(*pool, "__of_vid", "__vid", "__user").agg(F.count(F.lit(1)).alias("__n"))
    found = groups.groupBy(*pool).agg(
        F.sum(F.when(F.col("__of_vid"), F.col("__n"))).alias("impressions"), F.count("__vid").alias("VID_reach"),
        F.count("__user").alias("distinct_users"))
    if not demos:  # equal null pools count their common rows once each
        copies = pools.groupBy(*VID_COLUMNS).agg(F.count(F.lit(1)).alias("__copies"))
        found = copies.join(found, "start_VID").withColumn("impressions", F.col("impressions") * F.col("__copies"))
    return (
        found
        .orderBy("start_VID")
        .select(
            "alpha",
            "rate",
            (F.col("alpha") * F.col("rate")).alias("alpha * rate"),
            F.col("total_VID").alias("VID_pool_size"),
            "impressions",
            "VID_reach",
            "distinct_users",
        )
    )
