"""Virtual-ID assignment by deterministic hashing.

For every impression a first hash ``h1`` gives ``p1`` in [0, 1) which selects the
pool whose probability bucket holds it (a range condition against the VID
table); a second draw picks the VID inside the pool's range.

* ``uid``:      ``h1 = hash(user_id)``, ``p2 = u(hash(str(h1)))`` -- one VID per user;
* ``uid_time``: ``h1 = hash(user_id || timestamp)``, ``p2 = u(hash(str(h1) || timestamp))``;
* ``weighted``: pool from ``hash(user_id)``, then ``round(weight)`` VIDs per row by
  a hash chain inside the pool (one output row per VID).

Plan: ``h1``/``p1`` are computed before the join.  The VID table is a model
table; it joins on the demo columns and a cell of [0, 1), the bucket test being
the residual condition (an equi-join, never a nested loop).  Spark broadcasts
the table when its statistics say it is small: then the operator is map-only.
Otherwise it is a shuffle join; ``cells`` spreads a segment over so many keys
(1 with segments, 1,024 without, where the cell is the only key).  With
``cells="measured"`` the segments are counted (map-side, one row each) and only
those with over ``HOT_SHARE`` of all rows, so few that they are broadcast, get
``HOT_CELLS`` keys and as many table rows.  Nothing runs when the operator is called, and it
works on a streaming DataFrame too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.functions.hashing import to_uniform, vid_chain, vid_chain_pieces
from reachkit.functions.rounding import half_up_int
from reachkit.operators.vid_table import VID_COLUMNS
from reachkit.sources.schema import as_list, require_columns

MODES = ("weighted", "uid", "uid_time")
MEASURED = "measured"
P_BUCKETS = 1024
HOT_SHARE = 1 / 32  # of all impressions: a segment with more is hot (fewer than 32 can be)
HOT_CELLS = 256


def assign_vids(impressions: DataFrame, vid_table: DataFrame, demo_cols=None, mode: str = "uid",
                id_col: str = "user_id", cells: int | str | None = None) -> DataFrame:
    """Assign VIDs to impressions (see module doc).

    Output: ``[demos], vid, timestamp, h1, p1, p2, <id_col>`` for ``uid`` and
    ``uid_time``; ``[demos], vid, timestamp, h1, p1`` for ``weighted``.
    Rows whose demos have no VID-table row (e.g. NULL demos) are dropped.
    ``cells`` (a power of two) is the number of cells of [0, 1) the join key
    gets: each pool is listed under the cells its interval touches.
    ``"measured"`` does so for hot segments only (not on a stream).
    """
    if mode not in MODES:
        raise ValueError(f"unexpected mode {mode!r}; expected one of {MODES}")
    demos = as_list(demo_cols)
    require_columns(impressions, [id_col, "timestamp", *demos])
    if mode == "weighted":
        require_columns(impressions, ["weight"])
    require_columns(vid_table, [*demos, *VID_COLUMNS])

    measured = cells == MEASURED and bool(demos)
    n_cells = HOT_CELLS if measured else int((1 if demos else P_BUCKETS) if cells in (None, MEASURED) else cells)
    if n_cells & (n_cells - 1):
        raise ValueError("cells must be a power of two")  # scaling by it is exact: no pair is missed
    table = vid_table.select(*demos, *VID_COLUMNS)

    uid = F.col(id_col).cast("string")
    ts = F.col("timestamp").cast("string")
    h1 = F.hash(F.concat(uid, ts)) if mode == "uid_time" else F.hash(uid)
    keyed = impressions.withColumn("h1", h1).withColumn("p1", to_uniform(F.col("h1")))

    in_bucket = (F.col("p1") >= F.col("prob_>=")) & (F.col("p1") < F.col("prob_<"))
    on = list(demos)
    if n_cells > 1:
        lo, hi = F.col("prob_>="), F.col("prob_<")
        touched = F.sequence(F.floor(lo * n_cells), F.least(F.floor(hi * n_cells), F.lit(n_cells - 1).cast("bigint")))
        cell = F.floor(F.col("p1") * n_cells)
        table = table.where((lo < hi) & (lo < 1.0))
        if measured:
            hot = F.broadcast(_hot_segments(impressions, demos))
            none = F.lit(0).cast("bigint")
            table = table.join(hot, on=demos, how="left")
            touched = F.when(F.col("__hot"), touched).otherwise(F.array(none))
            keyed = keyed.join(hot, on=demos, how="left")
            cell = F.when(F.col("__hot"), cell).otherwise(none)
        table = table.withColumn("__pb", F.explode(touched)).drop("__hot")
        keyed = keyed.withColumn("__pb", cell).drop("__hot")
        on.append("__pb")
    joined = keyed.join(table, on=on).where(in_bucket).drop("__pb")

    if mode == "weighted":
        # the chain of a heavy row becomes rows piece by piece: no array holds more than a piece
        pieces = vid_chain_pieces(half_up_int("weight"), "start_VID", "total_VID", "h1")
        cut = joined.select(*demos, "timestamp", "h1", "p1", "start_VID", "total_VID", F.explode(pieces).alias("__piece"))
        vids = vid_chain("__piece.length", "start_VID", "total_VID", "__piece.seed")
        return cut.select(*demos, F.explode(vids).alias("vid"), "timestamp", "h1", "p1")

    if mode == "uid":
        p2 = to_uniform(F.hash(F.col("h1").cast("string")))
    else:
        p2 = to_uniform(F.hash(F.concat(F.col("h1").cast("string"), ts)))
    return (
        joined.withColumn("p2", p2)
        .withColumn("vid", (F.floor(F.col("p2") * F.col("total_VID")) + F.col("start_VID")).cast("bigint"))
        .select(*demos, "vid", "timestamp", "h1", "p1", "p2", id_col)
    )


def _hot_segments(impressions: DataFrame, demos: list[str]) -> DataFrame:
    """``demos, __hot`` of the segments with over ``HOT_SHARE`` of all impressions."""
    counts = impressions.groupBy(*demos).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.where(F.col("__n") > total * F.lit(HOT_SHARE)).select(*demos, F.lit(True).alias("__hot"))
