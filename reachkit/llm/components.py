"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (partially aggregated, so a hub is combined map-side) and a join of
written tables (a hub's rows can be split by the skew join).  Nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachkit.llm import common as c


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``u > v``.  Large star: every larger neighbour of a node is tied to the node's smallest
    neighbour; small star: every smaller neighbour is."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = c.stored(low.select("u", F.least("u", "low").alias("m")), "components-low")
        out = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = c.stored(edges.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        near = edges.join(low.hint("merge"), "u")
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return c.stored(out.distinct(), "components-edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes of ``edges(a, b)``."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = c.stored(now, "components-edges")
    while not _settled(now):
        now = _star(_star(now, True), False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge, to a root: the edges are stars around the components' smallest nodes."""
    ends = edges.select("u", F.lit(0).alias("root")).unionAll(edges.select("v", F.lit(1).alias("root")).distinct())
    twice = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.limit(1).count() == 0


def shared_id_links(members: DataFrame, reps: DataFrame, by: list[str]) -> DataFrame:
    """Links ``a, b`` that a doc_id on rows of several classes makes: such a row set is one document, so it
    joins the classes.  ``members(doc_id, *by)`` are the rows, ``reps(*by, rep)`` the classes; a doc_id of one
    class (nearly all) gives no link."""
    many = members.groupBy("doc_id").agg(*[F.min(x).alias(f"lo_{x}") for x in by], *[F.max(x).alias(f"hi_{x}") for x in by])
    apart = " or ".join(f"lo_{x} < hi_{x}" for x in by)
    many = c.stored(many.where(apart).select("doc_id"), "components-shared")
    mine = members.select("doc_id", *by).join(many.hint("merge"), "doc_id").distinct()
    return mine.join(reps.hint("merge"), by).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
