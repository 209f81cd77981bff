"""Distributed prefix computations over an ordered column (running sums, ranks).

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key into one
task, and ``Window.orderBy(t)`` with no key puts the whole table into one task.
Both break at scale: one id (or the NULL id, or one segment) may hold a third of
all rows.  Here the order column is cut into monotone *buckets*; each
(key, bucket) is ranked or summed on its own, and the totals of earlier buckets
of the same key come from a small per-(key, bucket) summary table.  The summary
is built with partially aggregated ``groupBy``s, so a hot key never gathers in
one task; work per task is bounded by one (key, bucket).

The per-(key, bucket) rows are joined back on a single struct key: struct
equality treats NULL fields as equal (NULL ids / NULL times form one group, as
in a window), and the later window reuses the join's hash partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TIME_UNIT = "hour"
_PK = "__pk"
_BK = "__bucket"


def time_bucket(unit: str = DEFAULT_TIME_UNIT, width: float | None = None) -> Callable[[Column, T.DataType], Column]:
    """Bucket rule: ``date_trunc(unit)`` for times, ``floor(x / width)`` for numbers,
    the value itself for dates, the first characters of strings, one bucket for
    anything else.  Buckets must be non-decreasing in the order column (NULL stays
    NULL and sorts first)."""

    def rule(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.date_trunc(unit, c)
        if isinstance(dtype, T.DateType):
            return c
        if isinstance(dtype, T.NumericType):
            return F.floor(c / F.lit(width or 3600.0))
        if isinstance(dtype, T.StringType):
            return F.substring(c, 1, 8)
        return F.when(c.isNull(), F.lit(None)).otherwise(F.lit(0))

    return rule


def _bucket(df: DataFrame, order_col: str, bucket) -> Column:
    rule = bucket or time_bucket()
    return rule(F.col(order_col), df.schema[order_col].dataType)


def running_sums(df: DataFrame, part_cols: Sequence[str], order_col: str,
                 sums: dict[str, str], bucket=None) -> DataFrame:
    """Add ``out = sum(value) over (partition by part order by order_col rows
    unbounded preceding)`` for every ``out: value`` in ``sums``.

    ``df`` must have one row per (part, order value) -- e.g. a per-slot
    aggregate -- so the running sum by rows equals the running sum by range.
    """
    part_cols = list(part_cols)
    keyed = df.withColumn(_PK, F.struct(*part_cols, _bucket(df, order_col, bucket).alias(_BK)))
    within = Window.partitionBy(_PK).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumns({**{f"__loc_{o}": F.sum(v).over(within) for o, v in sums.items()},
                               "__row": F.count(F.lit(1)).over(within)})
    # a bucket's total stands in its last row: no shuffle of its own, and the window's exchange is reused
    last = local.groupBy(_PK).agg(F.max(F.struct("__row", *[f"__loc_{o}" for o in sums])).alias("__last"))
    earlier = (Window.partitionBy(*[F.col(f"{_PK}.{c}") for c in part_cols]).orderBy(f"{_PK}.{_BK}")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = last.select(_PK, *[F.coalesce(F.sum(f"__last.__loc_{o}").over(earlier), F.lit(0)).alias(f"__off_{o}") for o in sums])
    out = local.join(offsets, _PK)
    out = out.withColumns({o: F.col(f"__off_{o}") + F.col(f"__loc_{o}") for o in sums})
    return out.select(*df.columns, *[o for o in sums if o not in df.columns])


def bucketed_row_number(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                        out_col: str, bucket=None, total_col: str | None = None) -> DataFrame:
    """Add ``out_col = row_number() over (partition by part order by order_cols)``
    and optionally ``total_col = count(*) over (partition by part)``.

    The first order column decides the bucket; the others break ties inside it.
    """
    part_cols = list(part_cols)
    order_cols = list(order_cols)
    keyed = df.withColumn(_BK, _bucket(df, order_cols[0], bucket))
    counts = keyed.groupBy(*part_cols, _BK).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*part_cols).orderBy(_BK).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.struct(*part_cols, _BK).alias(_PK),
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off")]
    if total_col:
        cols.append(F.sum("__n").over(Window.partitionBy(*part_cols)).alias(total_col))
    offsets = counts.select(*cols)
    within = Window.partitionBy(_PK).orderBy(*order_cols)
    joined = keyed.withColumn(_PK, F.struct(*part_cols, _BK)).join(offsets, _PK)
    out = joined.withColumn(out_col, F.col("__off") + F.row_number().over(within))
    extra = [out_col] + ([total_col] if total_col else [])
    return out.select(*df.columns, *extra)


SPLITTERS = 128  # rows drawn to cut hot parts: each of their ranges holds about 1 / SPLITTERS of all rows


def drawn_rows(df: DataFrame, row_hash: Column, n: int = SPLITTERS) -> DataFrame:
    """About ``n`` rows of ``df`` (at most ``n`` different hashes): the smallest hash of each of ``n`` classes
    of hashes.  A row's hash decides, so every evaluation draws the same ones; hash aggregates and a
    semi-join with at most ``n`` broadcast rows."""
    hashed = df.withColumn("__h", row_hash)
    least = hashed.groupBy(F.pmod("__h", F.lit(n)).alias("__class")).agg(F.min("__h").alias("__h")).select("__h")
    return hashed.join(F.broadcast(least), "__h", "left_semi").drop("__h")


def ranked_by_ranges(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str], out_col: str,
                     total_col: str | None = None, n: int = SPLITTERS) -> DataFrame:
    """Add ``out_col = row_number() over (partition by part order by order_cols)`` and optionally
    ``total_col = count(*) over (partition by part)``, with one shuffle of the rows whatever parts are hot.

    ``n`` rows are drawn from the whole table, so a part with a third of all rows is drawn about n / 3 times:
    these rows cut it into ranges of (order, hash of the row), even if it lies within one second or at one
    instant.  A row's rank is its rank in its range plus the part's rows in earlier ranges.  Parts that are
    not drawn (nearly all) are one range.  What travels is bounded: at most ``n`` cuts and their counts, both
    broadcast; the counts are combined map-side.  (Rows that are equal in all columns stay in one range.)
    """
    part_cols, order_cols = list(part_cols), list(order_cols)
    hashable = [f.name for f in df.schema.fields if not _holds_map(f.dataType)]
    row_hash = F.xxhash64(*hashable)
    part = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(part_cols)])  # equal structs: NULL fields too
    # rows of one order are cut by another hash than the one that draws
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], F.xxhash64(row_hash).alias("s"))
    cuts = (drawn_rows(df, row_hash, n).select(part.alias("__part"), place.alias("__cut"))
            .groupBy("__part").agg(F.collect_set("__cut").alias("__cuts")))

    keyed = df.withColumn("__part", part).join(F.broadcast(cuts), "__part", "left")
    placed = keyed.withColumn("__range", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("__cuts", lambda cut: cut <= place)))).withColumn("__cut", F.col("__cuts").isNotNull()).drop("__cuts")

    counts = placed.where("__cut").groupBy("__part", "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__part").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                            F.sum("__n").over(Window.partitionBy("__part")).alias("__total"))  # at most 2 n rows
    joined = placed.drop("__cut").join(F.broadcast(offsets), ["__part", "__range"], "left")

    within = Window.partitionBy(*part_cols, "__range")
    out = {out_col: (F.row_number().over(within.orderBy(*order_cols)) + F.coalesce("__before", F.lit(0))).cast("bigint")}
    if total_col:
        out[total_col] = F.coalesce("__total", F.count(F.lit(1)).over(within))
    return joined.withColumns(out).select(*df.columns, *out)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


RANGE_SAMPLES = 16  # boundaries of an ordered table; buckets hold about 1 / RANGE_SAMPLES of its rows


def exclusive_running_total(df: DataFrame, order_cols: Sequence[str], value_col: str,
                            out_col: str) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over all rows before this one in
    ascending ``order_cols`` order (NULLs first; rows must be unique on them).

    Used for person-id offsets over census-sized tables.  The rows are cut into
    ranges at the keys of ``RANGE_SAMPLES`` rows drawn by hash (a bounded scalar,
    the same in every evaluation), so a table of millions of segments is never
    ordered in one task, whatever its columns are.
    """
    order_cols = list(order_cols)
    if not order_cols:
        return df.withColumn(out_col, F.lit(0).cast("bigint"))
    key = F.struct(*order_cols)
    drawn = F.array(*[F.min_by(key, F.xxhash64(*order_cols, F.lit(i))) for i in range(RANGE_SAMPLES)])
    bounds = df.agg(F.array_sort(F.array_distinct(drawn)).alias("bounds")).scalar()
    ranged = (df.withColumn("__ord", key).withColumn("__bounds", bounds)
              .withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= F.col("__ord")))).drop("__bounds"))
    totals = ranged.groupBy("__range").agg(F.sum(value_col).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGE_SAMPLES + 1 rows
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("__range").orderBy("__ord").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, "__range").withColumn(
        out_col, (F.col("__off") + F.coalesce(F.sum(value_col).over(within), F.lit(0))).cast("bigint"))
    return out.select(*df.columns, out_col)
