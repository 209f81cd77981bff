"""Reach tables: per time slot, new people reached and impressions, plus running totals.

Plan (one pass over the impressions, so whatever assignment or join lies below runs once; no per-row window
over ids; nothing runs when the operator is called):
1. every impression becomes two partial rows, one for its slot and one for its id, and one ``groupBy``
   combines both kinds before and behind its shuffle: slots sum impressions, ids keep their first exposure:
   * time only (count mode, no segments) or time and 32-bit weight as one packed key: fixed-width buffers,
     so a hash aggregate (a hot id or slot is combined map-side);
   * with segments the id rows are per (id, demos), and a second ``groupBy`` over these reduced rows picks
     the smallest (time, demos, weight) of the id, while slot rows pass through;
   * anything else (tiebreak columns, other order columns, fractional weights): ``min(struct(...))``
     directly (sort-based aggregate);
2. first exposures (reach 1 / weight) and slots are summed in one ``groupBy(demos, time)``;
3. running totals come from the bucketed prefix sum (``plans.prefix.running_sums``), so neither a segment
   nor the un-segmented curve is sorted in one task.  Both sides of its join read the per-slot table; the
   second use is a reused exchange.

Ties at an id's first time go to the smallest demos, then the smallest weight.
An id seen in two segments is reached once, in the segment of its first
exposure.  NULL times sort first; NULL weights count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachkit.plans.prefix import running_sums
from reachkit.sources.schema import as_list, require_columns

MODES = ("count", "weighted")

# Layout of the packed (time, weight) key: time in the top digits, the weight
# (offset to be positive, 0 for NULL) in the last 10 decimal digits.
_WEIGHT_SHIFT = "CAST('10000000000' AS DECIMAL(38,0))"
_WEIGHT_OFFSET = 2 ** 31 + 1
_TIME_OFFSET = 2 ** 62
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SMALL_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType)


def _weight_col(df: DataFrame) -> Column:
    if isinstance(df.schema["weight"].dataType, _INTEGRAL):
        return F.coalesce(F.col("weight").cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.col("weight").cast("double"), F.lit(0.0))


def generate_reach_table(df: DataFrame, id_col: str = "user_id", demo_cols=None,
                         mode: str = "count", order_col: str = "timestamp", tiebreak=None,
                         bucket=None) -> DataFrame:
    """Reach table ``[demos], timestamp, reach_inc, impression_inc, reach, impression``.

    ``mode="count"`` counts people and rows; ``mode="weighted"`` sums ``weight``
    (the first exposure's weight for reach; NULL weights count 0).
    """
    if mode not in MODES:
        raise ValueError(f"unexpected mode {mode!r}; expected one of {MODES}")
    demos = as_list(demo_cols)
    tiebreak = as_list(tiebreak)
    require_columns(df, [id_col], "id_col")
    require_columns(df, [order_col, *demos, *tiebreak])
    weighted = mode == "weighted"
    if weighted:
        require_columns(df, ["weight"])

    order_type = df.schema[order_col].dataType
    orderable = isinstance(order_type, (T.TimestampType, T.TimestampNTZType, *_INTEGRAL))
    # The packed key has room for 32-bit weights.
    packable = (not weighted) or isinstance(df.schema["weight"].dataType, _SMALL_INTEGRAL)
    first = _packed if orderable and packable and not tiebreak else _least_struct
    rows = first(df, id_col, order_col, demos, tiebreak, weighted)
    per_slot = (rows.groupBy(*demos, order_col)
                .agg(F.sum("__r").alias("reach_inc"), F.sum("__i").alias("impression_inc")))
    curve = running_sums(per_slot, demos, order_col,
                         {"reach": "reach_inc", "impression": "impression_inc"}, bucket)
    out = curve.select(*demos, order_col, "reach_inc", "impression_inc", "reach", "impression")
    if order_col != "timestamp":
        out = out.withColumnRenamed(order_col, "timestamp")
    return out


def _both(df: DataFrame, demos: list[str], id_col: str, order_col: str, weighted: bool, per_segment: bool,
          carried: dict[str, Column]) -> DataFrame:
    """Two partial rows per impression: ``__of_id`` false (keys: demos ``__d*`` and time ``__t``; ``__i`` of
    the impression) and true (keys: ``__id``, with ``per_segment`` the demos too; the ``carried`` columns)."""
    i = _weight_col(df) if weighted else F.lit(1).cast("bigint")
    base = df.select(F.col(id_col).alias("__id"), F.col(order_col).alias("__t"), i.alias("__i"),
                     *[F.col(d).alias(f"__d{k}") for k, d in enumerate(demos)],
                     *[v.alias(name) for name, v in carried.items()])
    kinds = base.schema
    keys = ["__id", *[f"__d{k}" for k in range(len(demos))], "__t", "__i", *carried]
    of_slot = {"__id", *carried}  # what a slot row leaves out
    of_id = {"__t"} | (set() if per_segment else {f"__d{k}" for k in range(len(demos))})

    def row(flag: bool, without: set) -> list[Column]:
        out = [F.lit(flag)]
        for name in keys:
            if name in without:
                out.append(F.lit(None).cast(kinds[name].dataType))
            elif name == "__i" and flag:
                out.append(F.lit(0).cast(kinds[name].dataType))
            else:
                out.append(F.col(name))
        return out

    return base.select(F.stack(F.lit(2), *row(False, of_slot), *row(True, of_id)).alias("__of_id", *keys))


def _order_key(c: str, dtype: T.DataType) -> Column:
    """Non-negative BIGINT that orders like the column, 0 for NULL (NULL first)."""
    if isinstance(dtype, T.TimestampNTZType):
        v = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    elif isinstance(dtype, T.TimestampType):
        v = F.unix_micros(F.col(c))
    else:
        v = F.col(c).cast("bigint")
    return F.when(F.col(c).isNull(), F.lit(0).cast("bigint")).otherwise(v + F.lit(_TIME_OFFSET))


def _packed(df: DataFrame, id_col: str, order_col: str, demos: list[str], tiebreak: list[str], weighted: bool) -> DataFrame:
    """``[demos], time, __r, __i``: slots and first exposures; time and weight travel as one key."""
    key = _order_key(order_col, df.schema[order_col].dataType)
    if weighted:
        w_key = F.when(F.col("weight").isNull(), F.lit(0).cast("bigint")) \
                 .otherwise(F.col("weight").cast("bigint") + F.lit(_WEIGHT_OFFSET))
        dec = "decimal(38,0)"
        key = key.cast(dec) * F.expr(_WEIGHT_SHIFT) + w_key.cast(dec)
        t_part = F.expr(f"CAST(__k div {_WEIGHT_SHIFT} AS BIGINT)")
        w_part = F.expr(f"CAST(__k % {_WEIGHT_SHIFT} AS BIGINT)")
    else:
        t_part, w_part = F.col("__k"), F.lit(_WEIGHT_OFFSET + 1).cast("bigint")
    ds = [f"__d{k}" for k in range(len(demos))]
    rows = _both(df, demos, id_col, order_col, weighted, True, {"__k": key, "__s": F.col(order_col)})
    per = (rows.groupBy("__of_id", "__id", *ds, "__t")
           .agg(F.sum("__i").alias("__i"), F.min("__k").alias("__k"), F.min("__s").alias("__s")))
    # a NULL time is the smallest key (min() of the time itself skips it)
    per = per.select("__of_id", "__id", *ds, "__t", "__i", t_part.alias("__tk"), w_part.alias("__wk"), "__s")
    if demos:  # per id, the smallest over its few segments; slot rows pass
        of_id = F.col("__of_id")
        least = F.when(of_id, F.struct("__tk", *ds, "__wk", "__s"))
        out = (per.groupBy("__of_id", "__id", *[F.when(~of_id, F.col(d)).alias(d) for d in ds], "__t")
               .agg(F.sum("__i").alias("__i"), F.min(least).alias("__f")))
        per = out.select("__of_id", "__t", "__i", F.col("__f.__tk").alias("__tk"), F.col("__f.__wk").alias("__wk"),
                         F.col("__f.__s").alias("__s"), *[F.when(of_id, F.col(f"__f.{d}")).otherwise(F.col(d)).alias(d) for d in ds])
    weight = F.when(F.col("__wk") == 0, F.lit(0)).otherwise(F.col("__wk") - F.lit(_WEIGHT_OFFSET)).cast("bigint")
    time = F.when(~F.col("__of_id"), F.col("__t")).when(F.col("__tk") != 0, F.col("__s"))
    return per.select(*[F.col(d).alias(name) for d, name in zip(ds, demos, strict=True)], time.alias(order_col),
                      F.when(F.col("__of_id"), weight).otherwise(F.lit(0).cast("bigint")).alias("__r"), "__i")


def _least_struct(df: DataFrame, id_col: str, order_col: str, demos: list[str], tiebreak: list[str], weighted: bool) -> DataFrame:
    """The same for any order column, by the smallest (time, tiebreak, demos, weight) of every id."""
    names = list(dict.fromkeys([order_col, *tiebreak, *demos] + (["weight"] if weighted else [])))
    at = {name: f"c{k}" for k, name in enumerate(names)}
    ds = [f"__d{k}" for k in range(len(demos))]
    rows = _both(df, demos, id_col, order_col, weighted, False,
                 {"__f": F.struct(*[F.col(name).alias(c) for name, c in at.items()])})
    per = rows.groupBy("__of_id", "__id", *ds, "__t").agg(F.sum("__i").alias("__i"), F.min("__f").alias("__f"))
    of_id = F.col("__of_id")
    if weighted:
        kind = df.schema["weight"].dataType
        w = F.col(f"__f.{at['weight']}")
        r = F.coalesce(w.cast("bigint"), F.lit(0).cast("bigint")) if isinstance(kind, _INTEGRAL) else F.coalesce(w.cast("double"), F.lit(0.0))
    else:
        r = F.lit(1).cast("bigint")
    nothing = F.lit(0).cast(per.schema["__i"].dataType)
    return per.select(*[F.when(of_id, F.col(f"__f.{at[name]}")).otherwise(F.col(d)).alias(name) for d, name in zip(ds, demos, strict=True)],
                      F.when(of_id, F.col(f"__f.{at[order_col]}")).otherwise(F.col("__t")).alias(order_col),
                      F.when(of_id, r).otherwise(nothing).alias("__r"), "__i")
