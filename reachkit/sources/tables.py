"""Scans: catalog/parquet tables, census CSV and the impression views over the
provided TPC-H-like test data.

The views give the test data the impression / census schemas the operators
expect (``user_id`` string, ``timestamp``, ``weight`` int, demos as strings).
They are plain projections over joins, so Catalyst prunes unused columns and
pushes filters down to the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachkit.sources.schema import as_list, require_columns


def read_table(spark: SparkSession, source: str, name: str | None = None, catalog: bool = False) -> DataFrame:
    """Scan a table: the folder ``source`` of ``{name}.parquet`` files, the parquet path
    ``source``, or with ``catalog=True`` the catalog table (or view) ``source``.  Paths go
    to Spark as they are, so they may lie in any store that Spark reads."""
    if catalog:
        return spark.table(source)
    return spark.read.parquet(source if name is None else f"{source.rstrip('/')}/{name}.parquet")


def read_census_csv(spark: SparkSession, path: str, demo_cols) -> DataFrame:
    """Census CSV with a header: the demo columns as strings and ``population`` as a whole number.

    Columns are found by their names in the header, in whatever order, beside any others; an empty field is
    NULL.  A missing column raises at once, a population that is no whole number when its row is read."""
    demos = as_list(demo_cols)
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)  # every column a string
    require_columns(raw, [*demos, "population"], "census column")
    whole = F.trim(F.col("population"))
    number = F.when(whole.isNull() | whole.rlike(r"^[+-]?[0-9]+$"), whole.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("census population is no whole number: "), whole)).cast("bigint"))
    return raw.select(*demos, number.alias("population"))


def _gender(key: Column) -> Column:
    # Fixture rule: the id modulo 3 picks male / female / unknown (NULL).
    return (F.when(key % 3 == 0, F.lit("male"))
            .when(key % 3 == 1, F.lit("female"))
            .otherwise(F.lit(None).cast("string")))


def event_impressions(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """EVENTS view: ``events`` joined to ``customer`` and ``nation``.

    ``hourly=True`` truncates the time to the hour (TV-like slots).
    """
    events = read_table(spark, sf_dir, "events")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ts = F.col("ts")
    if hourly:
        ts = F.date_trunc("hour", ts).cast("timestamp_ntz")
    uid = F.col("user_id")
    return (
        events.join(customer, uid == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            uid.cast("string").alias("user_id"),
            F.col("event_type").alias("device_type"),
            ts.alias("timestamp"),
            (F.lit(1) + uid % 5).cast("int").alias("weight"),
            F.col("n_name").alias("geolocation"),
            F.col("c_mktsegment").alias("age_range"),
            _gender(uid).alias("gender"),
            (uid % 2).cast("int").alias("interest"),
        )
    )


def line_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES view: ``lineitem`` joined to ``orders`` and ``customer`` (has time ties)."""
    lineitem = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_shipdate", "l_quantity", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_returnflag").alias("device_type"),
            F.col("l_shipdate").alias("timestamp"),
            F.col("l_quantity").cast("int").alias("weight"),
            F.col("c_mktsegment").alias("age_range"),
        )
    )


def census_from_customers(spark: SparkSession, sf_dir: str, demo_cols=("age_range",),
                          scale: int = 1) -> DataFrame:
    """CENSUS view: customers counted per segment, times ``scale``.

    Supported demo columns are those the impression views derive from a customer:
    ``age_range`` (market segment) and ``gender`` (key modulo 3).
    """
    demo_cols = as_list(demo_cols)
    customer = read_table(spark, sf_dir, "customer")
    derived = {
        "age_range": F.col("c_mktsegment"),
        "gender": _gender(F.col("c_custkey")),
    }
    unknown = [c for c in demo_cols if c not in derived]
    if unknown:
        raise ValueError(f"census view cannot derive {unknown}")
    return (
        customer.select(*[derived[c].alias(c) for c in demo_cols])
        .groupBy(*demo_cols)
        .agg((F.count(F.lit(1)) * F.lit(scale)).cast("bigint").alias("population"))
    )
