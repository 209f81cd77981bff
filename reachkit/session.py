"""Session helper: recommended configuration.

The library never creates a session behind the caller's back, writes no
intermediate tables and needs no checkpoint folder; this helper is used by
tests, the bench and the check tool.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job of the library is designed for.  AQE re-plans joins and
# coalesces small shuffle partitions at run time; skew-join splitting keeps a hot
# segment from landing in one task; the session time zone makes timestamp-to-string
# casts (used by the hash-based assignment) reproducible.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "reachkit",
                  extra: dict | None = None) -> SparkSession:
    """A ``local[cores]`` session with the library's recommended settings (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
