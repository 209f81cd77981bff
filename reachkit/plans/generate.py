"""Row generation that never asks one task to produce a huge group.

``explode(sequence(0, n - 1))`` on a row with ``n`` in the millions would build
one giant array in one task.  Here a row first becomes ``ceil(n / chunk)``
chunk descriptors, the descriptors are spread over a fixed number of partitions
(an explicit count, so adaptive execution does not coalesce the tiny descriptor
rows back into one task), and each chunk is then expanded to at most ``chunk``
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK = 100_000


def target_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def explode_count(df: DataFrame, n_col: str, out_col: str, chunk: int = DEFAULT_CHUNK,
                  spread_by=(), partitions: int | None = None) -> DataFrame:
    """Replace each row by rows ``out_col = 0 .. n - 1`` (rows with ``n < 1`` vanish).  ``df`` is
    evaluated once: rows of one chunk and of many go through the same exchange, by
    ``spread_by`` and the number of the chunk."""
    chunk = int(chunk)
    n = F.col(n_col).cast("bigint")
    parts = partitions or target_partitions(df)
    chunks = (
        df.where(n >= 1)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                    F.floor((n - 1) / F.lit(chunk)).cast("bigint"))))
        .repartition(parts, *[F.col(c) for c in spread_by], F.col("__chunk"))
    )
    first = F.col("__chunk") * F.lit(chunk)
    last = F.least(first + F.lit(chunk), n) - 1
    return chunks.withColumn(out_col, F.explode(F.sequence(first, last))).drop("__chunk")
