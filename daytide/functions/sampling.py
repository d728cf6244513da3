"""Repeatable sample of an exact number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """min(n, rows) rows without replacement: the n smallest hashes of (keys, seed).

    The result depends on the rows only, not on their partitioning. A histogram over
    the 65,536 leading hash digits finds the digit where n is reached, so only about
    n rows go into the final top-n instead of n rows from every partition.
    """
    # Dates and numbers go in as text, so any engine with md5 draws the same rows.
    tagged = df.withColumn("_h", F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))))
    digit = F.substring("_h", 1, 4)
    histogram = tagged.groupBy(digit.alias("_d")).agg(F.count("*").alias("_c"))
    # At most 65,536 rows reach this window.
    running = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        histogram.withColumn("_upto", F.sum("_c").over(running))
        .where(F.col("_upto") >= n)
        .agg(F.min("_d"))
        .scalar()
    )
    return (
        tagged.where(digit <= F.coalesce(cut, F.lit("ffff")))
        .orderBy("_h", *keys)
        .limit(n)
        .drop("_h")
    )
