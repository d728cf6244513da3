"""User-day base -> the 17-column feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.columns import over_nonzero


def user_day_history(base: DataFrame) -> DataFrame:
    """Add the features that look at a user's own earlier betting days.

    All windows share one partitioning and one order, so Spark sorts once and reuses
    the exchange of ``user_day_base``. A user has one row per calendar day at most.

    The historical single bet is the unweighted mean of earlier daily means. The
    seven-day count covers calendar days, the seven-day RTP covers betting days.
    """
    by_day = Window.partitionBy("user_id").orderBy("day_no")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    seven_rows = by_day.rowsBetween(-6, 0)
    seven_days = by_day.rangeBetween(-6, 0)

    gap = F.col("day_no") - F.lag("day_no").over(by_day) - 1
    return (
        base.withColumn("day_no", F.unix_date("bet_date"))
        .select(
            "*",
            F.lag("bet_date").over(by_day).alias("prev_bet_date"),
            F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).alias("no_bet_streak_days"),
            F.count("*").over(seven_days).alias("bet_days_7d"),
            F.avg("bet_amount_today").over(before).alias("hist_amount"),
            F.avg("bet_count_today").over(before).alias("hist_count"),
            F.avg("avg_bet_one_time_today").over(before).alias("hist_single"),
            F.sum("payout_today").over(seven_rows).alias("payout_7"),
            F.sum("bet_amount_today").over(seven_rows).alias("bet_7"),
        )
        .drop("day_no")
    )


def user_day_features(base: DataFrame) -> DataFrame:
    """The 17 feature columns in fixed order."""
    out = user_day_history(base)
    out = out.withColumns(
        {
            "bet_amount_ratio_today_vs_history": over_nonzero(
                F.col("bet_amount_today"), F.col("hist_amount")
            ),
            "bet_count_ratio_today_vs_history": over_nonzero(
                F.col("bet_count_today").cast("double"), F.col("hist_count")
            ),
            "current_balance_max_to_avg_bet_ratio": over_nonzero(
                F.col("current_balance_day_max"), F.col("hist_single")
            ),
            "avg_bet_one_time_today_log": F.log1p("avg_bet_one_time_today"),
            "rtp_7_bet_days": over_nonzero(F.col("payout_7"), F.col("bet_7")),
        }
    )
    return schema.require_columns(out, schema.FEATURE_SCHEMA)
