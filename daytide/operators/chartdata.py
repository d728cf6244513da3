"""The data behind each chart (no rendering)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.columns import clip, finite, rounded
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.sampling import seeded_sample
from daytide.functions.shape import to_long
from daytide.operators.eda import clean_features

FEATURES = schema.MODEL_FEATURES
KEYS = ["user_id", "bet_date"]

# Display names of states on the bar chart.
STATE_NAMES = {
    0: "Stable Active",
    1: "High-Churn Decline",
    2: "Low-Bet Active",
    3: "Reactivation",
}


def missing_zero_rates(summary: DataFrame) -> DataFrame:
    """(feature, metric, rate, axis_max) with metric Missing or Zero."""
    # one row for each feature, so the window over all of them is small
    top = F.max(F.greatest("missing_rate", "zero_rate")).over(Window.partitionBy())
    axis = F.least(F.lit(1.0), F.greatest(F.lit(0.05), top * 1.15))
    return summary.select(
        "feature",
        F.col("missing_rate").alias("Missing"),
        F.col("zero_rate").alias("Zero"),
        axis.alias("axis_max"),
    ).unpivot(["feature", "axis_max"], ["Missing", "Zero"], "metric", "rate").select(
        "feature", "metric", "rate", "axis_max"
    )


def histogram(features: DataFrame, log: bool = False, bins: int = 60) -> DataFrame:
    """(feature, bin, n, lo, hi, median): equal-width bins over values clipped to P1-P99.

    Every bin is returned, empty ones with n = 0. Clipped values land in the edge bins. The median is taken before clipping. With
    ``log`` the same is done on log1p of the non-negative values.
    """
    long = to_long(clean_features(features), [], FEATURES).where("x IS NOT NULL")
    if log:
        long = long.where("x >= 0").withColumn("x", F.log1p("x"))
    marks = exact_quantiles(
        long, ["feature"], "x", {"lo": 0.01, "hi": 0.99, "median": 0.5}
    ).drop("n")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # A value within a billionth of a bin below an edge counts as on it, so that the last
    # bit of a sum does not choose the bin.
    step = F.floor((clip(x, lo, hi) - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)) + 1e-9)
    # One row of marks per feature; a constant feature has a single bin.
    marks = F.broadcast(marks)
    found = (
        long.join(marks, "feature")
        .withColumn("bin", F.least(F.coalesce(step, F.lit(0)) + 1, F.lit(bins)).cast("int"))
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )
    last = F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)
    every = marks.withColumn("bin", F.explode(F.sequence(F.lit(1), last)))
    return every.join(found, ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", "median"
    )


def correlation_cells(corr: DataFrame) -> DataFrame:
    return corr.select("feature_a", "feature_b", rounded(F.col("corr"), 2).alias("corr"))


def daily_trends(daily: DataFrame) -> DataFrame:
    """(bet_date, series, value) of the four daily series."""
    series = ["user_days", "bet_amount", "rtp", "avg_no_bet_streak_days"]
    return (
        daily.select("bet_date", *(F.col(c).cast("double").alias(c) for c in series))
        .unpivot("bet_date", series, "series", "value")
        .orderBy("bet_date", "series")
    )


def ratio_scatter(features: DataFrame, n: int = 50_000, seed: int = 42) -> DataFrame:
    """Sampled amount and count ratios with their log1p; the sample is drawn first."""
    sample = seeded_sample(features, KEYS, n, seed)

    def log_of(c: str) -> Column:
        return F.log1p(F.greatest(F.col(c), F.lit(0.0)))

    return (
        sample.select(
            *KEYS,
            finite("bet_amount_ratio_today_vs_history").alias("amount_ratio"),
            finite("bet_count_ratio_today_vs_history").alias("count_ratio"),
        )
        .dropna(subset=["amount_ratio", "count_ratio"])
        .withColumn("amount_ratio_log", log_of("amount_ratio"))
        .withColumn("count_ratio_log", log_of("count_ratio"))
    )


def rtp_scatter(features: DataFrame, n: int = 50_000, seed: int = 43) -> DataFrame:
    """Sampled daily against seven-day RTP, both within the P99 of the sample."""
    sample = seeded_sample(features, KEYS, n, seed)
    points = sample.select(
        *KEYS, finite("rtp_day").alias("rtp_day"), finite("rtp_7_bet_days").alias("rtp_7_bet_days")
    ).dropna(subset=["rtp_day", "rtp_7_bet_days"])
    # The sample has at most n rows, so the built-in exact percentile fits.
    limits = points.agg(
        F.struct(
            F.percentile("rtp_day", F.lit(0.99)).alias("d"),
            F.percentile("rtp_7_bet_days", F.lit(0.99)).alias("w"),
        )
    ).scalar()
    return points.where(
        (F.col("rtp_day") <= limits["d"]) & (F.col("rtp_7_bet_days") <= limits["w"])
    )


def state_bars(readable: DataFrame, names: dict[int, str] = STATE_NAMES) -> DataFrame:
    """(state_label, row_share_pct, churn7_rate_pct); unnamed states read "State"."""
    pairs = [F.lit(v) for item in names.items() for v in item]
    name = F.coalesce(F.create_map(*pairs)[F.col("hmm_state")], F.lit("State"))
    return readable.select(
        F.format_string("S%d %s", F.col("hmm_state"), name).alias("state_label"),
        "row_share_pct",
        "churn7_rate_pct",
    )
