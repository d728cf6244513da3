"""Summaries of the feature table: per feature, per day, correlations, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions import feature_profile
from daytide.functions.columns import fixed4, numeric, over_nonzero, percent2, plain4
from daytide.functions.feature_profile import Profile
from daytide.functions.pair_moments import pair_moments
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.shape import to_long

FEATURES = schema.MODEL_FEATURES

# Quantiles of the feature summary.
SUMMARY_QUANTILES = {
    "p01": 0.01,
    "p05": 0.05,
    "p25": 0.25,
    "median": 0.50,
    "p75": 0.75,
    "p95": 0.95,
    "p99": 0.99,
}


def clean_features(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """The columns as finite doubles, everything else missing."""
    return features.select(*(numeric(c).alias(c) for c in columns))


def profile(features: DataFrame, columns: list[str] = FEATURES) -> Profile:
    """What summary, correlation and quantiles share, by one scan; they take it as ``profile``."""
    return feature_profile.profile(clean_features(features, columns), columns)


def feature_counts(
    features: DataFrame, columns: list[str] = FEATURES, profile: Profile | None = None
) -> DataFrame:
    """Rows, missing, zeros, moments and range per feature.

    The zero rate counts missing rows in its denominator. The skew is bias-corrected,
    the deviation is the sample one.
    """
    if profile:
        counted = profile.column_moments().selectExpr(
            "feature",
            "rows",
            "n",
            "zeros AS zero_count",
            "mean",
            "CASE WHEN n < 2 THEN NULL WHEN low = high THEN 0D ELSE sqrt(m2 / (n - 1)) END AS std",
            "low AS min",
            "high AS max",
            "sqrt(n) * m3 / nullif(m2 * sqrt(m2), 0) AS g1",
        )
    else:
        long = to_long(clean_features(features, columns), [], columns)
        sums = {
            "rows": "count(*)",
            "n": "count(x)",
            "zero_count": "count_if(x = 0)",
            "mean": "avg(x)",
            "std": "stddev_samp(x)",
            "min": "min(x)",
            "max": "max(x)",
            "g1": "skewness(x)",
        }
        counted = long.groupBy("feature").agg(*(F.expr(sql).alias(name) for name, sql in sums.items()))
    return counted.selectExpr(
        "feature",
        "rows",
        "rows - n AS missing_count",
        "(rows - n) / rows AS missing_rate",
        "zero_count",
        "zero_count / rows AS zero_rate",
        "mean",
        "std",
        "min",
        "max",
        "CASE WHEN n <= 2 THEN NULL WHEN min = max THEN 0D"
        " ELSE g1 * sqrt(n * (n - 1D)) / nullif(n - 2, 0) END AS skew",
    )


def feature_quantiles(
    features: DataFrame, columns: list[str] = FEATURES, profile: Profile | None = None
) -> DataFrame:
    clean, begun = clean_features(features, columns), profile.begun() if profile else None
    return exact_quantiles(clean, ["feature"], "x", SUMMARY_QUANTILES, begun=begun, columns=columns).drop("n")


def feature_summary(
    features: DataFrame, columns: list[str] = FEATURES, profile: Profile | None = None
) -> DataFrame:
    """One row per feature, 18 columns.

    One scan makes the profile, unless it is given; quantiles take one more where no value's
    leading digit is crowded, else one for each further digit. Stage the input.
    """
    profile = profile or feature_profile.profile(clean_features(features, columns), columns)
    # The quantile side has one row per feature.
    quantiles = F.broadcast(feature_quantiles(features, columns, profile))
    return (
        feature_counts(features, columns, profile)
        .join(quantiles, "feature", "left")
        .select(
            "feature",
            "rows",
            "missing_count",
            "missing_rate",
            "zero_count",
            "zero_rate",
            "mean",
            "std",
            "min",
            *SUMMARY_QUANTILES,
            "max",
            "skew",
        )
    )


def daily_summary(features: DataFrame) -> DataFrame:
    """Totals and averages per date."""
    return (
        features.groupBy("bet_date")
        .agg(
            F.count("*").alias("user_days"),
            F.count_distinct("user_id").alias("users"),
            F.sum("bet_amount_today").alias("bet_amount"),
            F.sum("payout_today").alias("payout"),
            F.sum("profit_today").alias("profit"),
            F.avg("bet_days_7d").alias("avg_bet_days_7d"),
            F.avg("no_bet_streak_days").alias("avg_no_bet_streak_days"),
        )
        .withColumn("rtp", over_nonzero(F.col("payout"), F.col("bet_amount")))
    )


def correlation_long(
    features: DataFrame, columns: list[str] = FEATURES, profile: Profile | None = None
) -> DataFrame:
    """(pos_a, pos_b, feature_a, feature_b, corr) for all ordered pairs, pairwise complete.

    A pair without variance in one of its columns has no correlation.
    """
    name = F.array(*(F.lit(c) for c in columns))
    spread = F.sqrt("m2_a") * F.sqrt("m2_b")
    varies = ~F.col("constant_a") & ~F.col("constant_b") & (spread > 0)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / spread))
    moments = profile.pair_moments() if profile else pair_moments(clean_features(features, columns), columns)
    return moments.select(
        "pos_a",
        "pos_b",
        name[F.col("pos_a")].alias("feature_a"),
        name[F.col("pos_b")].alias("feature_b"),
        F.when(varies, r).alias("corr"),
    )


def correlation_wide(corr: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Labelled square matrix from the long form."""
    return corr.groupBy("feature_a").pivot("feature_b", columns).agg(F.first("corr"))


def top_correlations(corr: DataFrame, k: int = 15) -> DataFrame:
    """The k pairs of largest absolute correlation; ties keep column order."""
    return (
        corr.where((F.col("pos_a") < F.col("pos_b")) & F.col("corr").isNotNull())
        .orderBy(F.abs("corr").desc(), "pos_a", "pos_b")
        .limit(k)
        .select("feature_a", "feature_b", "corr")
    )


def dataset_metadata(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.min("bet_date").alias("date_min"),
        F.max("bet_date").alias("date_max"),
    ).withColumn("features", F.array(*(F.lit(c) for c in FEATURES)))


def report_feature_table(summary: DataFrame) -> DataFrame:
    """Summary columns as display text."""
    return summary.select(
        "feature",
        percent2(F.col("missing_rate")).alias("missing"),
        percent2(F.col("zero_rate")).alias("zero"),
        fixed4(F.col("mean")).alias("mean"),
        fixed4(F.col("median")).alias("p50"),
        fixed4(F.col("p95")).alias("p95"),
        fixed4(F.col("p99")).alias("p99"),
        fixed4(F.col("max")).alias("max"),
        fixed4(F.col("skew")).alias("skew"),
    )


def report_top_correlations(top: DataFrame) -> DataFrame:
    return top.select("feature_a", "feature_b", plain4(F.col("corr")).alias("corr"))
