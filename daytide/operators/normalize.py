"""Impute, winsorise and standardise the ten model features.

Fit and transform are separate. The statistics are fitted on all user-days, also of
users that are later left out of training. Every statistic is a global aggregate whose
partial results combine map-side; only single rows move between the passes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.columns import clip, finite, nan_to_null
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.shape import small_table

KEYS = ["user_id", "bet_date"]
FEATURES = schema.MODEL_FEATURES


def fill_constants(features: DataFrame) -> DataFrame:
    """Keys and model features; constants replace missing values, infinities go missing.

    The order matters: an infinity is not filled by the constant but by the median.
    """
    cols = []
    for c in FEATURES:
        x = nan_to_null(F.col(c).cast("double"))
        if c in schema.CONSTANT_FILLS:
            x = F.coalesce(x, F.lit(schema.CONSTANT_FILLS[c]))
        cols.append(finite(x).alias(c))
    return features.select(*KEYS, *cols)


def fit_fill_values(filled: DataFrame) -> DataFrame:
    """(feature, fill_value): the median left after the constants."""
    return exact_quantiles(filled, ["feature"], "x", {"fill_value": 0.5}, columns=FEATURES).select(
        "feature", "fill_value"
    )


def impute(filled: DataFrame, fill: dict[str, float]) -> DataFrame:
    """A feature without any value has no median: 0 is filled."""
    return filled.select(
        *KEYS, *(F.coalesce(F.col(c), F.lit(fill.get(c, 0.0))).alias(c) for c in FEATURES)
    )


def fit_bounds(imputed: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(feature, p01, p99) of the imputed columns."""
    return exact_quantiles(imputed, ["feature"], "x", {"p01": low, "p99": high}, columns=FEATURES).drop("n")


def winsorize(imputed: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """Every feature limited to its [p01, p99]; bounds as {feature: {p01, p99}}."""
    return imputed.select(
        *KEYS,
        *(
            clip(F.col(c), F.lit(bounds[c]["p01"]), F.lit(bounds[c]["p99"])).alias(c)
            for c in FEATURES
        ),
    )


def fit_moments(winsorized: DataFrame) -> DataFrame:
    """(feature, mean, std): population deviation, 1 for a constant column."""
    aggs = []
    for c in FEATURES:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    std = {c: F.col(f"{c}__s") for c in FEATURES}
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}__m").alias("mean"),
            F.when(std[c] == 0, F.lit(1.0)).otherwise(std[c]).alias("std"),
        )
        for c in FEATURES
    ]
    return winsorized.agg(*aggs).select(F.inline(F.array(*rows)))


def fit_marks(filled: DataFrame, low: float = 0.01, high: float = 0.99) -> dict[str, dict[str, float]]:
    """{feature: {fill_value, p01, p99}} by one quantile call over the known values.

    Filling m missing values with the median puts m equal values between the known ones up
    to the median and those above it. So a rank of the filled column is a rank of the known
    values, or that of the median.
    """
    names = [f"{end}_{name}" for name in ("p01", "p99") for end in ("a", "z")]

    def positions(known: int, rows: int) -> dict[str, float]:
        middle, missing = (known - 1) / 2, rows - known
        below = (known + 1) // 2
        out = {"fill_value": middle}
        for name, p in (("p01", low), ("p99", high)):
            at = (rows - 1) * p
            for end, rank in (("a", math.floor(at)), ("z", math.ceil(at))):
                inside = below <= rank < below + missing
                out[f"{end}_{name}"] = middle if inside else rank if rank < below else rank - missing
        return out

    probs = {"fill_value": 0.5} | dict.fromkeys(names, 0.5)
    marks = exact_quantiles(filled, ["feature"], "x", probs, positions=positions, columns=FEATURES)
    rows = filled.count()
    found = {r["feature"]: r.asDict() for r in marks.collect()}
    out = {}
    for c in FEATURES:
        mark = found.get(c, dict.fromkeys(probs, 0.0))  # without any value 0 is filled
        out[c] = {"fill_value": mark["fill_value"]}
        for name, p in (("p01", low), ("p99", high)):
            part = (rows - 1) * p - math.floor((rows - 1) * p)
            out[c][name] = mark[f"a_{name}"] + (mark[f"z_{name}"] - mark[f"a_{name}"]) * part
    return out


def fit_stats(features: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(feature, fill_value, p01, p99, mean, std), ten rows.

    Median and P1/P99 of the filled column come from one quantile call, and go as literals
    into the pass for the moments of the clipped columns, which stays lazy. Pass a staged
    table.
    """
    filled = fill_constants(features)
    bounds = fit_marks(filled, low, high)
    fill = {c: bounds[c]["fill_value"] for c in FEATURES}
    imputed = impute(filled, fill)
    moments = fit_moments(winsorize(imputed, bounds))
    known = F.create_map(
        *(
            part
            for c in FEATURES
            for part in (
                F.lit(c),
                F.struct(
                    F.lit(fill[c]).alias("fill_value"),
                    F.lit(bounds[c]["p01"]).alias("p01"),
                    F.lit(bounds[c]["p99"]).alias("p99"),
                ),
            )
        )
    )
    return moments.withColumn("k", known[F.col("feature")]).select(
        "feature", "k.fill_value", "k.p01", "k.p99", "mean", "std"
    )


def transform(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Keys and the ten ``*_z`` columns; a narrow projection without any shuffle."""
    fitted = small_table(stats, "feature")
    fill = {c: fitted[c]["fill_value"] for c in FEATURES}
    clipped = winsorize(impute(fill_constants(features), fill), fitted)
    out = clipped.select(
        *KEYS,
        *(
            ((F.col(c) - F.lit(fitted[c]["mean"])) / F.lit(fitted[c]["std"])).alias(f"{c}_z")
            for c in FEATURES
        ),
    )
    return schema.require_columns(out, schema.Z_SCHEMA)
