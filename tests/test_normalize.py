from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.shape import small_table
from daytide.operators import normalize

INF, NAN = float("inf"), float("nan")
M = schema.MODEL_FEATURES


def feature_frame(spark, columns, n):
    """Feature table from some given columns; the other features are 1."""
    wide = spark.createDataFrame(
        [
            tuple([f"u{i % 3}", date(2026, 1, 1) + timedelta(days=i)])
            + tuple(columns[c][i] if c in columns else 1.0 for c in M)
            for i in range(n)
        ],
        "user_id string, bet_date date, " + ", ".join(f"{c} double" for c in M),
    )
    return wide


def test_constants_fill_missing_but_not_infinite(spark):
    df = feature_frame(spark, {"bet_amount_ratio_today_vs_history": [None, NAN, INF, 5.0]}, 4)
    got = [
        r[0]
        for r in normalize.fill_constants(df)
        .orderBy("bet_date")
        .select("bet_amount_ratio_today_vs_history")
        .collect()
    ]
    assert got == [1.0, 1.0, None, 5.0]


def test_infinity_gets_the_median_taken_after_the_constants(spark):
    df = feature_frame(
        spark,
        {
            "current_balance_max_to_avg_bet_ratio": [None, None, None, 8.0, INF],
            "rtp_day": [None, 1.0, 3.0, -INF, 8.0],
        },
        5,
    )
    stats = small_table(normalize.fit_stats(df), "feature")
    assert stats["current_balance_max_to_avg_bet_ratio"]["fill_value"] == 0.0
    assert stats["rtp_day"]["fill_value"] == 3.0


def test_feature_without_values_and_constant_feature(spark):
    df = feature_frame(spark, {"rtp_day": [None] * 4}, 4)
    stats = normalize.fit_stats(df)
    rows = small_table(stats, "feature")
    assert rows["rtp_day"]["fill_value"] == 0.0
    assert {r["std"] for r in rows.values()} == {1.0}
    z = normalize.transform(df, stats)
    assert z.schema == schema.Z_SCHEMA
    assert z.agg(*(F.max(F.abs(F.col(c))) for c in schema.Z_FEATURES)).first()[:] == (0.0,) * 10


def test_matches_numpy(spark):
    rng = np.random.default_rng(0)
    values = rng.lognormal(0, 2, 500)
    values[::50] = np.nan
    df = feature_frame(spark, {"rtp_day": [float(v) for v in values]}, 500)
    stats = normalize.fit_stats(df)
    row = small_table(stats, "feature")["rtp_day"]
    fill = np.nanmedian(values)
    x = np.where(np.isnan(values), fill, values)
    lo, hi = np.quantile(x, [0.01, 0.99])
    x = np.clip(x, lo, hi)
    want = {"fill_value": fill, "p01": lo, "p99": hi, "mean": x.mean(), "std": x.std()}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=1e-12)
    z = [r[0] for r in normalize.transform(df, stats).orderBy("bet_date").select("rtp_day_z").collect()]
    np.testing.assert_allclose(z, (x - x.mean()) / x.std(), rtol=1e-9, atol=1e-12)
    assert np.mean(z) == pytest.approx(0, abs=1e-9)
    assert np.std(z) == pytest.approx(1)
