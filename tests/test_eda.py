from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from daytide import schema
from daytide.operators import chartdata, eda
from tests.test_normalize import feature_frame

M = schema.MODEL_FEATURES


def test_summary_matches_pandas(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.choice([0.0, 1.0, 2.5, 70.0, np.nan, np.inf], 300)]
    df = feature_frame(spark, {"rtp_day": values}, 300)
    row = {r["feature"]: r for r in eda.feature_summary(df).collect()}
    s = pd.Series(values).replace([np.inf, -np.inf], np.nan)
    got = row["rtp_day"]
    assert got["rows"] == 300
    assert got["missing_count"] == s.isna().sum()
    assert got["zero_rate"] == pytest.approx((s == 0).mean())
    assert got["std"] == pytest.approx(s.std())
    assert got["skew"] == pytest.approx(s.skew())
    assert got["p95"] == pytest.approx(s.quantile(0.95))
    assert row["bet_days_7d"]["skew"] == 0.0  # constant
    assert row["bet_days_7d"]["std"] == 0.0


def test_summary_of_empty_and_tiny_columns(spark):
    df = feature_frame(spark, {"rtp_day": [None, None], "bet_days_7d": [1.0, 2.0]}, 2)
    row = {r["feature"]: r for r in eda.feature_summary(df).collect()}
    assert row["rtp_day"]["missing_rate"] == 1.0
    assert row["rtp_day"]["median"] is None and row["rtp_day"]["mean"] is None
    assert row["bet_days_7d"]["skew"] is None


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 200))
    b = b + a
    a[::7] = np.nan
    c[::5] = np.inf
    columns = {"rtp_day": a, "bet_days_7d": b, "bet_interval_day": c}
    df = feature_frame(spark, {k: [float(x) for x in v] for k, v in columns.items()}, 200)
    corr = eda.correlation_long(df)
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in corr.collect()}
    assert len(got) == 100
    want = pd.DataFrame(columns).replace([np.inf], np.nan).corr()
    for p in columns:
        for q in columns:
            assert got[p, q] == pytest.approx(want.loc[p, q], abs=1e-12)
    assert got["rtp_day", "no_bet_streak_days"] is None  # constant partner
    top = eda.top_correlations(corr, 2).collect()
    assert (top[0]["feature_a"], top[0]["feature_b"]) == ("bet_days_7d", "rtp_day")
    assert abs(top[0]["corr"]) >= abs(top[1]["corr"])


def test_daily_summary_invariants(spark):
    rows = []
    for d in range(3):
        for u in range(4):
            rows.append((f"u{u}", date(2026, 1, 1) + timedelta(days=d), 1, 0, 2.0 * (d != 1), 1.0, -1.0))
    df = spark.createDataFrame(
        rows,
        "user_id string, bet_date date, bet_days_7d long, no_bet_streak_days int, "
        "bet_amount_today double, payout_today double, profit_today double",
    )
    out = eda.daily_summary(df).orderBy("bet_date").collect()
    assert [r["user_days"] for r in out] == [r["users"] for r in out] == [4, 4, 4]
    assert [r["rtp"] for r in out] == [0.5, None, 0.5]


def test_histogram_edges(spark):
    df = feature_frame(spark, {"rtp_day": [float(i) for i in range(200)]}, 200)
    bins = [r for r in chartdata.histogram(df).collect()]
    rtp = {r["bin"]: r["n"] for r in bins if r["feature"] == "rtp_day"}
    assert sum(rtp.values()) == 200 and min(rtp) == 1 and max(rtp) == 60
    assert rtp[1] > rtp[30]  # the clipped tail lands in the edge bin
    constant = [r for r in bins if r["feature"] == "bet_days_7d"]
    assert [(r["bin"], r["n"]) for r in constant] == [(1, 200)]


def test_log_histogram_skips_negative_values(spark):
    df = feature_frame(spark, {"rtp_day": [-5.0, 0.0, 1.0, 2.0]}, 4)
    rows = [r for r in chartdata.histogram(df, log=True).collect() if r["feature"] == "rtp_day"]
    assert sum(r["n"] for r in rows) == 3
    assert rows[0]["median"] == pytest.approx(np.log1p(1.0))


def test_scatter_drops_missing_after_sampling(spark):
    values = [None if i % 2 else float(i) for i in range(40)]
    df = feature_frame(spark, {"rtp_day": values}, 40)
    points = chartdata.rtp_scatter(df, n=20)
    assert points.count() < 20


def test_state_bars_name_unknown_states(spark):
    df = spark.createDataFrame([(0, 10.0, 1.0), (9, 90.0, 2.0)], "hmm_state int, row_share_pct double, churn7_rate_pct double")
    assert [r[0] for r in chartdata.state_bars(df).collect()] == ["S0 Stable Active", "S9 State"]
