import functools

import numpy as np
import pandas as pd
import pytest

from daytide.functions.pair_moments import STATE, batch_state, merged, pair_moments
from daytide.operators import eda

MOMENTS = ["n", "mean_a", "mean_b", "m2_a", "m2_b", "c"]
NAMES = ["a", "b", "c", "d", "e"]


def table(seed=1, rows=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 5)) @ rng.normal(size=(5, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    return x


def frame(spark, x, pieces=3):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES)).repartition(pieces)


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_pairwise_moments_in_any_partitioning(spark, pieces):
    x = table()
    got = {(r.pos_a, r.pos_b): r for r in pair_moments(frame(spark, x, pieces), NAMES).collect()}
    assert len(got) == 25
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        want = [both.sum(), a.mean(), b.mean(), a.var() * len(a), b.var() * len(b), np.cov(a, b, bias=True)[0, 1] * len(a)]
        assert [r[s] for s in MOMENTS] == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("offset", [0.0, 1e9, -1e12])
def test_correlations_survive_offsets(spark, offset):
    x = np.round(table(2) * 4096) / 4096  # exact beside the offsets
    got = {(r.feature_a, r.feature_b): r["corr"] for r in eda.correlation_long(frame(spark, x + offset, 7), NAMES).collect()}
    want = pd.DataFrame(x, columns=NAMES).corr()
    for p in NAMES:
        for q in NAMES:
            assert got[p, q] == pytest.approx(want.loc[p, q], abs=1e-9)


def test_constant_missing_and_pairwise_constant_columns(spark):
    x = table(3, 60)
    x[:, 1] = 0.1  # its mean is not exactly it
    x[:, 2] = np.nan
    x[:30, 3], x[30:, 3] = 7.3, np.arange(30)
    x[30:, 4] = np.nan  # so d is constant where e is known
    x[:30, 4] = np.arange(30)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in eda.correlation_long(frame(spark, x), NAMES).collect()}
    none = {k for k, v in got.items() if v is None}
    assert none == {(p, q) for p in NAMES for q in NAMES if {p, q} & {"b", "c"} or {p, q} == {"d", "e"}}
    assert got["e", "e"] == pytest.approx(1) and got["d", "d"] == pytest.approx(1)


def test_no_rows(spark):
    got = pair_moments(frame(spark, np.zeros((0, 5)), 2), NAMES).collect()
    assert len(got) == 25 and all(r.n == 0 and r.constant_a for r in got)


def test_states_merge_in_any_grouping():
    x = table(4)
    x[:50, 2] = np.nan  # the first part knows nothing of a column
    whole = batch_state(x)
    cut = [batch_state(p) for p in np.array_split(x, 9)]
    once = functools.reduce(merged, cut)
    again = merged(functools.reduce(merged, cut[:4]), functools.reduce(merged, cut[4:]))
    for state in (once, again):
        for side in "ab":
            mean = [s[f"anchor_{side}"] + s[f"rest_{side}"] for s in (state, whole)]
            assert np.allclose(*mean, rtol=1e-12, atol=1e-12)
        for name in set(STATE) - {"anchor_a", "anchor_b", "rest_a", "rest_b"}:
            assert np.allclose(state[name], whole[name], rtol=1e-10, atol=1e-10), name
