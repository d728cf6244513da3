"""One-pass profiles against the aggregates and passes that they stand for."""

import numpy as np
import pytest

from daytide.functions.feature_profile import profile
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.shape import to_long
from daytide.operators import eda

NAMES = ["a", "b", "c", "d"]
KIND = ", ".join(f"{n} double" for n in NAMES)


def frame(spark, x, pieces):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return spark.createDataFrame(rows, KIND).repartition(pieces)


def values(offset=0.0):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.gamma(0.7, 3, 900), rng.normal(-5, 2, 900), rng.integers(0, 3, 900) * 1.0, np.full(900, 0.1)])
    x[rng.random(x.shape) < 0.2] = np.nan
    return x + offset


@pytest.mark.parametrize("pieces,offset", [(1, 0.0), (7, 0.0), (40, 0.0), (7, 1e9)])
def test_same_as_the_separate_passes(spark, pieces, offset):
    df = frame(spark, values(offset), pieces)
    shared = profile(df, NAMES)
    for make in (eda.feature_counts, eda.feature_quantiles):
        want = {r.feature: r.asDict() for r in make(df, NAMES).collect()}
        got = {r.feature: r.asDict() for r in make(df, NAMES, profile=shared).collect()}
        assert got.keys() == want.keys()
        for feature, row in want.items():
            for name, value in row.items():
                if name == "std" and feature == "d":  # one value
                    assert got[feature][name] == 0
                elif isinstance(value, float):
                    assert got[feature][name] == pytest.approx(value, rel=1e-6 if offset else 1e-9, abs=1e-12), (feature, name)
                else:
                    assert got[feature][name] == value
    want = {(r.pos_a, r.pos_b): r["corr"] for r in eda.correlation_long(df, NAMES).collect()}
    got = {(r.pos_a, r.pos_b): r["corr"] for r in eda.correlation_long(df, NAMES, profile=shared).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_missing_columns_and_empty_tables(spark):
    x = np.array([[1.0, np.nan, 0.0, -0.0], [np.nan, np.nan, 2.0, 0.0]])
    df = frame(spark, x, 2)
    rows = {r.feature: r for r in eda.feature_summary(df, NAMES).collect()}
    assert [rows["a"]["rows"], rows["a"].missing_count, rows["a"]["mean"], rows["a"].std, rows["a"].median] == [2, 1, 1.0, None, 1.0]
    assert [rows["b"].missing_rate, rows["b"]["mean"], rows["b"]["min"], rows["b"].p99] == [1.0, None, None, None]
    assert rows["d"].zero_count == 2 and rows["d"].p05 == 0
    none = df.where("false")
    assert eda.feature_summary(none, NAMES).collect() == []
    assert eda.correlation_long(none, NAMES, profile=profile(none, NAMES)).count() == 16


def test_crowded_digits_are_told_apart_by_later_passes(spark):
    # all values of a column begin with the same 16 bits
    rng = np.random.default_rng(5)
    x = np.column_stack([1.0 + rng.random(2000) / 1000] * 4)
    df = frame(spark, x, 5)
    long = to_long(df, [], NAMES)
    got = exact_quantiles(long, ["feature"], "x", {"q": 0.37}, rank_rows=20, begun=profile(df, NAMES).begun()).collect()
    assert {r.feature: r.q for r in got} == pytest.approx({n: np.quantile(x[:, 0], 0.37) for n in NAMES}, rel=1e-15)


def test_one_scan_of_the_input(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = frame(spark, values(), 4).mapInArrow(counting, KIND)
    shared = profile(df, NAMES)
    assert seen.value == 900
    eda.feature_counts(df, NAMES, shared).collect()
    eda.correlation_long(df, NAMES, shared).collect()
    assert seen.value == 900
    eda.feature_quantiles(df, NAMES, shared).collect()
    assert seen.value == 1800
