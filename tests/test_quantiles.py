import numpy as np
import pytest
from pyspark.sql import functions as F

from daytide.functions import quantiles
from daytide.functions.quantiles import _counted, _Rank, _Slots, exact_quantiles, ordered_bits


def test_bits_keep_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, 5e-324, -5e-324, np.inf, -np.inf]])
    assert (np.argsort(ordered_bits(x), kind="stable") == np.argsort(x, kind="stable")).all()
    assert ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))


@pytest.mark.parametrize("digits", [2, 300, 65_536])
def test_values_that_differ_in_their_last_bits(spark, digits):
    """The deepest digits decide; huge and tiny values, both signs, equal values in crowds."""
    near = 1.0 + np.arange(400) * np.finfo(float).eps
    values = {"near": near, "wide": np.array([-1e300, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1e300] * 9), "tie": np.full(700, -3.5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    probs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}
    got = {r.g: r for r in exact_quantiles(df.repartition(5), ["g"], "v", probs, accuracy=digits, rank_rows=3).collect()}
    for g, vs in values.items():
        assert got[g].n == len(vs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-15)


def test_a_pass_counts_only_what_begins_with_a_held_prefix():
    import pyarrow as pa

    bits = ordered_bits(np.array([1.5]))[0]
    ranks = [_Rank(("g",), 1, "m", 0.0, False, 0, prefix=int(bits >> np.uint64(48)))]
    slots, slot = _Slots.of(ranks, 16)
    batch = pa.record_batch(
        [pa.array([1, 1, 0, 1, 1], pa.int32()), pa.array([1.5, 1.5000001, 1.5, 9.0, -1.5])], names=["_g", "_x"]
    )
    (out,) = _counted(slots, 16)(iter([batch]))
    assert slot == [0] and sum(out["_c"].to_pylist()) == 2


def test_every_pass_combines_before_the_exchange(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = exact_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "percentile" not in plan


def test_columns_are_groups_without_a_row_a_value(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = {
        "a": rng.normal(size=400).tolist(),
        "b": [None] * 400,
        "c": [None, 0.0, -0.0, 3.0] * 100,
        "d": (10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400)).tolist(),
        "e": [7.0 + i * 2.0**-50 for i in range(400)],
    }
    frame = spark.createDataFrame(list(zip(*values.values())), ", ".join(f"{c} double" for c in values)).repartition(3)
    probs = {"low": 0.01, "mid": 0.5, "high": 0.993}
    seen = []
    real = quantiles._counted_columns
    monkeypatch.setattr(quantiles, "_counted_columns", lambda *a: seen.append(a) or real(*a))
    got = quantiles.exact_quantiles(frame, ["feature"], "x", probs, rank_rows=3, columns=list(values)).collect()
    assert len(seen) >= 3
    assert sorted(r["feature"] for r in got) == ["a", "c", "d", "e"]
    for r in got:
        known = np.array([v for v in values[r["feature"]] if v is not None])
        assert r["n"] == len(known)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(known, p), rel=1e-12)
