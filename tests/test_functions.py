import numpy as np
import pytest
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions import columns as C
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.sampling import seeded_sample
from daytide.functions.shape import small_table

PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def check_quantiles(spark, groups, **kw):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", PROBS, **kw).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_of_small_groups(spark):
    check_quantiles(spark, {"one": [3.0], "two": [1.0, 2.0], "many": list(range(10))})


def test_quantiles_through_brackets(spark):
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.lognormal(0, 3, 20_000),
        "constant": np.full(9_000, 2.5),
        # a third of the rows on one value, the rest on few values
        "tied": np.concatenate([np.zeros(7_000), rng.integers(0, 5, 14_000)]),
        "signed": rng.normal(size=9_000) * 1e6,
    }
    check_quantiles(spark, groups, accuracy=400, rank_rows=50)
    check_quantiles(spark, groups)


def test_quantiles_between_two_heavy_values(spark):
    """The rank lies in a thin crowd of values between two that hold nearly all rows."""
    rng = np.random.default_rng(2)
    thin = np.sort(rng.random(300))
    values = np.concatenate([np.zeros(5_000), thin, np.ones(5_000)])
    check_quantiles(spark, {"thin": values, "half": np.array([0.0] * 3_000 + [1.0] * 3_000)}, rank_rows=20)


def test_too_many_groups_are_refused(spark):
    df = spark.range(20).select(F.col("id").alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "v", {"m": 0.5}, max_groups=10)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "g string, v double")
    rows = exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()
    assert [(r["g"], r["n"], r["m"]) for r in rows] == [("a", 2, 2.0)]


def test_sample_is_exact_and_ignores_partitioning(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    a = {r.k for r in seeded_sample(df.repartition(7), ["k"], 300, 42).collect()}
    b = {r.k for r in seeded_sample(df.coalesce(1), ["k"], 300, 42).collect()}
    c = {r.k for r in seeded_sample(df, ["k"], 300, 43).collect()}
    assert len(a) == 300 and a == b and a != c
    assert seeded_sample(df, ["k"], 9000, 42).count() == 5000


def test_non_numbers_become_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "s string")
    got = [r[0] for r in df.select(C.numeric("s")).collect()]
    assert got == [1.5, None, None, None, None]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(C.clip(F.col("x"), F.lit(0.0), F.lit(5.0))).collect()]
    assert got == [None, 0.0, 5.0]


def test_display_text(spark):
    df = spark.createDataFrame([(1234567.00005, 0.12346), (None, None)], "x double, p double")
    got = df.select(C.fixed4(F.col("x")), C.plain4(F.col("x")), C.percent2(F.col("p"))).collect()
    assert tuple(got[0]) == (f"{1234567.00005:,.4f}", f"{1234567.00005:.4f}", "12.35%")
    assert tuple(got[1]) == ("", "", "")


def test_text_rounds_the_binary_value_as_python_does(spark):
    values = [0.00125, 0.00375, 0.03125, 0.125, 1.005, -0.00375, 2.5, 1e15, 12345.67885]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    got = df.select(x, C.fixed4(x), C.plain4(x), C.percent2(x), C.rounded(x, 2)).collect()
    for v, fixed, plain, share, two in got:
        assert (fixed, plain, share) == (f"{v:,.4f}", f"{v:.4f}", f"{v * 100:.2f}%")
        assert two == float(f"{v:.2f}")


def test_small_table_refuses_large_input(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert len(small_table(df, "k")) == 20
    with pytest.raises(ValueError):
        small_table(df, "k", max_rows=10)


def test_declared_schema_is_enforced(spark):
    with pytest.raises(ValueError):
        schema.require_columns(spark.range(1), schema.BASE_SCHEMA)
    wrong = spark.range(1).select(F.lit(1).alias("user_id"))
    with pytest.raises(TypeError):
        schema.require_columns(wrong, schema.BASE_SCHEMA)
