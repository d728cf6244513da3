"""Moments of all pairs of columns over the rows that have both, in one pass.

With X the values of a batch less the batch's column means (missing ones 0) and M the
marks of what is present, four matrix products give every pair its count, sums, squares and
products: M'M, X'M, (X^2)'M and X'X. A task merges its batches and sends a row for each
pair; these are merged by their means and central moments as well. A mean is kept as an
anchor and a small rest, so that offsets cost no digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.session import ship_package

#: State of a pair: rows with both, means (anchor, rest), central squares and product, ranges.
STATE = [
    "n",
    "anchor_a",
    "rest_a",
    "anchor_b",
    "rest_b",
    "m2_a",
    "m2_b",
    "c",
    "low_a",
    "high_a",
    "low_b",
    "high_b",
]
KIND = ", ".join(f"{s} double" for s in STATE)


def batch_state(x: np.ndarray) -> dict[str, np.ndarray]:
    """State (columns x columns each) of a matrix of rows, missing values NaN."""
    seen = ~np.isnan(x)
    m = seen.astype(float)
    anchor = np.where(seen, x, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    x0 = np.where(seen, x - anchor, 0)
    n = m.T @ m
    sums, squares, products = x0.T @ m, (x0 * x0).T @ m, x0.T @ x0
    rest = sums / np.maximum(n, 1)
    m2 = np.maximum(squares - sums * rest, 0)
    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
    for j in range(x.shape[1]):
        with_j = x[seen[:, j]]
        if len(with_j):
            low[:, j] = np.where(np.isnan(with_j), np.inf, with_j).min(axis=0)
            high[:, j] = np.where(np.isnan(with_j), -np.inf, with_j).max(axis=0)
    first = np.broadcast_to(anchor[:, None], n.shape)
    parts = [n, first, rest, first.T, rest.T, m2, m2.T, products - sums * rest.T, low, high, low.T, high.T]
    return dict(zip(STATE, parts))


def merged(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """State of the rows of both."""
    n = x["n"] + y["n"]
    share = y["n"] / np.maximum(n, 1)
    out = {"n": n}
    apart = {}
    for side in "ab":
        anchor = np.where(x["n"] > 0, x[f"anchor_{side}"], y[f"anchor_{side}"])
        mine = np.where(x["n"] > 0, x[f"rest_{side}"], y[f"rest_{side}"])
        apart[side] = np.where(y["n"] > 0, (y[f"anchor_{side}"] - anchor) + (y[f"rest_{side}"] - mine), 0)
        out[f"anchor_{side}"], out[f"rest_{side}"] = anchor, mine + apart[side] * share
        out[f"m2_{side}"] = x[f"m2_{side}"] + y[f"m2_{side}"] + apart[side] ** 2 * x["n"] * share
        out[f"low_{side}"] = np.minimum(x[f"low_{side}"], y[f"low_{side}"])
        out[f"high_{side}"] = np.maximum(x[f"high_{side}"], y[f"high_{side}"])
    out["c"] = x["c"] + y["c"] + apart["a"] * apart["b"] * x["n"] * share
    return out


def _of_task(batches):
    state = None
    for batch in batches:
        if batch.num_rows:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            own = batch_state(x)
            state = own if state is None else merged(state, own)
    if state is not None:
        size = len(state["n"])
        a, b = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))
        rows = [pa.array(a), pa.array(b), *(pa.array(state[s].reshape(-1)) for s in STATE)]
        yield pa.record_batch(rows, names=["pos_a", "pos_b", *STATE])


def _merge(x: Column, y: Column) -> Column:
    """The same as ``merged``, for two states of one pair with rows each."""
    n = x["n"] + y["n"]
    share = y["n"] / n
    apart = {s: (y[f"anchor_{s}"] - x[f"anchor_{s}"]) + (y[f"rest_{s}"] - x[f"rest_{s}"]) for s in "ab"}
    out = {"n": n, "c": x["c"] + y["c"] + apart["a"] * apart["b"] * x["n"] * share}
    for s in "ab":
        out[f"anchor_{s}"] = x[f"anchor_{s}"]
        out[f"rest_{s}"] = x[f"rest_{s}"] + apart[s] * share
        out[f"m2_{s}"] = x[f"m2_{s}"] + y[f"m2_{s}"] + apart[s] * apart[s] * x["n"] * share
        out[f"low_{s}"] = F.least(x[f"low_{s}"], y[f"low_{s}"])
        out[f"high_{s}"] = F.greatest(x[f"high_{s}"], y[f"high_{s}"])
    return F.struct(*(out[s].alias(s) for s in STATE))


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean_a, mean_b, m2_a, m2_b, c of every ordered pair of double columns.

    ``constant_a`` and ``constant_b`` tell whether a column has one value, or none, over the
    rows that have both. Columns x columns rows, with zeros where no row has both.
    """
    ship_package(df.sparkSession)
    states = df.select(*columns).mapInArrow(_of_task, f"pos_a int, pos_b int, {KIND}")
    return merged_pairs(states, len(columns))


def merged_pairs(states: DataFrame, size: int) -> DataFrame:
    """The pair moments from the states of all tasks, ``size`` x ``size`` pairs."""
    spark = states.sparkSession
    # an empty state for every pair, so that each has a row
    nothing = [(i, j, *[0.0] * len(STATE)) for i in range(size) for j in range(size)]
    states = states.unionByName(spark.createDataFrame(nothing, f"pos_a int, pos_b int, {KIND}"))
    # one state a task
    found = states.groupBy("pos_a", "pos_b").agg(F.collect_list(F.struct(*STATE)).alias("all"))
    empty = F.struct(*(F.lit(0.0).alias(s) for s in STATE))
    step = lambda x, y: F.when(y["n"] == 0, x).when(x["n"] == 0, y).otherwise(_merge(x, y))
    state = found.select("pos_a", "pos_b", F.aggregate("all", empty, step).alias("s"))
    return state.selectExpr(
        "pos_a",
        "pos_b",
        "s.n",
        "s.anchor_a + s.rest_a AS mean_a",
        "s.anchor_b + s.rest_b AS mean_b",
        "s.m2_a",
        "s.m2_b",
        "s.c",
        "s.low_a >= s.high_a AS constant_a",
        "s.low_b >= s.high_b AS constant_b",
    )
