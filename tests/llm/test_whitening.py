"""Whitening against a dense eigendecomposition and exact integers."""

import math
import random

import duckdb
import numpy as np
import pytest

from daytide.llm import whitening
from daytide.llm.queries import queries

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, None, None) for r in rows], "vec_id long, embedding array<float>, n string, x string"
    )


def brute(rows):
    """vec_id -> whitened row; n, eigenvalues, trace, deviations, from plain numpy and Python."""
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(float(np.float32(c)) * 1024) + 100000 for c in v] for _, v in fit]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    a = np.array(x, float)
    a -= a.mean(axis=0)
    value, vector = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-value)[: whitening.COMPONENTS]
    return [i for i, _ in fit], n, a @ vector[:, order] / np.sqrt(value[order]), value[order], value.sum(), deviation


def compare(got, want, close=1e-7):
    ids, n, whitened, value, trace, deviation = want
    assert len(got) == len(ids) * len(value)
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(len(value)):
        mine = np.array([by[i, j + 1].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, j])
        assert np.abs(mine * sign - whitened[:, j]).max() < close
        assert all(abs(by[i, j + 1].explained / (value[j] / trace) - 1) < 1e-10 for i in ids)
    for i, d in zip(ids, deviation):
        assert by[i, 1].deviation == d and by[i, 1].n == n
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_registered_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    compare(queries()["op11_embedding_whitening"](spark, sf).collect(), brute(rows))


def test_random_vectors_nulls_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(12)]) for i in range(300)]
    rows += [(i + 1000, rows[i][1]) for i in range(40)]  # copies
    bad = [(2000, None), (2001, []), (2002, [None] + [0.0] * 11), (2003, [NAN] * 12), (2004, [math.inf] + [1.0] * 11)]
    odd = [(2005, [1.0, 2.0]), (2006, [1e30] * 12)]
    got = whitening.whiten(frame(spark, rows + bad + odd).repartition(5)).collect()
    compare(got, brute(rows))


def test_few_dimensions_and_equal_ids(spark):
    rows = [(None, [1.0, 5.0]), (7, [2.0, 3.0]), (7, [4.0, 4.5])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0] * 9), (2, [1.0] * 9)]])
def test_no_variance(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_rank_below_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9


def test_exact_deviations_beyond_a_long():
    x = np.array([[2**40, -(2**40)], [0, 1]])
    big = whitening.deviations(x, 1 << 20, x.sum(axis=0))
    assert big == [None, None]
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert whitening.deviations(np.array([[3, 5]]), 2, np.array([7, 11])) == [2]


class Dense:
    """Stands for staged vectors: products with a dense covariance."""

    def __init__(self, v):
        self.v, self.dims = v, len(v)

    def times(self, q):
        return self.v @ q

    def trace(self):
        return float(np.trace(self.v))


@pytest.mark.parametrize("spectrum", ["flat", "steep", "ties", "low rank", "clustered"])
def test_certified_on_hard_spectra(spectrum):
    rng = np.random.default_rng(3)
    dims = 150
    value = {
        "flat": np.linspace(1.2, 1.0, dims),
        "steep": 10.0 ** -np.arange(dims),
        "ties": np.repeat([5.0, 1.0], dims // 2),
        "low rank": np.concatenate([[9.0, 8, 7], np.zeros(dims - 3)]),
        "clustered": np.concatenate([np.full(4, 3.0) + 1e-6 * np.arange(4)[::-1], np.full(dims - 4, 2.99)]),
    }[spectrum]
    basis = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    v = basis * value @ basis.T
    found = whitening.leading(Dense(v))
    size = len(found.values)
    assert size == {"low rank": 3}.get(spectrum, 8) or spectrum == "steep"
    assert np.abs(found.values - value[:size]).max() < 1e-9 * value[0]
    off = v @ found.vectors - found.vectors * found.values
    assert np.linalg.norm(off, axis=0).max() < 1e-10 * value[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(size)).max() < 1e-12
