import hashlib
from datetime import date, timedelta

import numpy as np
import pytest

from daytide.operators import hmm, start
from tests.test_hmm import PARAMS, draw, staged, z_frame


def by_user(sequences):
    """(user, date, row) of every row, as plain values."""
    return [
        (f"u{u}", date(2026, 1, 1) + timedelta(days=3 * t), row)
        for u, x in enumerate(sequences)
        for t, row in enumerate(x)
    ]


def plain_uniform(user, day, seed, stream):
    m = 2**64 - 1
    h = int(hashlib.md5(f"{user}|{day}|{seed}".encode()).hexdigest()[:15], 16)
    z = (h + start.GOLDEN * (stream + 1)) & m
    z = ((z ^ (z >> 30)) * start.MIX1) & m
    z = ((z ^ (z >> 27)) * start.MIX2) & m
    z ^= z >> 31
    return ((z >> 12) + 0.5) / 2**52


def plain_seeds(rows, k, seed, try_):
    chosen = []
    for r in range(k):
        keys = []
        for user, day, x in rows:
            far = min((((x - c[2]) ** 2).sum() for c in chosen), default=1.0)
            if far > 0:
                keys.append((-np.log(plain_uniform(user, day, seed, try_ * 1000 + r)) / far, user, day))
        if keys:
            _, user, day = min(keys)
            chosen.append(next(row for row in rows if row[:2] == (user, day)))
    return chosen


def test_seeds_match_a_plain_loop(spark):
    sequences = draw(PARAMS, 30, 6, 11)
    got = start.seed_rows(staged(spark, sequences), 3, 2, 5, 4)
    for t in range(4):
        want = plain_seeds(by_user(sequences), 3, 5, t)
        assert [(s[1], s[2]) for s in got[t]] == [w[:2] for w in want]


def test_moments_are_exact(spark):
    x = [np.array([[1e9 + 1, 0.25], [1e9 + 2, 0.5], [1e9 + 4, -0.75]])]
    n, _, variance = start.moments(staged(spark, x), 2)
    assert n == 3
    np.testing.assert_allclose(variance, np.var(x[0], axis=0, ddof=1), rtol=1e-4)


def test_start_and_fit_do_not_depend_on_partitions(spark):
    sequences = draw(PARAMS, 150, 9, 12)
    fits, starts = [], []
    for parts in (1, 4, 13):
        frame = staged(spark, sequences).repartition(parts).persist()
        starts.append(start.kmeans_centers(frame, 3, 2, seed=3))
        fits.append(hmm.fit(frame, 3, max_iter=6, tol=0.0, width=2).params)
        frame.unpersist()
    for centers, variance in starts[1:]:
        assert (centers == starts[0][0]).all() and (variance == starts[0][1]).all()
    for p in fits[1:]:
        for name in ("start", "trans", "means", "covars"):
            np.testing.assert_allclose(getattr(p, name), getattr(fits[0], name), rtol=1e-9, atol=1e-12)


def test_centers_are_means_of_their_rows(spark):
    rng = np.random.default_rng(4)
    groups = [(0, 0), (10, 0), (0, 10), (10, 10)]
    sequences = [rng.normal(g, 0.1, size=(5, 2)) for g in groups for _ in range(6)]
    centers, _ = start.kmeans_centers(staged(spark, sequences), 4, 2)
    want = [np.vstack(sequences[6 * g : 6 * g + 6]).mean(axis=0) for g in range(4)]
    want = sorted((w.tolist() for w in want), reverse=True)
    np.testing.assert_allclose(centers, want, atol=1e-8)


def test_fewer_distinct_rows_than_states(spark):
    frame = staged(spark, [np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]])])
    centers, _ = start.kmeans_centers(frame, 4, 2)
    assert centers.tolist() == [[3.0, 4.0], [1.0, 2.0]]
    assert hmm.initial_params(frame, 4, 2).means.shape == (4, 2)


def test_unknown_user_and_zero_rows(spark):
    z = z_frame(spark, [np.zeros((3, 2))]).selectExpr("string(null) AS user_id", "bet_date", "a", "b")
    centers, variance = start.kmeans_centers(hmm.user_sequences(z, ["a", "b"]), 2, 2)
    assert centers.tolist() == [[0.0, 0.0]] and variance.tolist() == [0.0, 0.0]


def test_no_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows"):
        start.kmeans_centers(staged(spark, [np.ones((2, 2))]).where("days > 5"), 2, 2)


def test_one_task_returns_a_fixed_number_of_rows(spark):
    frame = staged(spark, draw(PARAMS, 60, 6, 13)).repartition(5)
    drawn = start.draw_seeds(frame.withColumn("h", start.row_hashes(1)), 0, [np.empty((0, 2))] * 6)
    assert sorted(drawn) == list(range(6))
