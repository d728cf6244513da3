from datetime import date, timedelta
from itertools import product

import numpy as np
import pytest

from daytide.functions.sequence_kernels import (
    HmmParams,
    expected_counts,
    log_density,
    most_likely_states,
)
from daytide.operators import hmm
from daytide.session import shared_dir

COLUMNS = ["a", "b"]
PARAMS = HmmParams(
    np.array([0.6, 0.4]),
    np.array([[0.9, 0.1], [0.2, 0.8]]),
    np.array([[2.0, 1.0], [-2.0, 0.0]]),
    np.array([[1.0, 0.5], [0.7, 1.5]]),
)


def paths(x, p):
    """All state paths of one sequence with their joint probability."""
    dens = np.exp(log_density(x, p))
    for path in product(range(p.states), repeat=len(x)):
        prob = p.start[path[0]] * dens[0, path[0]]
        for t in range(1, len(x)):
            prob *= p.trans[path[t - 1], path[t]] * dens[t, path[t]]
        yield path, prob


def draw(p, users, max_days, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(users):
        s, x = rng.choice(p.states, p=p.start), []
        for _ in range(rng.integers(1, max_days + 1)):
            x.append(rng.normal(p.means[s], np.sqrt(p.covars[s])))
            s = rng.choice(p.states, p=p.trans[s])
        out.append(np.array(x))
    return out


def z_frame(spark, sequences):
    rows = [
        (f"u{u}", date(2026, 1, 1) + timedelta(days=3 * t), *map(float, x))
        for u, seq in enumerate(sequences)
        for t, x in enumerate(seq)
    ]
    return spark.createDataFrame(rows, "user_id string, bet_date date, a double, b double")


def staged(spark, sequences, partitions=3):
    z = z_frame(spark, sequences).repartition(partitions)
    return hmm.user_sequences(z, COLUMNS)


def test_expected_counts_match_path_enumeration():
    sequences = draw(PARAMS, 6, 4, 1)
    got = expected_counts(
        np.vstack(sequences), np.array([len(s) for s in sequences]), PARAMS
    )
    loglik, start, moves, weight = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros(2)
    sums, squares = np.zeros((2, 2)), np.zeros((2, 2))
    for x in sequences:
        total = sum(prob for _, prob in paths(x, PARAMS))
        loglik += np.log(total)
        for path, prob in paths(x, PARAMS):
            w = prob / total
            start[path[0]] += w
            for t, s in enumerate(path):
                weight[s] += w
                sums[s] += w * x[t]
                squares[s] += w * x[t] ** 2
                if t:
                    moves[path[t - 1], s] += w
    want = np.concatenate(
        [[loglik], start, moves.ravel(), weight, sums.ravel(), squares.ravel()]
    )
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_viterbi_matches_path_enumeration():
    sequences = draw(PARAMS, 25, 5, 2)
    got = most_likely_states(
        np.vstack(sequences), np.array([len(s) for s in sequences]), PARAMS
    )
    want = np.concatenate([max(paths(x, PARAMS), key=lambda e: e[1])[0] for x in sequences])
    assert got.tolist() == want.tolist()


def test_ties_go_to_the_lowest_state():
    flat = HmmParams(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.zeros((3, 2)), np.ones((3, 2)))
    x = np.ones((4, 2))
    assert most_likely_states(x, np.array([3, 1]), flat).tolist() == [0, 0, 0, 0]


def test_far_outlier_does_not_break_the_sums():
    x = np.array([[1e4, -1e4], [0.0, 0.0]])
    got = expected_counts(x, np.array([2]), PARAMS)
    assert np.isfinite(got).all()


def test_sequences_are_in_date_order(spark):
    sequences = draw(PARAMS, 5, 6, 3)
    rows = {r["user_id"]: r for r in staged(spark, sequences).collect()}
    for u, x in enumerate(sequences):
        row = rows[f"u{u}"]
        assert row["days"] == len(x) and row["bet_dates"] == sorted(row["bet_dates"])
        np.testing.assert_allclose(np.reshape(row["x"], (-1, 2)), x)


def test_expectation_does_not_depend_on_partitions(spark):
    sequences = draw(PARAMS, 40, 6, 4)
    frame = staged(spark, sequences)
    one = hmm.expectation(frame.coalesce(1), PARAMS)
    many = hmm.expectation(frame.repartition(7), PARAMS)
    np.testing.assert_allclose(one, many, rtol=1e-10)
    assert (hmm.expectation(frame.coalesce(1), PARAMS) == one).all()


def test_fit_recovers_planted_states(spark):
    frame = staged(spark, draw(PARAMS, 400, 12, 5)).persist()
    result = hmm.fit(frame, 2, min_train_days=3, max_iter=12, width=2)
    gains = np.diff(result.log_likelihoods)
    assert (gains > -1e-3).all()
    p = result.params  # canonical order: largest first mean first
    np.testing.assert_allclose(p.means, PARAMS.means, atol=0.2)
    np.testing.assert_allclose(p.covars, PARAMS.covars, atol=0.25)
    np.testing.assert_allclose(p.trans, PARAMS.trans, atol=0.06)
    np.testing.assert_allclose(p.trans.sum(axis=1), 1)
    frame.unpersist()


def test_fit_stops_at_max_iter_without_claiming_convergence(spark):
    frame = staged(spark, draw(PARAMS, 30, 5, 6))
    result = hmm.fit(frame, 2, max_iter=1, width=2, init=PARAMS)
    assert result.iterations == 1 and not result.converged


def test_short_users_are_decoded_but_not_trained_on(spark):
    sequences = draw(PARAMS, 10, 6, 7) + [np.array([[9.0, 9.0]])]
    frame = staged(spark, sequences)
    lengths = np.array([len(s) for s in sequences])
    counts = hmm.expectation(frame.where("days >= 3"), PARAMS)
    assert counts[1:3].sum() == pytest.approx((lengths >= 3).sum())
    decoded = hmm.decode(frame, PARAMS)
    assert decoded.count() == lengths.sum()
    assert decoded.where("user_id = 'u10'").first()["hmm_state"] == 0


def test_decode_keeps_keys_and_matches_the_kernel(spark):
    sequences = draw(PARAMS, 20, 6, 8)
    got = {
        (r["user_id"], r["bet_date"]): r["hmm_state"]
        for r in hmm.decode(staged(spark, sequences), PARAMS).collect()
    }
    for u, x in enumerate(sequences):
        want = most_likely_states(x, np.array([len(x)]), PARAMS)
        for t, s in enumerate(want):
            assert got[f"u{u}", date(2026, 1, 1) + timedelta(days=3 * t)] == s


def test_saved_parameters_come_back_exactly(spark, tmp_path):
    wide = HmmParams(
        PARAMS.start, PARAMS.trans, np.tile(PARAMS.means, 5), np.tile(PARAMS.covars, 5)
    )
    hmm.save_params(spark, wide, str(tmp_path / "model"))
    back = hmm.load_params(spark, str(tmp_path / "model"))
    for name in ("start", "trans", "means", "covars"):
        assert (getattr(back, name) == getattr(wide, name)).all()


def test_maximization_uses_the_variance_prior():
    x = np.array([[1.0, 3.0], [1.0, 3.0]])
    one = HmmParams(np.ones(1), np.ones((1, 1)), np.zeros((1, 2)), np.ones((1, 2)))
    loglik, new = hmm.maximization(expected_counts(x, np.array([2]), one), one, 0.01)
    np.testing.assert_allclose(new.means, [[1.0, 3.0]])
    np.testing.assert_allclose(new.covars, [[0.005, 0.005]])
    assert loglik == pytest.approx(log_density(x, one).sum())


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_passes_read_packed_arrays(spark):
    """The rows of a step lie together, whatever the sequences' lengths, and sums are those of each sequence alone."""
    rng = np.random.default_rng(8)
    lengths = np.array([3, 1, 6, 6, 2, 9, 1])
    x = rng.normal(size=(lengths.sum(), 2))
    k = PARAMS.states
    params = HmmParams(PARAMS.start, PARAMS.trans, rng.normal(size=(k, 2)), rng.uniform(0.5, 2, (k, 2)))
    cuts = np.cumsum(lengths)[:-1]
    alone = sum(expected_counts(part, np.array([len(part)]), params) for part in np.split(x, cuts))
    rows = [(str(i), len(p), [], p.ravel().tolist()) for i, p in enumerate(np.split(x, cuts))]
    frame = spark.createDataFrame(rows, "user_id string, days int, bet_dates array<date>, x array<double>")
    table = hmm.packed(frame.repartition(2), 2)
    assert table.columns == ["running", "x"]
    got = table.collect()
    assert 1 <= len(got) <= 2  # a row for many sequences
    assert sum(np.frombuffer(r["running"], np.int64).sum() for r in got) == lengths.sum()
    assert np.allclose(hmm.expectation(frame.repartition(2), params), alone, rtol=1e-12)
    assert (hmm.expectation(frame.limit(0), params) == 0).all()
