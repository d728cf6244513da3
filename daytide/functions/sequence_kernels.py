"""Array kernels for one batch of observation sequences.

Sequences lie one after another in ``x`` (rows x features). They are visited longest
first, so at step t the still running ones are a prefix and every step is one matrix
operation over all of them, without padding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = np.finfo(float).tiny


@dataclass(frozen=True)
class HmmParams:
    """Initial and transition probabilities, means and diagonal variances per state."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covars: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)


def log_density(x: np.ndarray, p: HmmParams) -> np.ndarray:
    """Log density of every row under every state."""
    out = np.empty((len(x), p.states))
    for s in range(p.states):
        norm = np.log(2 * np.pi * p.covars[s]).sum()
        out[:, s] = -0.5 * (norm + ((x - p.means[s]) ** 2 / p.covars[s]).sum(axis=1))
    return out


def _schedule(lengths: np.ndarray):
    """First rows of the sequences, longest first, and how many run at each step."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(-lengths, kind="stable")
    ascending = lengths[order][::-1]
    running = len(lengths) - np.searchsorted(ascending, np.arange(lengths.max()), side="right")
    return first[order], running


def by_step(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features x rows in the order of steps, sequences running at each step).

    The rows of a step lie together, those of the longest sequences first, so what runs on
    follows the same sequences' rows of the step before, and every step is a slice.
    """
    first, running = _schedule(lengths)
    at = np.arange(len(x)) - np.repeat(np.cumsum(running) - running, running)
    rows = first[at] + np.repeat(np.arange(len(running)), running)
    return np.ascontiguousarray(x[rows].T), running


def expected_counts(x: np.ndarray, lengths: np.ndarray, p: HmmParams) -> np.ndarray:
    """Forward-backward sums as one vector.

    Layout: log-likelihood, start K, transitions K*K, weight K, sums K*D, squares K*D.
    """
    return step_counts(*by_step(x, lengths), p)


def step_counts(x: np.ndarray, running: np.ndarray, p: HmmParams) -> np.ndarray:
    """``expected_counts`` of rows as ``by_step`` gives them."""
    ends = np.cumsum(running).tolist()
    spans = list(zip([0, *ends], ends))
    b = np.empty((p.states, x.shape[1]))
    for s in range(p.states):
        away = x - p.means[s][:, None]
        away *= away
        b[s] = -0.5 * (np.log(2 * np.pi * p.covars[s]).sum() + (1 / p.covars[s]) @ away)
    top = b.max(axis=0)
    b -= top
    np.exp(b, out=b)

    alpha, scale = np.empty_like(b), np.empty(x.shape[1])
    before = 0
    for t, (at, end) in enumerate(spans):
        a = alpha[:, at:end]
        if t == 0:
            np.multiply(p.start[:, None], b[:, at:end], out=a)
        else:
            np.multiply(p.trans.T @ alpha[:, before : before + end - at], b[:, at:end], out=a)
        scale[at:end] = np.maximum(a.sum(axis=0), TINY)
        a /= scale[at:end]
        before = at

    beta, ahead = np.ones_like(b), np.zeros_like(b)
    for (at, _), (after, end) in zip(spans[-2::-1], spans[:0:-1]):
        own = slice(at, at + end - after)
        move = ahead[:, own]
        np.multiply(b[:, after:end], beta[:, after:end], out=move)
        move /= scale[after:end]
        beta[:, own] = p.trans @ move

    gamma = np.multiply(alpha, beta, out=beta)
    gamma /= np.maximum(gamma.sum(axis=0), TINY)
    return np.concatenate(
        [
            [np.log(scale).sum() + top.sum()],
            gamma[:, : ends[0]].sum(axis=1),
            (p.trans * (alpha @ ahead.T)).ravel(),
            gamma.sum(axis=1),
            (gamma @ x.T).ravel(),
            (gamma @ (x * x).T).ravel(),
        ]
    )


def most_likely_states(x: np.ndarray, lengths: np.ndarray, p: HmmParams) -> np.ndarray:
    """Viterbi path of every sequence; ties go to the lowest state."""
    first, running = _schedule(lengths)
    with np.errstate(divide="ignore"):
        log_start, log_trans = np.log(p.start), np.log(p.trans)
    log_b = log_density(x, p)
    best = np.empty_like(log_b)
    came = np.zeros(log_b.shape, dtype=np.int32)
    for t, m in enumerate(running):
        row = first[:m] + t
        if t == 0:
            best[row] = log_start + log_b[row]
        else:
            reach = best[row - 1][:, :, None] + log_trans
            came[row] = reach.argmax(axis=1)
            best[row] = reach.max(axis=1) + log_b[row]
    path = best.argmax(axis=1).astype(np.int32)
    for t in range(len(running) - 2, -1, -1):
        row = first[: running[t + 1]] + t
        path[row] = came[row + 1, path[row + 1]]
    return path
