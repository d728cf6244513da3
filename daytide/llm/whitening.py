"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become fixed-point integers, so counts, sums and deviations are exact. The leading
eigenvectors of the covariance come from passes over the vectors: a pass gives V Q for a
block Q of a few columns, V being the covariance and never formed. A Chebyshev recurrence
over such passes damps the spectrum below the block's smallest Ritz value, QR makes the
columns orthonormal again, and Rayleigh-Ritz gives values, vectors and their residuals,
which certify them. A spectrum too flat for the block doubles the block; with as many
columns as dimensions Rayleigh-Ritz is exact, so the iteration always ends.

Vectors are staged in blocks of bytes. A pass sends one row for each dimension and task,
summed by Spark; only dimensions x columns numbers reach the driver.

Defined cases: vectors that are null, empty, hold null or non-finite entries, or entries of
2**52 and above (no long after scaling) are dropped; so are vectors of another length than
the commonest (of equally common lengths, the longer). Equal rows and equal or null ids
give rows each. A component without variance cannot be whitened and is left out, so equal
vectors alone, or a single one, give no row; an empty table gives none. A deviation beyond
a long is null. Columns other than id and vector are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.session import ship_package, stage

# Fixed values of the fixed-point form.
SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Columns of the block for each wanted component, and passes of one filter.
OVERSAMPLE = 4
DEGREE = 12
#: Largest residual of a certified component, relative to the largest eigenvalue.
TOLERANCE = 2e-13
#: Rounds after which a block that is not certified is doubled.
ROUNDS = 8
#: Vectors in a staged block.
BLOCK = 2048


def fixed_point(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>) of the vectors that are fit to be used, of all lengths."""
    ship_package(vectors.sparkSession)
    given = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    usable = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 2.0**52), F.lit(False)))
    return given.where(usable & (F.size("v") > 0)).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x")
    )


def _blocked(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            ids = part["vec_id"].to_pylist()
            known = np.array([i is not None for i in ids])
            number = np.array([i or 0 for i in ids], "<i8")
            x = part["x"].flatten().to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.record_batch(
                [pa.array([v.tobytes()], pa.binary()) for v in (known, number, x)], names=["known", "ids", "x"]
            )


def _matrix(value, dims: int) -> np.ndarray:
    return np.frombuffer(value, "<i8").reshape(-1, dims)


@dataclass
class Vectors:
    """Staged blocks of vectors of one length, and their exact count and sums."""

    blocks: DataFrame
    dims: int
    n: int
    sums: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])

    def added(self, kernel, width: int) -> np.ndarray:
        """Sum over the table of the arrays (rows x width) that kernel makes of each block."""

        dims = self.dims

        def rows(batches):
            total = None
            for batch in batches:
                for value in batch["x"]:
                    one = kernel(_matrix(value.as_buffer(), dims))
                    total = one if total is None else total + one
            if total is not None:
                columns = [pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, total.T.copy())]
                yield pa.record_batch(columns, names=names)

        names = ["i", *(f"c{j}" for j in range(width))]
        kind = "i int, " + ", ".join(f"c{j} double" for j in range(width))
        found = self.blocks.select("x").mapInArrow(rows, kind)
        found = found.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width)))
        return np.array([r[1:] for r in sorted(found.collect())])

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V (divisor n), entries centred before they are multiplied."""
        mean = self.mean

        def kernel(x):
            centred = x - mean
            return centred.T @ (centred @ q)

        return self.added(kernel, q.shape[1]) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self.added(lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], 1).sum()) / self.n


def collected(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> Vectors | None:
    """The vectors of the commonest length, staged; None if there are none."""
    fixed = fixed_point(vectors, vec_id, vector)
    sizes = fixed.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    dims = most["size"]
    packed = fixed.where(F.size("x") == dims).mapInArrow(_blocked, "known binary, ids binary, x binary")
    blocks = stage(packed, "vectors")

    def sums(batches):
        for batch in batches:
            for value in batch["x"]:
                x = _matrix(value.as_buffer(), dims)
                place = pa.array(np.arange(dims, dtype=np.int32))
                yield pa.record_batch([place, pa.array(x.sum(axis=0))], names=["i", "s"])

    by_place = blocks.select("x").mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s"))
    total = {r["i"]: r["s"] for r in by_place.collect()}
    return Vectors(blocks, dims, most["n"], np.array([total[i] for i in range(dims)], np.int64))


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray  # dims x components
    trace: float
    passes: int


def damped(times, q, w, low: float, high: float, top: float, degree: int):
    """The Chebyshev polynomial of V that is small on [low, high], applied to q; w is V q.

    The recurrence is scaled by its value at ``top``, so nothing overflows.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = half / (top - centre)
    twice = 2 / sigma
    before, now = q, (w - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (twice - sigma)
        now, before = 2 * after / half * (times(now) - centre * now) - sigma * after * before, now
        sigma = after
    return now


def leading(
    data: Vectors,
    components: int = COMPONENTS,
    oversample: int = OVERSAMPLE,
    degree: int = DEGREE,
    tolerance: float = TOLERANCE,
    seed: int = 11,
) -> Components:
    """Certified leading eigenvectors of the covariance, by falling eigenvalue."""
    dims, count = data.dims, 0
    trace = data.trace()
    wanted = min(components, dims)
    if not trace > 0:
        return Components(np.zeros(0), np.zeros((dims, 0)), trace, 1)

    def times(q):
        nonlocal count
        count += 1
        return data.times(q)

    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dims, min(dims, oversample * wanted))))[0]
    turn, least = 0, np.inf
    while True:
        w = times(q)
        inner = q.T @ w
        value, turned = np.linalg.eigh((inner + inner.T) / 2)
        value, turned = value[::-1], turned[:, ::-1]
        q, w = q @ turned, w @ turned
        residual = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0).max() / value[0]
        # near the rounding of the sums the residual no longer falls
        settled = residual < 100 * tolerance and residual > least / 2
        if residual <= tolerance or settled or q.shape[1] == dims:
            break
        least, turn = min(least, residual), turn + 1
        q = np.linalg.qr(damped(times, q, w, 0.0, max(value[-1], 1e-9 * value[0]), value[0], degree))[0]
        if turn == ROUNDS:
            wider = min(dims, 2 * q.shape[1]) - q.shape[1]
            q = np.linalg.qr(np.hstack([q, rng.normal(size=(dims, wider))]))[0]
            turn, least = 0, np.inf
    real = value[:wanted] > dims * 1e-14 * value[0]
    return Components(value[:wanted][real], q[:, :wanted][:, real], trace, count + 1)


def identity_error(data: Vectors, found: Components) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity."""
    mean, turn = data.mean, found.vectors / np.sqrt(found.values)
    size = len(found.values)

    def kernel(x):
        z = (x - mean) @ turn
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = data.added(kernel, size) / data.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(size)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2 for each row, exact."""
    dims = x.shape[1]
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(abs(int(s)) for s in sums)
    if most < 2**62:
        off = n * x - sums
        if dims * int(np.abs(off).max(initial=0)) ** 2 < 2**63:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums.tolist())) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    kind = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    data = collected(vectors, vec_id, vector)
    found = leading(data, components) if data else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], kind)
    n, dims, sums, mean = data.n, data.dims, data.sums, data.mean
    turn, size = found.vectors / np.sqrt(found.values), len(found.values)
    explained, error = found.values / found.trace, identity_error(data, found)
    names = [part.split()[0] for part in kind.split(", ")]

    def kernel(batches):
        for batch in batches:
            for known, ids, value in zip(batch["known"], batch["ids"], batch["x"]):
                x = _matrix(value.as_buffer(), dims)
                rows = len(x)
                known = np.frombuffer(known.as_buffer(), bool)
                number = np.frombuffer(ids.as_buffer(), "<i8")
                off = pa.array(deviations(x, n, sums), pa.int64())
                each = pa.array(np.repeat(np.arange(rows), size))
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(number, size), mask=np.repeat(~known, size)),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * size, n)),
                        off.take(each),
                        pa.array(((x - mean) @ turn).reshape(-1)),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * size, error)),
                    ],
                    names=names,
                )

    return data.blocks.mapInArrow(kernel, kind)
