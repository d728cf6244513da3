"""k-means start of the EM fit that does not depend on how rows lie in partitions.

Several tries run side by side in the same passes. Seeds are drawn by squared distance
(k-means++) as an exponential race: every row gets -ln(u) / distance, u being a hash of its
user, date, try and round, and the smallest one wins, so one minimum a pass replaces the
running sums of the usual draw. The steps that follow add whole numbers of a fine unit,
which come out the same in any order. A task returns a fixed number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.session import ship_package

#: Rows whose distances to all centres of all tries are in memory at once.
SLICE = 1 << 16
#: Rows of a slice whose distances are worked out together.
BLOCK = 1 << 12
#: The largest absolute value is this many units.
UNITS = 2**43
#: Constants of the splitmix64 generator.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


SEED = pa.schema(
    [
        ("try", pa.int32()),
        ("key", pa.float64()),
        ("user", pa.string()),
        ("bet_date", pa.date32()),
        ("user_id", pa.string()),
        ("v", pa.list_(pa.float64())),
    ]
)


def row_hashes(seed: int) -> Column:
    """A sequence's hashes by date: the first 15 hex digits of md5(user|date|seed)."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit(""))

    def one(day: Column) -> Column:
        text = F.concat_ws("|", user, day.cast("string"), F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

    return F.transform("bet_dates", one)


def uniform(hashes: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1), one a hash, independent between streams."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64(GOLDEN * (stream + 1) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(rows, centres); by differences, so equal rows are at distance 0."""
    return _distances(np.ascontiguousarray(x.T), centers).T


def _distances(columns: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(centres, rows) for rows given by columns, some thousand at a time, which the cache holds."""
    out = np.empty((len(centers), columns.shape[1]))
    for at in range(0, columns.shape[1], BLOCK):
        part = columns[:, at : at + BLOCK]
        for c, own in zip(centers, out[:, at : at + BLOCK]):
            own[:] = 0
            for value, of_center in zip(part, c):
                away = value - of_center
                away *= away
                own += away
    return out


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _slices(batches, width: int):
    """(first row, x) of a bounded number of rows, with the batch they are from."""
    for batch in batches:
        if batch.num_rows:
            x = _flat(batch.column("x")).reshape(-1, width)
            for at in range(0, len(x), SLICE):
                yield batch, at, x[at : at + SLICE]


def draw_seeds(sequences: DataFrame, round_: int, seeds: list[np.ndarray]) -> dict[int, tuple]:
    """The next seed of every try: try -> (race key, user_id, bet_date, row).

    ``sequences`` has ``h`` of ``row_hashes``; ``seeds`` holds the rows drawn so far by each
    try. A try whose seeds are all distinct rows there are gets none.
    """
    ship_package(sequences.sparkSession)
    tries, width = len(seeds), seeds[0].shape[1]

    def race(batches):
        best: dict[int, tuple] = {}
        for batch, at, x in _slices(batches, width):
            hashes = _flat(batch.column("h"))[at : at + len(x)]
            lengths = batch.column("days").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lengths)[at : at + len(x)]
            for t in range(tries):
                key = -np.log(uniform(hashes, t * 1000 + round_))
                if round_:
                    far = squared_distances(x, seeds[t]).min(axis=1)
                    with np.errstate(divide="ignore"):
                        key = np.where(far > 0, key / far, np.inf)
                low = key.min()
                if not np.isfinite(low) or (t in best and low > best[t][0]):
                    continue
                for i in np.flatnonzero(key == low):
                    user = batch.column("user_id")[int(owner[i])].as_py()
                    day = batch.column("bet_dates").flatten()[at + int(i)].as_py()
                    found = (float(low), user or "", day, user, x[i].tolist())
                    if t not in best or found[:3] < best[t][:3]:
                        best[t] = found
        if best:
            names = ["try", "key", "user", "bet_date", "user_id", "v"]
            rows = [dict(zip(names, (t, *found))) for t, found in sorted(best.items())]
            yield pa.RecordBatch.from_pylist(rows, SEED)

    won = F.min(F.struct("key", "user", "bet_date", "user_id", "v")).alias("w")
    rows = (
        sequences.select("user_id", "days", "bet_dates", "h", "x")
        .mapInArrow(race, "try int, key double, user string, bet_date date, user_id string, v array<double>")
        .groupBy("try")
        .agg(won)
        .select("try", "w.*")
        .collect()  # a row a try
    )
    return {r["try"]: (r["key"], r["user_id"], r["bet_date"], np.array(r["v"])) for r in rows}


def _whole_sums(sequences: DataFrame, size: int, kernel) -> list[int]:
    """Sums over all rows of ``size`` whole numbers that ``kernel(x)`` gives for a slice."""
    ship_package(sequences.sparkSession)

    def partial(batches):
        total = [0] * size
        for x in kernel.slices(batches):
            total = [a + int(b) for a, b in zip(total, kernel(x))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array([str(v) for v in total])],
            names=["idx", "v"],
        )

    sums = (
        sequences.select("days", "x")
        .mapInArrow(partial, "idx int, v string")
        .groupBy("idx")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    )
    out = [0] * size
    for row in sums.collect():  # `size` numbers, whatever the data
        out[row["idx"]] = int(row["v"])
    return out


@dataclass
class _Moments:
    """Rows, sums and squares by column, in units; squares in three parts that fit a long."""

    width: int
    unit: float

    def slices(self, batches):
        return (x for _, _, x in _slices(batches, self.width))

    def __call__(self, x: np.ndarray) -> list:
        q = np.rint(x / self.unit).astype(np.int64)
        high, low = q >> 22, q & (2**22 - 1)
        squares = [(high * high), (high * low), (low * low)]
        parts = [p.sum(axis=0) for p in squares]
        whole = [(int(a) << 44) + (int(b) << 23) + int(c) for a, b, c in zip(*parts)]
        return [len(x), *q.sum(axis=0), *whole]


@dataclass
class _Step:
    """For every try and centre: rows nearest to it and their sums; last the tries' inertia."""

    centers: list[np.ndarray]
    unit: float

    def slices(self, batches):
        return (x for _, _, x in _slices(batches, self.centers[0].shape[1]))

    def __call__(self, x: np.ndarray) -> list:
        q = np.rint(x / self.unit).astype(np.int64)
        # two parts of 22 bits, whose sums over a slice are exact in doubles
        parts = np.concatenate([(q >> 22), q & (2**22 - 1)], axis=1).astype(float)
        columns, width = np.ascontiguousarray(x.T), x.shape[1]
        out, inertia = [], []
        grain = (self.unit * UNITS) ** 2 / 2**24
        for centers in self.centers:
            far = _distances(columns, centers)
            low, near = far[0].copy(), np.zeros(len(x), np.int64)
            for s in range(1, len(centers)):
                less = far[s] < low
                near[less] = s
                np.minimum(low, far[s], out=low)
            mine = (near == np.arange(len(centers))[:, None]).astype(float)
            for n, sums in zip(mine.sum(axis=1), mine @ parts):
                out += [int(n), *((int(a) << 22) + int(b) for a, b in zip(sums[:width], sums[width:]))]
            inertia.append(np.rint(low / grain).astype(np.int64).sum())
        return out + inertia


def moments(sequences: DataFrame, width: int) -> tuple[int, float, np.ndarray]:
    """(rows, unit, sample variance by column)."""
    reach = F.greatest(F.array_max("x"), -F.array_min("x"))
    largest = sequences.agg(F.max(reach)).first()[0] or 0.0
    unit = 2.0 ** (np.ceil(np.log2(largest)) - np.log2(UNITS)) if largest > 0 else 1.0
    n, *rest = _whole_sums(sequences, 1 + 2 * width, _Moments(width, unit))
    sums, squares = rest[:width], rest[width:]
    spread = [n * b - a * a for a, b in zip(sums, squares)]  # exact
    divisor = max(n * (n - 1), 1)
    return n, unit, np.array([s / divisor for s in spread]) * unit**2


def seed_rows(sequences: DataFrame, states: int, width: int, seed: int, tries: int) -> list[list[tuple]]:
    """Per try the drawn (race key, user_id, bet_date, row), in order; at most ``states``."""
    drawn: list[list[tuple]] = [[] for _ in range(tries)]
    hashed = sequences.withColumn("h", row_hashes(seed))
    for round_ in range(states):
        rows = [np.array([s[3] for s in own]).reshape(-1, width) for own in drawn]
        for t, found in draw_seeds(hashed, round_, rows).items():
            drawn[t].append(found)
    return drawn


def kmeans_centers(
    sequences: DataFrame,
    states: int,
    width: int,
    seed: int = 42,
    tries: int = 10,
    passes: int = 20,
    tol: float = 1e-4,
) -> tuple[np.ndarray, np.ndarray]:
    """(centres, variance by column) of the rows of (user_id, days, bet_dates, x).

    The centres are those of the try with the least inertia, in descending order; fewer than
    ``states`` if there are fewer distinct rows. A try is settled once its centres move by no
    more than ``tol`` times the mean variance. Raises without any row.
    """
    n, unit, variance = moments(sequences, width)
    if not n:
        raise ValueError("no rows to start from")
    drawn = seed_rows(sequences, states, width, seed, tries)
    # tries stop at the same number of distinct rows, since all see the same ones
    centers = [np.array([s[3] for s in own]) for own in drawn]
    k = len(centers[0])
    inertia = [0] * tries
    for _ in range(passes):
        found = _whole_sums(sequences, tries * (k * (1 + width) + 1), _Step(centers, unit))
        parts = np.array(found[:-tries], dtype=object).reshape(tries, k, 1 + width)
        inertia = found[-tries:]
        after = [
            np.array([[float(v / p[0]) * unit for v in p[1:]] if p[0] else old.tolist() for p, old in zip(own, was)])
            for own, was in zip(parts, centers)
        ]
        moved = max(((a - b) ** 2).sum() for a, b in zip(after, centers))
        centers = after
        if moved <= tol * variance.mean():
            break
    ordered = [c[np.lexsort(tuple(-c[:, ::-1].T))] for c in centers]
    best = min(range(tries), key=lambda t: (inertia[t], ordered[t].tolist()))
    return ordered[best], variance
