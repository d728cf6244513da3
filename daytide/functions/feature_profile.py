"""One pass over declared columns for all that summaries, correlations and quantiles begin with.

A task keeps for its rows, merged batch by batch:

* the pair moments of all pairs of columns (see ``pair_moments``),
* rows, zeros and central moments to the third of each column,
* how many values of each column begin with each 16 bits, in the order of numbers, with the
  lowest and highest of them: the first pass of ``exact_quantiles``.

Its size depends on the columns, not on the rows: columns x 1.5 MB in a task, and at most
columns x (columns + 65,536) rows written. The states of tasks are written once and merged by
Spark, so the summary, the correlations and the first digits of quantiles share one scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.functions import pair_moments as pairs
from daytide.functions.quantiles import BEGUN_BITS, BITS, Begun, ordered_bits
from daytide.session import ship_package, stage

#: State of a column: known values, all rows, zeros, mean (anchor, rest), central sums, range.
STATE = ["n", "rows", "zeros", "anchor", "rest", "m2", "m3", "low", "high"]
KIND = "kind string, a int, b int, n long, low double, high double, state array<double>"
MOMENTS = "feature string, n long, rows long, zeros long, mean double, m2 double, m3 double, low double, high double"
SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("a", pa.int32()),
        ("b", pa.int32()),
        ("n", pa.int64()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("state", pa.list_(pa.float64())),
    ]
)


class _Digits:
    """Values of each column by leading digit, with the range of each digit."""

    def __init__(self, columns: int):
        shape = (columns, 1 << BEGUN_BITS)
        self.count = np.zeros(shape, np.int64)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, x: np.ndarray) -> None:
        for j in range(x.shape[1]):
            own = np.sort(x[~np.isnan(x[:, j]), j]) + 0.0
            if not len(own):
                continue
            digit, first, count = np.unique(
                ordered_bits(own) >> np.uint64(BITS - BEGUN_BITS), return_index=True, return_counts=True
            )
            digit = digit.astype(np.int64)
            self.count[j, digit] += count
            self.low[j, digit] = np.minimum(self.low[j, digit], own[first])
            self.high[j, digit] = np.maximum(self.high[j, digit], own[first + count - 1])


def _column_state(x: np.ndarray, pair: dict[str, np.ndarray]) -> np.ndarray:
    """STATE x columns of a batch, beside its pair state."""
    seen = ~np.isnan(x)
    diagonal = {name: np.diagonal(value) for name, value in pair.items()}
    anchor, rest, n = diagonal["anchor_a"], diagonal["rest_a"], diagonal["n"]
    x0 = np.where(seen, x - anchor, 0)
    m3 = (x0**3).sum(axis=0) - 3 * rest * (x0 * x0).sum(axis=0) + 2 * n * rest**3
    rows = np.full(x.shape[1], float(len(x)))
    zeros = (x == 0).sum(axis=0).astype(float)
    ends = [diagonal["m2_a"], m3, diagonal["low_a"], diagonal["high_a"]]
    return np.stack([n, rows, zeros, anchor, rest, *ends])


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """State of the rows of both."""
    a, b = dict(zip(STATE, x)), dict(zip(STATE, y))
    n = a["n"] + b["n"]
    whole = np.maximum(n, 1)
    both = (a["n"] > 0) & (b["n"] > 0)
    d = np.where(both, (b["anchor"] - a["anchor"]) + (b["rest"] - a["rest"]), 0)
    out = {
        "n": n,
        "rows": a["rows"] + b["rows"],
        "zeros": a["zeros"] + b["zeros"],
        "anchor": np.where(a["n"] > 0, a["anchor"], b["anchor"]),
        "rest": np.where(a["n"] > 0, a["rest"], b["rest"]) + d * b["n"] / whole,
        "m2": a["m2"] + b["m2"] + d**2 * a["n"] * b["n"] / whole,
        "m3": a["m3"]
        + b["m3"]
        + d**3 * a["n"] * b["n"] * (a["n"] - b["n"]) / whole**2
        + 3 * d * (a["n"] * b["m2"] - b["n"] * a["m2"]) / whole,
        "low": np.minimum(a["low"], b["low"]),
        "high": np.maximum(a["high"], b["high"]),
    }
    return np.stack([out[s] for s in STATE])


def _merge(x: Column, y: Column) -> Column:
    """The same as ``_merged`` for two states with rows; a state without known values has no mean."""
    known_x, known_y = x["n"] > 0, y["n"] > 0
    n, both = x["n"] + y["n"], known_x & known_y
    d = F.when(both, (y["anchor"] - x["anchor"]) + (y["rest"] - x["rest"])).otherwise(0.0)
    whole = F.greatest(n, F.lit(1.0))
    out = {
        "n": n,
        "rows": x["rows"] + y["rows"],
        "zeros": x["zeros"] + y["zeros"],
        "anchor": F.when(known_x, x["anchor"]).otherwise(y["anchor"]),
        "rest": F.when(known_x, x["rest"]).otherwise(y["rest"]) + d * y["n"] / whole,
        "m2": x["m2"] + y["m2"] + d * d * x["n"] * y["n"] / whole,
        "m3": x["m3"]
        + y["m3"]
        + d * d * d * x["n"] * y["n"] * (x["n"] - y["n"]) / (whole * whole)
        + d * (x["n"] * y["m2"] - y["n"] * x["m2"]) * 3.0 / whole,
        "low": F.least(x["low"], y["low"]),
        "high": F.greatest(x["high"], y["high"]),
    }
    return F.struct(*(out[s].alias(s) for s in STATE))


def _of_task(batches):
    pair = column = digits = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
        own = pairs.batch_state(x)
        of_columns = _column_state(x, own)
        pair = own if pair is None else pairs.merged(pair, own)
        column = of_columns if column is None else _merged(column, of_columns)
        digits = digits or _Digits(x.shape[1])
        digits.add(x)
    if pair is None:
        return
    size = len(pair["n"])
    a, b = np.divmod(np.arange(size * size), size)
    yield _rows("pair", a, b, state=np.stack([pair[s].reshape(-1) for s in pairs.STATE], axis=1))
    yield _rows("column", np.arange(size), np.zeros(size), state=column.T)
    for j in range(size):
        digit = np.flatnonzero(digits.count[j])
        found = (digits.count[j, digit], digits.low[j, digit], digits.high[j, digit])
        yield _rows("digit", np.full(len(digit), j), digit, *found)


def _rows(kind, a, b, n=None, low=None, high=None, state=None) -> pa.RecordBatch:
    given = [[kind] * len(a), a.astype(np.int32), b.astype(np.int32), n, low, high, None if state is None else list(state)]
    columns = [pa.nulls(len(a), t) if c is None else pa.array(c, t) for c, t in zip(given, SCHEMA.types)]
    return pa.record_batch(columns, schema=SCHEMA)


@dataclass
class Profile:
    """The written states of all tasks, and what is read off them without another scan of the rows."""

    table: DataFrame
    columns: list[str]

    def _named(self, position: Column) -> Column:
        return F.array(*(F.lit(c) for c in self.columns))[position]

    def pair_moments(self) -> DataFrame:
        """As ``pair_moments`` of the same rows."""
        state = [F.col("state")[i].alias(s) for i, s in enumerate(pairs.STATE)]
        states = self.table.where("kind = 'pair'").select(F.col("a").alias("pos_a"), F.col("b").alias("pos_b"), *state)
        return pairs.merged_pairs(states, len(self.columns))

    def column_moments(self) -> DataFrame:
        """(feature, n, rows, zeros, mean, m2, m3, low, high); no row where the input had none."""
        return self.table.sparkSession.createDataFrame(self._columns, MOMENTS)

    @cached_property
    def _columns(self) -> list:
        """Merged states, a row a column, read once."""
        state = F.struct(*(F.col("state")[i].alias(s) for i, s in enumerate(STATE)))
        # one state a task
        every = self.table.where("kind = 'column'").groupBy("a").agg(F.collect_list(state).alias("all"))
        step = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], _merge)
        found = every.select(self._named(F.col("a")).alias("feature"), step.alias("s"))
        found = found.select(
            "feature",
            *(F.col(f"s.{s}").cast("long").alias(s) for s in ("n", "rows", "zeros")),
            F.expr("CASE WHEN s.n > 0 THEN s.anchor + s.rest END").alias("mean"),
            "s.m2",
            "s.m3",
            *(F.expr(f"CASE WHEN s.n > 0 THEN s.{s} END").alias(s) for s in ("low", "high")),
        )
        return found.collect()

    def begun(self) -> Begun:
        """The first pass of ``exact_quantiles`` over (feature, value) rows."""
        counts = self.table.where("kind = 'digit'").select(
            self._named(F.col("a")).alias("feature"),
            F.col("b").cast("long").alias("_d"),
            F.col("n").alias("_c"),
            F.col("low").alias("_low"),
            F.col("high").alias("_high"),
        )
        return Begun(self._columns, counts)


def profile(df: DataFrame, columns: list[str]) -> Profile:
    """Profile of the given columns of finite doubles or nulls: one scan, written at once."""
    ship_package(df.sparkSession)
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    return Profile(stage(doubles.mapInArrow(_of_task, KIND), "profile"), list(columns))
