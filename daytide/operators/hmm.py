"""Gaussian hidden Markov model over user-day sequences, fitted by distributed EM.

A sequence holds the betting days of one user, so its length is bounded by the number of
calendar days. Each EM pass is one job: every partition reduces its sequences to a
fixed-size vector of sums, Spark adds the vectors, and the driver updates the parameters
from that single vector. Rows never reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.sequence_kernels import HmmParams, by_step, most_likely_states, step_counts
from daytide.operators.start import kmeans_centers
from daytide.session import ship_package, stage


@dataclass
class HmmFit:
    params: HmmParams
    converged: bool
    log_likelihoods: list[float] = field(default_factory=list)
    #: Log-likelihood less the penalty of the covariance prior: what EM never lowers.
    objectives: list[float] = field(default_factory=list)

    @property
    def iterations(self) -> int:
        return len(self.log_likelihoods)


def user_sequences(z: DataFrame, columns: list[str] = schema.Z_FEATURES) -> DataFrame:
    """(user_id, days, bet_dates, x): a user's rows in date order, x flattened row by row."""
    row = F.struct("bet_date", F.array(*columns).alias("v"))
    rows = F.sort_array(F.collect_list(row))
    return (
        z.groupBy("user_id")
        .agg(rows.alias("rows"))
        .select(
            "user_id",
            F.size("rows").alias("days"),
            F.col("rows.bet_date").alias("bet_dates"),
            F.flatten("rows.v").alias("x"),
        )
    )


def sequence_lengths(z: DataFrame) -> DataFrame:
    return z.groupBy("user_id").agg(F.count("*").alias("days"))


def train_user_days(z: DataFrame, min_days: int = 3) -> DataFrame:
    """Rows of users with at least ``min_days`` rows."""
    users = sequence_lengths(z).where(F.col("days") >= min_days)
    return z.join(users, "user_id", "left_semi")


def initial_params(
    sequences: DataFrame, states: int, width: int, seed: int = 42, min_covar: float = 1e-3
) -> HmmParams:
    """k-means centres as means, overall variance, near-uniform seeded probabilities.

    The same rows give the same parameters, however they are partitioned.
    """
    centers, variance = kmeans_centers(sequences, states, width, seed)
    rng = np.random.default_rng(seed)
    while len(centers) < states:  # fewer distinct rows than states
        centers = np.vstack([centers, centers[-1] + rng.normal(scale=0.1, size=width)])
    start = 1.0 + 0.1 * rng.random(states)
    trans = 1.0 + 0.1 * rng.random((states, states))
    return HmmParams(
        start / start.sum(),
        trans / trans.sum(axis=1, keepdims=True),
        centers,
        np.tile(variance + min_covar, (states, 1)),
    )


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


#: Rows whose sequences a pass of EM works on together, so that their arrays stay in the cache.
TOGETHER = 1 << 14


def packed(sequences: DataFrame, width: int) -> DataFrame:
    """(running, x): sequences of about ``TOGETHER`` rows as two arrays of bytes, see ``by_step``.

    A pass of EM reads them as they are, without a list for each sequence.
    """
    ship_package(sequences.sparkSession)

    def pack(batches):
        for batch in batches:
            days = batch.column("days").to_numpy()
            ends = np.cumsum(days)
            x = _flat(batch.column("x")).reshape(-1, width)
            at = 0
            while at < len(days):
                begin = int(ends[at] - days[at])
                end = max(at + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
                steps, running = by_step(x[begin : ends[end - 1]], days[at:end])
                columns = [pa.array([a.tobytes()], pa.binary()) for a in (running.astype(np.int64), steps)]
                yield pa.RecordBatch.from_arrays(columns, names=["running", "x"])
                at = end

    return sequences.where("days > 0").select("days", "x").mapInArrow(pack, "running binary, x binary")


def expectation(sequences: DataFrame, params: HmmParams) -> np.ndarray:
    """Sums of ``expected_counts`` over all sequences."""
    return _expectation(packed(sequences, params.means.shape[1]), params)


def _expectation(table: DataFrame, params: HmmParams) -> np.ndarray:
    """``expectation`` over a ``packed`` table.

    Partition vectors are added in partition order, so a rerun gives the same bits.
    """
    width = params.means.shape[1]
    size = 1 + 2 * params.states + params.states**2 + 2 * params.states * width

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            for running, x in zip(batch.column("running"), batch.column("x")):
                x = np.frombuffer(x.as_buffer()).reshape(width, -1)
                total += step_counts(x, np.frombuffer(running.as_buffer(), np.int64), params)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, TaskContext.get().partitionId(), dtype=np.int32)),
                pa.array(np.arange(size, dtype=np.int32)),
                pa.array(total),
            ],
            names=["part", "idx", "v"],
        )

    in_order = F.sort_array(F.collect_list(F.struct("part", "v")))
    sums = (
        table.select("running", "x")
        .mapInArrow(partial, "part int, idx int, v double")
        .groupBy("idx")
        .agg(F.aggregate(in_order, F.lit(0.0), lambda acc, e: acc + e["v"]).alias("v"))
    )
    out = np.zeros(size)
    for row in sums.collect():  # `size` numbers, whatever the data
        out[row["idx"]] = row["v"]
    return out


def maximization(
    counts: np.ndarray, params: HmmParams, covars_prior: float = 1e-2
) -> tuple[float, HmmParams]:
    """Log-likelihood of ``params`` and the parameters updated from the expected counts."""
    k, width = params.means.shape
    loglik, rest = counts[0], counts[1:]
    start, rest = rest[:k], rest[k:]
    moves, rest = rest[: k * k].reshape(k, k), rest[k * k :]
    weight, rest = rest[:k, None], rest[k:]
    sums, squares = rest.reshape(2, k, width)

    leaving = moves.sum(axis=1, keepdims=True)
    trans = np.where(leaving > 0, moves / np.where(leaving > 0, leaving, 1.0), params.trans)
    safe = np.maximum(weight, 1e-5)
    means = np.where(weight > 0, sums / safe, params.means)
    spread = squares - 2 * means * sums + means**2 * weight
    covars = (covars_prior + np.maximum(spread, 0.0)) / safe
    return float(loglik), HmmParams(start / start.sum(), trans, means, covars)


def canonical_order(params: HmmParams) -> HmmParams:
    """State numbers are arbitrary: sort by descending means, first feature first."""
    order = np.lexsort(tuple(-params.means[:, ::-1].T))
    return HmmParams(
        params.start[order],
        params.trans[np.ix_(order, order)],
        params.means[order],
        params.covars[order],
    )


def penalty(params: HmmParams, covars_prior: float = 1e-2) -> float:
    """What the prior on the variances takes off the log-likelihood in the maximisation step."""
    return float(covars_prior / 2 * (1 / params.covars).sum())


def _started(train: DataFrame, states: int, width: int, seed: int, min_covar: float) -> HmmParams:
    """``initial_params`` of rows that are kept while it reads them."""
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return initial_params(train, states, width, seed, min_covar)
    finally:
        train.unpersist()


def fit(
    sequences: DataFrame,
    states: int = 4,
    min_train_days: int = 3,
    max_iter: int = 150,
    tol: float = 1e-3,
    seed: int = 42,
    min_covar: float = 1e-3,
    covars_prior: float = 1e-2,
    init: HmmParams | None = None,
    width: int = len(schema.Z_FEATURES),
) -> HmmFit:
    """EM until the log-likelihood gains less than ``tol`` or ``max_iter`` passes.

    The prior on the variances is part of what EM raises, so near the end the likelihood
    alone may fall a little; ``objectives`` has the penalised values, and if the likelihood
    fell the parameters before that step are kept.

    Pass staged sequences: they are read by the start, from memory where they fit, and once
    more for ``packed`` arrays, which every iteration reads; a lost executor only re-reads its
    part of the staged table.
    """
    train = sequences.where(F.col("days") >= min_train_days).select("user_id", "days", "bet_dates", "x")
    # the plan of the arrays is made first, so that they come from the staged table
    table = packed(train, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        params = init or _started(train, states, width, seed, min_covar)
        result = HmmFit(params, converged=False)
        previous = params
        for _ in range(max_iter):
            loglik, after = maximization(_expectation(table, params), params, covars_prior)
            history = result.log_likelihoods
            history.append(loglik)
            result.objectives.append(loglik - penalty(params, covars_prior))
            if len(history) > 1 and history[-1] - history[-2] < tol:
                result.converged = True
                params = previous if history[-1] < history[-2] else after
                break
            previous, params = params, after
        result.params = canonical_order(params)
        return result
    finally:
        table.unpersist()


def decode(sequences: DataFrame, params: HmmParams) -> DataFrame:
    """(user_id, bet_date, hmm_state) of the most likely path, for users of any length."""
    ship_package(sequences.sparkSession)
    width = params.means.shape[1]

    def paths(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            days = batch.column("days").to_numpy()
            x = _flat(batch.column("x")).reshape(-1, width)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), days))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("user_id").take(owner),
                    batch.column("bet_dates").flatten(),
                    pa.array(most_likely_states(x, days, params)),
                ],
                names=["user_id", "bet_date", "hmm_state"],
            )

    return sequences.select("user_id", "days", "bet_dates", "x").mapInArrow(
        paths, "user_id string, bet_date date, hmm_state int"
    )


def parameter_tables(
    spark: SparkSession, params: HmmParams, columns: list[str] = schema.Z_FEATURES
) -> dict[str, DataFrame]:
    """Parameters as small frames: start, transitions, means, covars."""
    k = range(params.states)
    wide = ", ".join(f"`{c}` double" for c in columns)
    return {
        "start": spark.createDataFrame(
            [(s, float(params.start[s])) for s in k], "hmm_state int, p double"
        ),
        "transitions": spark.createDataFrame(
            [(a, b, float(params.trans[a, b])) for a in k for b in k],
            "from_state int, to_state int, p double",
        ),
        "means": spark.createDataFrame(
            [(s, *map(float, params.means[s])) for s in k], f"hmm_state int, {wide}"
        ),
        "covars": spark.createDataFrame(
            [(s, *map(float, params.covars[s])) for s in k], f"hmm_state int, {wide}"
        ),
    }


def params_from_tables(tables: dict[str, DataFrame]) -> HmmParams:
    start = tables["start"].orderBy("hmm_state").collect()
    k = len(start)
    trans = np.zeros((k, k))
    for row in tables["transitions"].collect():
        trans[row["from_state"], row["to_state"]] = row["p"]

    def matrix(name: str) -> np.ndarray:
        return np.array([row[1:] for row in tables[name].orderBy("hmm_state").collect()], float)

    return HmmParams(
        np.array([row["p"] for row in start]), trans, matrix("means"), matrix("covars")
    )


def save_params(spark: SparkSession, params: HmmParams, path: str) -> None:
    for name, df in parameter_tables(spark, params).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_params(spark: SparkSession, path: str) -> HmmParams:
    names = ("start", "transitions", "means", "covars")
    return params_from_tables({n: spark.read.parquet(f"{path}/{n}") for n in names})


def history_table(spark: SparkSession, result: HmmFit) -> DataFrame:
    """(iteration, log_likelihood, gain, objective); a negative gain is shown as it is."""
    rows, previous = [], None
    for i, (value, objective) in enumerate(zip(result.log_likelihoods, result.objectives), 1):
        rows.append((i, value, None if previous is None else value - previous, objective))
        previous = value
    return spark.createDataFrame(
        rows, "iteration int, log_likelihood double, gain double, objective double"
    )


def run_summary(
    features: DataFrame, sequences: DataFrame, result: HmmFit, min_train_days: int = 3
) -> DataFrame:
    """One row describing a run; counts come from the data, the rest from the fit."""
    train = F.col("days") >= min_train_days
    counts = sequences.agg(
        F.sum("days").cast("long").alias("rows"),
        F.count("*").alias("users"),
        F.coalesce(F.sum(F.when(train, F.col("days"))), F.lit(0)).cast("long").alias("train_rows"),
        F.count_if(train).alias("train_users"),
    )
    dates = features.agg(F.struct(F.min("bet_date").alias("a"), F.max("bet_date").alias("b"))).scalar()
    last = result.log_likelihoods[-1] if result.log_likelihoods else None
    return counts.select(
        "*",
        F.lit(result.params.states).alias("states"),
        F.lit(min_train_days).alias("min_train_days"),
        F.lit(result.converged).alias("converged"),
        F.lit(result.iterations).alias("iterations"),
        F.lit(last).cast("double").alias("log_likelihood"),
        dates["a"].alias("date_min"),
        dates["b"].alias("date_max"),
    )


def staged_sequences(z: DataFrame) -> DataFrame:
    return stage(user_sequences(z), "sequences")
