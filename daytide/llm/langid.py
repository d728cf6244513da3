"""Language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes, A-Z as a-z. Bytes are embedded, filters of several
widths run over the window, each filter keeps its maximum, and a softmax over the learnt
languages follows. The network is trained in NumPy on every window of every labelled text,
data-parallel: in each round every task runs Adam over its windows, and Spark averages the
weights by windows. A large table is gone through once, a share of its texts a round, a small
one again and again. Texts are dealt by hash, so that no task sees one language alone. The
network is applied to every window of every text; a document's probabilities are the means
over its windows, weighted by their bytes.

Defined cases: a null text and a text without a letter are ``und`` with score 0; every
input row gives a row, rows with equal or null doc_id too; rows without a language are not
learnt from; without any labelled row every text is ``und``; other columns are left behind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.llm.common import held_out, texts
from daytide.llm.words import LOWER, buffer_of, parts
from daytide.session import ship_package

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 6
#: Windows convolved at a time, so that the activations stay in the processor's cache.
CHUNK = 64
#: Windows that the training goes through at least, by whole passes over the labelled texts, of
#: which it makes no more than PASSES.
TRAINED = 1 << 16
PASSES = 8
#: Rounds at least; where one pass is enough, each takes one of so many shares of the texts.
ROUNDS = 4
#: Adam's step size in the first round and in the last.
RATES = (0.01, 0.003)
#: Windows of a round that are worth a task.
TASK_WINDOWS = 1 << 13
#: Share of the labelled windows that are less certain than the cut of keep_known().
UNCERTAIN = 1 / 1000


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # widest * EMBEDDING x all filters; narrow ones are zero at the end
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    least: float = 0.0  # best probability that a text of a learnt language has, see calibrated()

    def convolved(self, windows: np.ndarray):
        """Activations (filters x windows x places) and the embedded spans they come from."""
        n, length = windows.shape
        span = max(WIDTHS)
        x = self.embed[windows]
        shape = (n, length - span + 1, span * EMBEDDING)
        seen = np.lib.stride_tricks.as_strided(x, shape, x.strides)
        z = np.ascontiguousarray(self.filters.T) @ seen.reshape(-1, span * EMBEDDING).T
        return z.reshape(-1, n, shape[1]), seen

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(windows), CHUNK):
            z, _ = self.convolved(windows[a : a + CHUNK])
            active = np.maximum(z.max(axis=2).T + self.bias, 0)
            out.append(softmax(active @ self.dense + self.dense_bias))
        return np.concatenate(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def filter_mask() -> np.ndarray:
    """Which weights each filter has: the first ``width`` bytes of the widest span."""
    mask = np.zeros((max(WIDTHS) * EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


NAMES = ["embed", "filters", "bias", "dense", "dense_bias"]


def start(languages: list[str], seed: int = 7) -> ByteNet:
    """Small random weights."""
    rng = np.random.default_rng(seed)
    mask, kinds = filter_mask(), len(languages)
    units = mask.shape[1]
    return ByteNet(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(units, np.float32),
        rng.normal(0, 0.3, (units, kinds)).astype(np.float32),
        np.zeros(kinds, np.float32),
    )


class Adam:
    """Adam on the cross entropy, with the gradients written out."""

    def __init__(self, net: ByteNet, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.first = {n: np.zeros_like(getattr(net, n)) for n in NAMES}
        self.second = {n: np.zeros_like(getattr(net, n)) for n in NAMES}

    def update(self, x: np.ndarray, y: np.ndarray) -> None:
        net, span = self.net, max(WIDTHS)
        units = len(net.bias)
        z, seen = net.convolved(x)
        at = z.argmax(axis=2).T  # windows x units
        best = z.max(axis=2).T + net.bias
        active = np.maximum(best, 0)
        error = softmax(active @ net.dense + net.dense_bias)
        error[np.arange(len(x)), y] -= 1
        error /= len(x)
        grad = {"dense": active.T @ error, "dense_bias": error.sum(axis=0)}
        back = (error @ net.dense.T) * (best > 0)
        grad["bias"] = back.sum(axis=0)
        patch = seen[np.arange(len(x))[:, None], at]  # windows x units x span * EMBEDDING
        grad["filters"] = np.einsum("bu,bud->du", back, patch) * filter_mask()
        into = (back[:, :, None] * net.filters.T[None]).reshape(len(x), units, span, EMBEDDING)
        bytes_ = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(span)]
        grad["embed"] = np.zeros_like(net.embed)
        np.add.at(grad["embed"], bytes_.reshape(-1), into.reshape(-1, EMBEDDING))
        self.step += 1
        for n in NAMES:
            self.first[n] = 0.9 * self.first[n] + 0.1 * grad[n]
            self.second[n] = 0.999 * self.second[n] + 0.001 * grad[n] ** 2
            move = self.first[n] / (1 - 0.9**self.step) / (np.sqrt(self.second[n] / (1 - 0.999**self.step)) + 1e-8)
            setattr(net, n, (getattr(net, n) - self.rate * move).astype(np.float32))

    def over(self, windows: np.ndarray, target: np.ndarray, rng) -> None:
        """Updates by all the windows once, in random order."""
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // CHUNK)):
            self.update(windows[rows], target[rows])


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 8, seed: int = 7) -> ByteNet:
    """The network after some passes over windows that are at hand."""
    rng = np.random.default_rng(seed)
    adam = Adam(start(languages, seed), RATES[0])
    for _ in range(epochs):
        adam.over(windows, target, rng)
    return adam.net


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """All windows of all texts, padded with spaces, with their text number and byte count."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + nth * WINDOW
    used = np.minimum(WINDOW, offsets[1:][owner] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return LOWER[np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], np.uint8(0x20))], owner, used


def _targets(net: ByteNet, batch: pa.RecordBatch, owner: np.ndarray) -> np.ndarray:
    number = {name: i for i, name in enumerate(net.languages)}
    return np.array([number[name] for name in batch["lang"].to_pylist()], np.int64)[owner]


def _trained(net: ByteNet, rate: float, seed: int):
    """Each task's weights after Adam over all its windows, times their number."""

    def kernel(batches):
        task = TaskContext.get().partitionId()
        rng, n = np.random.default_rng([seed, task]), 0
        adam = Adam(ByteNet(net.languages, *(getattr(net, name) for name in NAMES)), rate)
        for batch in parts(batches, limit=1 << 20):
            data, offsets = buffer_of(batch["text"])
            step = WINDOW << 12
            for a in range(0, len(data), step):
                windows, owner, _ = windows_of(data[a : a + step], np.clip(offsets, a, a + step) - a)
                adam.over(windows, _targets(net, batch, owner), rng)
                n += len(windows)
        if n:
            flat = np.concatenate([getattr(adam.net, name).reshape(-1) for name in NAMES]).astype(np.float64)
            size = len(flat)
            yield pa.record_batch(
                [
                    pa.array(np.full(size, task, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, n)),
                    pa.array(flat * n),
                ],
                names=["part", "idx", "n", "v"],
            )

    return kernel


def _averaged(net: ByteNet, found: DataFrame) -> ByteNet:
    """The mean of the tasks' weights, added up in the order of tasks, so that a rerun gives the same bits."""
    rows = F.sort_array(F.collect_list(F.struct("part", "n", "v")))
    add = lambda name, zero: F.aggregate(rows, zero, lambda acc, r: acc + r[name])
    sums = found.groupBy("idx").agg(
        add("n", F.lit(0).cast("long")).alias("n"), add("v", F.lit(0.0)).alias("v")
    )
    # as many numbers as the network has weights, whatever the data
    flat, at, out = np.array([r["v"] / r["n"] for r in sums.orderBy("idx").collect()]), 0, []
    if not len(flat):
        return net
    for name in NAMES:
        old = getattr(net, name)
        out.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    return ByteNet(net.languages, *out)


def calibrated(net: ByteNet, known: DataFrame) -> float:
    """The best probability that all but UNCERTAIN of the labelled windows reach.

    It is above that of undecided texts, 1 / languages, however many languages there are. The
    quantile is exact: probabilities are counted by their bits, coarse first.
    """

    def counted(done: int, prefix: int):
        def kernel(batches):
            for batch in parts(batches, limit=1 << 20):
                data, offsets = buffer_of(batch["text"])
                step = WINDOW << 12
                for a in range(0, len(data), step):
                    windows, _, _ = windows_of(data[a : a + step], np.clip(offsets, a, a + step) - a)
                    bits = net.probabilities(windows).max(axis=1).astype(np.float32).view(np.uint32).astype(np.int64)
                    own = bits[bits >> (32 - done) == prefix]
                    digit, n = np.unique((own >> (16 - done)) & 0xFFFF, return_counts=True)
                    yield pa.record_batch([pa.array(digit), pa.array(n)], names=["digit", "n"])

        return kernel

    def places(done: int, prefix: int) -> list:
        found = known.select("text").mapInArrow(counted(done, prefix), "digit long, n long")
        # at most 65,536 rows
        return found.groupBy("digit").agg(F.sum("n").alias("n")).orderBy("digit").collect()

    first = places(0, 0)
    rest, prefix = int(UNCERTAIN * sum(r["n"] for r in first)), 0
    for done, rows in ((0, first), (16, None)):
        for row in rows or places(done, prefix):
            if rest < row["n"]:
                prefix = prefix << 16 | row["digit"]
                break
            rest -= row["n"]
    return float(np.array([prefix], np.uint32).view(np.float32)[0]) - 1e-6


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet | None:
    """The network for a labelled table, learnt from all its labelled texts; None if nothing is labelled.

    The result does not depend on how the rows lie in partitions, only on the session's number
    of shuffle partitions where the table is large.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")
    )
    known = given.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    count = F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("windows")
    counts = {r["lang"]: r["windows"] for r in known.groupBy("lang").agg(count).collect()}
    if not counts:
        return None
    total = sum(counts.values())
    passes = min(PASSES, math.ceil(TRAINED / total))
    share = ROUNDS if passes == 1 else 1
    rounds = max(ROUNDS, passes)
    tasks = max(1, min(total // share // TASK_WINDOWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    net = start(sorted(counts))
    order = F.xxhash64("doc_id", "text", "lang")
    known = known.withColumn("order", order)
    for number, rate in enumerate(np.geomspace(*RATES, rounds)):
        mine = known.where(F.pmod("order", F.lit(share)) == number % share)
        dealt = mine.repartition(tasks, "order").sortWithinPartitions("order")
        found = dealt.select("text", "lang").mapInArrow(
            _trained(net, float(rate), number), "part int, idx int, n long, v double"
        )
        net = _averaged(net, found)
    net.least = calibrated(net, known)
    return net


def document_probabilities(net: ByteNet, column: pa.Array) -> np.ndarray:
    """Mean probabilities over the windows of each text; texts x languages."""
    data, offsets = buffer_of(column)
    total = np.zeros((len(column), len(net.languages)))
    # a long text is scored in slices of a bounded number of windows
    step = WINDOW << 12
    for a in range(0, max(1, len(data)), step):
        b = min(len(data), a + step)
        windows, owner, used = windows_of(data[a:b], np.clip(offsets, a, b) - a)
        if len(owner):
            np.add.at(total, owner, net.probabilities(windows) * used[:, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def _scores(net: ByteNet):
    def kernel(batches):
        for batch in parts(batches, limit=1 << 20):
            n = batch.num_rows
            mean = document_probabilities(net, batch["text"])
            best = mean.argmax(axis=1)
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    batch["letters"],
                    pa.array([net.languages[i] for i in best]),
                    pa.array(mean[np.arange(n), best]),
                ],
                names=["doc_id", "letters", "lang_pred", "score"],
            )

    return kernel


def predict(docs: DataFrame, net: ByteNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language) of every row."""
    given = texts(docs, doc_id, text)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return given.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    scored = given.withColumn("letters", letters).mapInArrow(
        _scores(net), "doc_id long, letters boolean, lang_pred string, score double"
    )
    return scored.select(
        "doc_id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )


def keep_known(docs: DataFrame, net: ByteNet | None, text: str = "text", least: float | None = None) -> DataFrame:
    """The rows, with all their columns, whose language the network knows.

    Rejected are texts that are null or without a letter, and texts whose best language has
    a mean probability below ``least``, by default the cut calibrated on the labelled
    windows. A network of one language is sure of every text and rejects none. Nothing is
    joined or shuffled.
    """
    ship_package(docs.sparkSession)
    lettered = docs.where(F.col(text).rlike(r"\p{L}"))
    if net is None:
        return lettered.limit(0)
    cut = net.least if least is None else least

    def kernel(batches):
        for batch in parts(batches, text, limit=1 << 20):
            best = document_probabilities(net, batch[text]).max(axis=1)
            yield batch.filter(pa.array(best >= cut))
            pa.default_memory_pool().release_unused()

    return lettered.mapInArrow(kernel, docs.schema)
