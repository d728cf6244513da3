"""What five filters remove in every order, alone and together.

1. Four filters judge a text by itself, in one pass over its bytes. The fifth asks whether
   a smaller id has the same text. A radix trie over the texts of a slice of rows, with the
   smallest id at each terminal, answers it within the slice; only the holders of these ids
   go on, so a text that a third of the rows have crosses the network once a slice.
2. The texts left are range-partitioned by adaptive prefixes: prefixes of too many bytes are
   cut further, at four times the length, until they are small or whole texts. A partition
   inserts its texts into one compressed trie, whose terminals settle the duplicates.
3. What is left of a row is its part, a mask of the filters it fails, and its labels.
   Counts by part and mask, at most 32 a part, give every order of the filters by a matrix
   product, so no row is visited once for each order.

Defined cases: a null text is empty; a text without words fails A only among the first two;
a null part is the empty string; rows without an id neither are duplicates nor have any;
rows of equal id and text are not duplicates of each other; repeated labels of an id count
if any of them says so, labels of unknown ids not at all; an empty table gives no rows;
other columns are left behind.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.llm.words import Words, parts
from daytide.session import ship_package, stage

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")

# Fixed values of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: Characters of the first prefixes, and how much longer the next ones are.
PREFIX = 12
LONGER = 4
#: Bytes of texts of a partition, and of a prefix that is not cut further; at most so many are.
TRIE_BYTES = 32_000_000
CELL_BYTES = 1_000_000
MOST_HEAVY = 1_000_000


class Trie:
    """Compressed trie over byte strings; a terminal keeps the smallest number put there."""

    def __init__(self):
        self.label = [b""]
        self.children: list[dict[int, int]] = [{}]
        self.least: list[int | None] = [None]

    def _node(self, label: bytes) -> int:
        self.label.append(label)
        self.children.append({})
        self.least.append(None)
        return len(self.label) - 1

    def insert(self, text: bytes, number: int) -> int:
        """Put number at the terminal of text; returns the terminal."""
        at, place, size = 0, 0, len(text)
        while place < size:
            child = self.children[at].get(text[place])
            if child is None:
                child = self._node(text[place:])
                self.children[at][text[place]] = child
                at = child
                break
            label = self.label[child]
            if not text.startswith(label, place):
                at = self._split(at, child, shared(label, text, place))
                place += len(self.label[at])
            else:
                at = child
                place += len(label)
        if self.least[at] is None or number < self.least[at]:
            self.least[at] = number
        return at

    def _split(self, parent: int, child: int, size: int) -> int:
        """A node after the first size bytes of the edge to child."""
        label = self.label[child]
        middle = self._node(label[:size])
        self.children[parent][label[0]] = middle
        self.children[middle][label[size]] = child
        self.label[child] = label[size:]
        return middle


def shared(label: bytes, text: bytes, place: int) -> int:
    """Length of the longest beginning of label that text has at place."""
    low, high = 0, min(len(label), len(text) - place)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == text[place : place + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def own_masks(column) -> np.ndarray:
    """Which of the filters A to D each text of a column fails."""
    words = Words(column)
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1

    def inside(marks: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(marks, out=upto[1:])
        return np.diff(upto[offsets])

    number = words.text_number()
    order = np.lexsort((words.hash, number))
    hashes, owner = words.hash[order], number[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[new], minlength=n)
    capitals = inside((data >= 0x41) & (data <= 0x5A))
    points = inside((data & 0xC0) != 0x80)
    fails = [
        words.counts < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * words.counts,
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        inside(_SYMBOL[data]) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


MARKED = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())]
)


def _marked(batches):
    """Rows of each slice by id, part and mask; with the text where a smaller id may be elsewhere."""
    for batch in parts(batches):
        trie, ends = Trie(), []
        ids, texts = batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
        for number, text in zip(ids, texts):
            ends.append(-1 if number is None else trie.insert(text or b"", number))
        rows: dict[tuple, int] = {}
        first: dict[tuple, bytes] = {}
        for number, part, mask, end, text in zip(
            ids, batch["part"].to_pylist(), own_masks(batch["text"]).tolist(), ends, texts
        ):
            if end < 0:
                key = (None, part, mask, -1)
            elif number > trie.least[end]:
                key = (number, part, mask | DUPLICATE, -1)
            else:
                key = (number, part, mask, end)
                first[key] = text or b""
            rows[key] = rows.get(key, 0) + 1
        columns = [*zip(*((*key[:3], n, first.get(key)) for key, n in rows.items()))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, MARKED.types)], schema=MARKED)


def _settled(batches):
    """Marks the rows of a partition whose text has a smaller id; all texts that are equal are here."""
    trie, ends, rest = Trie(), [], []
    for batch in batches:
        for number, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ends.append((number, trie.insert(text, number)))
        # copies, as a column of a received batch holds all of its buffers
        every = pa.array(np.arange(batch.num_rows))
        rest.append(batch.select(["doc_id", "part", "mask", "n"]).take(every))
    at = 0
    for batch in rest:
        repeated = [number > trie.least[end] for number, end in ends[at : at + batch.num_rows]]
        at += batch.num_rows
        mask = batch["mask"].to_numpy() | np.where(repeated, np.int32(DUPLICATE), np.int32(0))
        columns = [batch["doc_id"], batch["part"], pa.array(mask, pa.int32()), batch["n"]]
        yield pa.record_batch(columns, names=batch.schema.names)


def _hashed(values: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64).view(np.int64)


def cut_depths(texts: list[bytes], heavy: list[np.ndarray]) -> np.ndarray:
    """How many times the prefix of each text is cut; ``heavy`` has sorted hashes by level."""
    depth = np.zeros(len(texts), np.int64)
    going, size = np.arange(len(texts)), PREFIX
    for keys in heavy:
        going = going[[len(texts[i]) > size for i in going]] if len(going) else going
        own = _hashed([texts[i][:size] for i in going])
        going = going[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own]
        depth[going] += 1
        size *= LONGER
    return depth


WEIGHTS = "key long, bytes long, longest long, least long, most long"


def _weights(heavy: list[np.ndarray]):
    """Bytes, longest text, and range of hashes of whole texts, of each prefix that may be cut next."""
    size = PREFIX * LONGER ** len(heavy)

    def kernel(batches):
        for batch in parts(batches):
            texts = batch["text"].to_pylist()
            depth = cut_depths(texts, heavy)
            texts = [t for t, d in zip(texts, depth) if d == len(heavy)]
            if not texts:
                continue
            lengths, whole = np.array([len(t) for t in texts], np.int64), _hashed(texts)
            key, slot = np.unique(_hashed([t[:size] for t in texts]), return_inverse=True)
            order = np.argsort(slot, kind="stable")
            head = np.searchsorted(slot[order], np.arange(len(key)))
            columns = [
                key,
                np.add.reduceat(lengths[order], head),
                np.maximum.reduceat(lengths[order], head),
                np.minimum.reduceat(whole[order], head),
                np.maximum.reduceat(whole[order], head),
            ]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "bytes", "longest", "least", "most"])

    return kernel


def _cells(heavy: list[np.ndarray]):
    """Every row with its head and cell; one lookup of its prefix of each level."""

    def kernel(batches):
        for batch in parts(batches):
            texts = batch["text"].to_pylist()
            depth = cut_depths(texts, heavy)
            cell = np.zeros(len(texts), np.int64)
            cut = np.flatnonzero(depth)
            cell[cut] = _hashed([texts[i][: PREFIX * LONGER ** int(depth[i])] for i in cut])
            head = pa.array([t[:PREFIX] for t in texts], pa.binary())
            columns = [*batch.columns, head, pa.array(cell)]
            yield pa.record_batch(columns, names=[*batch.schema.names, "head", "cell"])

    return kernel


def prefix_cells(given: DataFrame, limit: int, most: int = MOST_HEAVY) -> DataFrame:
    """``given`` with ``head``, its text's first bytes, and ``cell``, which cuts heads of over limit bytes.

    A cell is the hash of a longer prefix; equal texts always agree in both. A pass a level
    finds the heavy prefixes, the last one looks a row up in all levels at once. Only hashes
    of heavy prefixes reach the driver and the tasks: at most total bytes / limit a level.
    """
    heavy: list[np.ndarray] = []
    size = PREFIX
    while True:
        weights = given.select("text").mapInArrow(_weights(heavy), WEIGHTS)
        weights = weights.groupBy("key").agg(
            F.sum("bytes").alias("bytes"),
            F.max("longest").alias("longest"),
            (F.min("least") < F.max("most")).alias("several"),
        )
        # a prefix that is the whole text, or one text's only, cannot be cut
        cut = (F.col("bytes") > limit) & (F.col("longest") > size) & F.col("several")
        keys = weights.where(cut).select("key").limit(most + 1).toArrow()["key"].to_numpy()
        if len(keys) > most:
            raise ValueError(f"more than {most} prefixes of over {limit} bytes: raise the limit")
        if not len(keys):
            break
        heavy.append(np.sort(keys))
        size *= LONGER
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(_cells(heavy), f"{kind}, head binary, cell long")


def failures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters."""
    ship_package(docs.sparkSession)
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").alias("text"),
    )
    kind = "doc_id long, part string, mask int, n long, text binary"
    marked = stage(given.mapInArrow(_marked, kind), "marked")
    left = marked.where(F.col("text").isNotNull())
    total = left.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = max(cell_bytes, total // MOST_HEAVY)
    tries = max(8, math.ceil(total / max(TRIE_BYTES, limit)))
    dealt = prefix_cells(left, limit).repartitionByRange(tries, "head", "cell").drop("head", "cell")
    kind = "doc_id long, part string, mask int, n long"
    settled = dealt.mapInArrow(_settled, kind)
    return settled.unionByName(marked.where(F.col("text").isNull()).drop("text"))


def order_tables(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """For each mask and each step of each order (orders sorted): what a row with that mask counts as."""
    masks = np.arange(1 << len(filters))
    kept, removed, redundant, alone, shares = [], [], [], [], []
    bits = np.array([bin(m).count("1") for m in masks])
    for order in permutations(sorted(filters)):
        before = 0
        for letter in order:
            bit = 1 << filters.index(letter)
            fails, gone = masks & bit > 0, masks & before > 0
            kept.append(masks & (before | bit) == 0)
            removed.append(fails & ~gone)
            redundant.append(fails & gone)
            alone.append(masks == bit)
            # of the orders, an equal number has each failed filter first
            shares.append(np.where(fails, math.factorial(len(filters)) // np.maximum(bits, 1), 0))
            before |= bit
    named = {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": alone, "shapley": shares}
    return {name: np.array(rows, np.int64).T for name, rows in named.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _expanded(batches):
    """Every step of every order for each part, from its counts by mask."""
    tables = order_tables()
    orders = ["".join(p) for p in permutations(FILTERS)]
    size, steps = len(FILTERS), len(orders) * len(FILTERS)
    for batch in batches:
        for part, entries in zip(batch["part"].to_pylist(), batch["entries"].to_pylist()):
            n, good, toxic = np.zeros((3, MASKS), np.int64)
            for e in entries:
                n[e["mask"]], good[e["mask"]], toxic[e["mask"]] = e["n"], e["good"], e["toxic"]
            found = {name: n @ table for name, table in tables.items()}
            found |= {"good_lost": good @ tables["removed"], "toxic_lost": toxic @ tables["removed"]}
            yield pa.record_batch(
                [
                    pa.array([part] * steps, pa.string()),
                    pa.array(np.repeat(orders, size)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders))),
                    *(pa.array(found[c]) for c in COUNTS),
                ],
                names=["part", "filter_order", "step", *COUNTS],
            )


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order, for every part."""
    marks = failures(docs, doc_id, text, part)
    # counted before the join: an id that many rows have is one row a task
    marks = marks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.select(
        F.col("doc_id").cast("long").alias("label_id"),
        (F.col("quality") == 1).cast("int").alias("good"),
        (F.col("toxic") == 1).cast("int").alias("toxic"),
    )
    said = said.groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = marks.join(said, F.col("doc_id") == F.col("label_id"), "left")
    by_mask = joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )
    # at most one entry a mask
    by_part = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    kind = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return by_part.mapInArrow(_expanded, kind)
