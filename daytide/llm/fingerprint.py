"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each place, the polynomial hash of the code points before
it, modulo two primes. The hash of any span follows from two entries, so spans compare in
constant time, and the longest common extension of two places is found by binary search,
because spans that start together are equal up to some length and then never again.

The fingerprint holds the hash of the whole text, its length, and the ``KEPT`` smallest
hashes of its spans of ``SPAN`` code points, all read off the prefix array. The common
share of the smallest of two such sets estimates the share of spans that two texts have in
common (the Dice coefficient), wherever these stand; equal texts have equal fingerprints.

Each document is also compared with the one of the next doc_id. For that the rows are
dealt into ranges of doc_id, found from the ids alone; the first row of each range is
also given to the range before it, so every task has what follows its last row.

Defined cases: a null text is empty; the fingerprint of an empty text has no spans, is
alike (1) only to that of an empty text; a null doc_id comes before all others; rows with
one doc_id follow each other in order of text; a single document is its own next one; an
empty table gives an empty result; columns other than id and text are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.llm.common import NO_ID, texts
from daytide.llm.words import mixed

PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
BASES = (np.uint64(1_103_515_245), np.uint64(747_796_405))
SPAN = 16
KEPT = 64
#: Texts below SHORT code points are compared by narrow spans, kept for those below twice that.
NARROW = 4
SHORT = 64
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES]


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 modulo the prime, and their inverses, by doubling."""
    up, down = _powers[which]
    prime, base = PRIMES[which], int(BASES[which])
    while len(up) < n:
        step = pow(base, len(up), int(prime))
        back = pow(step, -1, int(prime))
        up = np.concatenate([up, up * np.uint64(step) % prime])
        down = np.concatenate([down, down * np.uint64(back) % prime])
        _powers[which] = [up, down]
    return up[:n], down[:n]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Prefix hash arrays of one text, given by its code points.

    A text that begins like another one (``like``, ``alike`` code points) takes over that
    part of its arrays.
    """

    def __init__(self, points: np.ndarray, like: Prefixes | None = None, alike: int = 0):
        self.n = n = len(points)
        self.sums, self.downs = [], []
        rest = points[alike:].astype(np.uint64) + np.uint64(1)
        for which, prime in enumerate(PRIMES):
            up, down = powers(n + 1, which)
            # terms are below 2**31, so sums of 2**32 of them fit before they are reduced
            terms = rest * up[alike:n] % prime
            if like is None:
                known = np.zeros(1, np.uint64)
            else:
                known = like.sums[which][: alike + 1]
                terms[:1] += known[-1]
            self.sums.append(np.concatenate([known, np.cumsum(terms, dtype=np.uint64) % prime]))
            self.downs.append(down)
        self.width = min(SPAN, n)
        if like is not None and like.width == self.width:
            same = max(0, min(alike - self.width + 1, len(like.small)))
            fresh = self.spans(np.arange(same, n - self.width + 1), self.width)
            self.small = np.concatenate([like.small[:same], fresh])
        else:
            self.small = self.spans(np.arange(n - self.width + 1), self.width)

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length that begin at ``starts``."""
        out = np.zeros(len(starts), np.uint64)
        for prime, sums, down in zip(PRIMES, self.sums, self.downs):
            part = (sums[starts + length] + prime - sums[starts]) % prime * down[starts] % prime
            out = (out << np.uint64(31)) | part
        return out

    def span(self, start: int, length: int) -> int:
        """The hash of one span."""
        out = 0
        for prime, sums, down in zip(PRIMES, self.sums, self.downs):
            part = (int(sums[start + length]) - int(sums[start])) * int(down[start])
            out = out << 31 | part % int(prime)
        return out


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common prefix of a from i and b from j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def fingerprint(prefixes: Prefixes) -> str:
    """length-whole hash-smallest span hashes-narrow ones of a short text, in hexadecimal."""
    n = prefixes.n
    head = f"{n:x}-{prefixes.span(0, n):016x}-"
    if not n:
        return head + "-"
    narrow = np.zeros(0, np.uint64)
    if n < 2 * SHORT:
        width = min(NARROW, n)
        narrow = np.unique(mixed(prefixes.spans(np.arange(n - width + 1), width)))[:KEPT]
    hashes = mixed(prefixes.small)
    share = 2 * KEPT
    while True:  # repeats among the smallest ones ask for a larger share
        few = np.unique(np.partition(hashes, share)[:share] if share < len(hashes) else hashes)
        if len(few) >= KEPT or share >= len(hashes):
            break
        share *= 4
    return head + "-".join(h.astype(">u8").tobytes().hex() for h in (few[:KEPT], narrow))


def likeness(one: str, two: str) -> float:
    """Estimated Dice coefficient of the span sets of two fingerprints; 1 for equal ones."""
    if one == two:
        return 1.0
    parts = [f.split("-") for f in (one, two)]
    short = min(int(p[0], 16) for p in parts) < SHORT and all(p[3] for p in parts)
    a, b = (np.frombuffer(bytes.fromhex(p[3 if short else 2]), ">u8") for p in parts)
    union = np.union1d(a, b)[:KEPT]
    if not len(union):
        return 0.0
    both = np.intersect1d(np.intersect1d(union, a, assume_unique=True), b, assume_unique=True)
    jaccard = len(both) / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first ones of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
    "common_edited": pa.int64(),
    "common_next": pa.int64(),
}


def _against_next(own, following) -> tuple:
    _, doc, text, prefixes, mark = own
    changed = edited(text, following[2])
    if changed == text:
        other, changed_mark = prefixes, mark
    else:
        other = Prefixes(points_of(changed), prefixes, len(text) - len(text) // 4)
        changed_mark = fingerprint(other)
    return (
        None if doc == NO_ID else doc,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        mark,
        changed_mark,
        likeness(mark, changed_mark),
        likeness(mark, following[4]),
        common_extension(prefixes, 0, other, 0),
        common_extension(prefixes, 0, following[3], 0),
    )


def _compare(batches):
    """Rows by range and document; the tail row of a range is the first row of the next one."""
    last, tail, out = None, False, []
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("block", "tail", "doc_id", "text"))
        for block, is_tail, doc, text in zip(*columns):
            if last is not None and last[0] == block and tail:
                continue  # the tail came before
            prefixes = Prefixes(points_of(text))
            now = (block, doc, text, prefixes, fingerprint(prefixes))
            if last is not None and last[0] == block:
                out.append(_against_next(last, now))
            last, tail = now, is_tail
            if len(out) >= 500:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), RESULT.values())], names=list(RESULT))


def _lowest(cuts: np.ndarray):
    """The smallest doc_id of each range in a batch."""

    def kernel(batches):
        for batch in batches:
            ids = np.sort(batch["doc_id"].to_numpy())
            if len(ids):
                blocks, at = np.unique(np.searchsorted(cuts, ids, "right"), return_index=True)
                yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(ids[at])], names=["block", "doc_id"])

    return kernel


def _dealt(cuts: np.ndarray, before: dict[int, int]):
    """Rows with their range; the first document of a range is also the tail of the one before."""

    def kernel(batches):
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            blocks = np.searchsorted(cuts, ids, "right")
            again = [i for i, doc in enumerate(ids.tolist()) if doc in before]
            tails = [before[int(ids[i])] for i in again]
            rows = pa.array(np.concatenate([np.arange(len(ids)), np.array(again, np.int64)]))
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([blocks, np.array(tails, np.int64)]), pa.int64()),
                    pa.array(np.arange(len(rows)) >= len(ids)),
                    batch["doc_id"].take(rows),
                    batch["text"].take(rows),
                ],
                names=["block", "tail", "doc_id", "text"],
            )

    return kernel


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges_a_partition: int = 8) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how like they and the next one's are.

    common_edited and common_next are exact: the code points that the texts begin with alike.
    """
    spark = docs.sparkSession
    given = texts(docs, doc_id, text).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    # ranges follow the number of shuffle partitions; the driver holds two ids for each
    count = int(spark.conf.get("spark.sql.shuffle.partitions")) * ranges_a_partition
    steps = [i / count for i in range(1, count)] or [0.5]
    found = given.agg(F.percentile_approx("doc_id", steps, 20 * count).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], np.int64))
    lowest = given.select("doc_id").mapInArrow(_lowest(cuts), "block long, doc_id long")
    lowest = {r[0]: r[1] for r in lowest.groupBy("block").agg(F.min("doc_id")).collect()}
    filled = sorted(lowest)
    before = {lowest[block]: filled[i - 1] for i, block in enumerate(filled)}  # the first one follows the last
    dealt = given.mapInArrow(_dealt(cuts, before), "block long, tail boolean, doc_id long, text string")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "tail", "doc_id", F.xxhash64("text"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return ordered.mapInArrow(_compare, ", ".join(f"{n} {kinds[t]}" for n, t in RESULT.items()))
