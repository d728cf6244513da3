"""Packing token pieces into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (one count for each length up to the sequence size)
comes to the driver. There a few-document pattern is a combination of lengths that fills a
sequence; non-negative least squares fits how often each pattern repeats to the
histogram; the fit is rounded down to what the histogram has, and the residual is packed
largest first. The plan, some rows for each length, is broadcast, and each piece finds its
sequence from its rank among the pieces of its length. Ranks come from counts by length
and salt, so a length that a third of the pieces have is not ranked by one task.

Token ids are those of the tokenizer for the whole text. Its words repeat, so a worker
encodes a distinct stretch (white space and the word after it) once, while it is in the
worker's cache of some megabytes, and joins the ids; token borders never lie elsewhere,
because white space starts a new pre-token. Texts with rarer white space are encoded whole.

With ``added`` a text's literal added tokens (such as ``<|endoftext|>``) get their own ids,
as the tokenizer gives them when called with ``add_special_tokens=False`` and nothing else
set; texts that hold one are encoded whole. The registered query and the pipeline do so.
Without it such text is encoded as ordinary characters.

Defined cases: a null text is empty and is the one token that ends a document; equal rows
are packed each; a null doc_id stays null; an empty table gives an empty result; columns
other than id and text are left behind.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytide.llm.common import texts
from daytide.llm.words import Words, mixed, parts
from daytide.session import stage

SIZE = 2048
END = 0
#: White space that the tokenizer's pattern knows beside ASCII's.
RARE_SPACE = "[\x85\xa0  -     　]"
LONGEST_GAP = 16
#: Stretches in a worker's cache, some 30 bytes each, and bytes of the texts that it encodes at a time.
CACHED = 400_000
SLICE = 1 << 20
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Token ids of whole texts, with a bounded cache of the stretches met so far."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values() if added else ()
        self.added = [t.content for t in tokens]
        names = (self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size()))
        self.width = np.array([len(n or "") for n in names], np.int64)  # bytes of each token
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys, begins, ends, data):
        """Encode distinct stretches, joined to longer strings that split between them."""
        bare = data[begins] > 0x20  # at the start of a text, without white space
        pieces = [(b"\n" if n else b"") + data[a:b].tobytes() for a, b, n in zip(begins, ends, bare)]
        strings, held = [], 0
        for at, piece in enumerate(pieces):
            if not held:
                strings.append([])
            strings[-1].append(piece)
            held = held + len(piece) if held < 1 << 15 else 0
        encoded = self.tokenizer.encode_batch_fast(
            [b"".join(s).decode() for s in strings], add_special_tokens=False
        )
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        lengths = np.array([len(p) for p in pieces])
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, np.cumsum(lengths)) + 1
        first = np.append(0, last[:-1]) + bare  # without the line feed put before
        # keys are sorted, as the cached ones are: each array is merged by itself
        place = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, place, (first + len(self.ids)).astype(np.uint32))
        self.count = np.insert(self.count, place, (last - first).astype(np.uint32))
        self.keys = np.insert(self.keys, place, keys)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column."""
        words = Words(column)
        data, n = words.data, len(words.begin)
        number = words.text_number()
        begin = np.empty(n, np.int64)
        begin[1:] = words.end[:-1]
        heads = words.first[:-1][words.counts > 0]
        begin[heads] = words.offsets[:-1][words.counts > 0]
        gap = words.begin - begin
        space = gap.astype(np.uint64)
        for j in range(min(LONGEST_GAP, int(gap.max(initial=0)))):
            here = np.flatnonzero(gap > j)
            space[here] = space[here] * np.uint64(257) + data[begin[here] + j]
        keys = mixed(words.hash + mixed(space + np.uint64(1)))
        odd = np.zeros(len(words.counts), bool)
        odd[number[gap > LONGEST_GAP]] = True
        rare = pc.match_substring_regex(column, RARE_SPACE)
        for content in self.added:
            rare = pc.or_kleene(rare, pc.match_substring(column, content))
        odd |= pc.fill_null(rare, False).to_numpy(zero_copy_only=False)
        usable = ~odd[number]
        wanted, at = np.unique(keys[usable], return_index=True)
        at = np.flatnonzero(usable)[at]
        new = self._missing(wanted)
        if len(new):
            if len(self.keys) + len(new) > CACHED:  # start the cache anew
                new = np.arange(len(wanted))
                self._forget()
            self._learn(wanted[new], begin[at[new]], words.end[at[new]], data)
        place = np.searchsorted(self.keys, keys)
        out = []
        for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            if odd[row]:
                out.append(self.whole(column[row].as_py()))
                continue
            where = place[a:b]
            count = self.count[where].astype(np.int64)
            total = int(count.sum())
            move = np.repeat(self.start[where] - np.cumsum(count) + count, count)
            ids = self.ids[move + np.arange(total)]
            tail = int(words.end[b - 1] if b > a else words.offsets[row])
            rest = data[tail : words.offsets[row + 1]].tobytes()
            out.append(np.concatenate([ids, self.whole(rest.decode())]) if rest else ids)
        return out

    def _missing(self, keys):
        if not len(self.keys):
            return np.arange(len(keys))
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[near] != keys)


def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's encoder; it outlives a task."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def piece_lengths(total: int, size: int) -> list[int]:
    """A document that fits is one piece; a longer one is full pieces after a shorter first."""
    if total <= size:
        return [total]
    rest = total % size
    return [rest] * (rest > 0) + [size] * (total // size)


PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def _cut(path: str, size: int, with_ids: bool, added: bool):
    def kernel(batches):
        own = encoder(path, added)
        end = np.array([END], np.uint32)
        for batch in parts(batches, limit=SLICE):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), own.encode(batch["text"])):
                ids = np.concatenate([ids, end]).astype("<u4")
                at = 0
                for piece, length in enumerate(piece_lengths(len(ids), size)):
                    part = ids[at : at + length]
                    rows.append((doc, piece, at, length, zlib.crc32(part.tobytes()), part if with_ids else None))
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), PIECE.types)], schema=PIECE
            )
            # other workers stand beside this one: what was freed goes back to the system
            pa.default_memory_pool().release_unused()

    return kernel


def pieces(
    docs: DataFrame, tokenizer: str, size: int = SIZE, doc_id="doc_id", text="text", with_ids=False, added=False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's pieces of at most size tokens."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return texts(docs, doc_id, text).mapInArrow(_cut(tokenizer, size, with_ids, added), kind)


# --- the plan, from the histogram alone ---------------------------------------------


def enumerate_patterns(counts: np.ndarray, size: int, tries: int = 6) -> list[tuple[int, ...]]:
    """Combinations of up to five present lengths that fill a sequence, largest length first."""
    present = np.flatnonzero(counts[: size + 1])
    have = np.zeros(size + 1, bool)
    have[present] = True
    below = np.maximum.accumulate(np.where(have, np.arange(size + 1), 0))  # largest present up to here
    found = set()
    for first in present[::-1]:
        # several second lengths, spread over those that fit, completed with the closest fits
        fits = present[: np.searchsorted(present, size - first, "right")]
        picks = {int(below[size - first])} | {int(x) for x in fits[:: max(1, len(fits) // tries)]}
        for second in sorted(picks - {0}, reverse=True) or [0]:
            pattern, room = [int(first)], size - int(first)
            step = second
            while step and len(pattern) < 5:
                pattern.append(step)
                room -= step
                step = int(below[room])
            found.add(tuple(sorted(pattern, reverse=True)))
    full = [p for p in found if sum(p) >= size - size // 128]
    return sorted(full)


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats whose use of each length is closest to its count (projected gradient)."""
    if not patterns:
        return np.zeros(0)
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.concatenate([np.array(p) for p in patterns])
    n = len(counts)
    scale = 1 / np.maximum(np.bincount(length, minlength=n), 1)  # of each row, by how many patterns use it
    x = np.zeros(len(patterns))
    y, momentum = x, 1.0
    reach = np.bincount(owner, scale[length], len(patterns))
    for _ in range(rounds):
        miss = counts - np.bincount(length, y[owner], n)
        step = np.bincount(owner, (miss * scale)[length], len(patterns)) / (reach * 5)
        after = np.maximum(y + step, 0)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, x, momentum = after + (momentum - 1) / grown * (after - x), after, grown
        y = np.maximum(y, 0)
    return x


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []

    def use(pattern, repeats):
        if repeats > 0:
            out.append((pattern, int(repeats)))
            for length, times in Counter(pattern).items():
                left[length] -= times * repeats

    use((size,), left[size])
    patterns = enumerate_patterns(left, size)
    repeats = np.floor(fit_repeats(patterns, left) + 1e-9).astype(np.int64)
    for at in np.argsort(-repeats, kind="stable"):
        pattern = patterns[at]
        most = min(left[length] // times for length, times in Counter(pattern).items())
        use(pattern, min(repeats[at], most))
    # residual: the largest left, then whatever fits best, as often as the counts allow
    while left.any():
        pattern, room, spare = [], size, left.copy()
        while True:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            take = int(fits[-1])
            pattern.append(take)
            room -= take
            spare[take] -= 1
        use(tuple(pattern), min(left[length] // times for length, times in Counter(pattern).items()))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for each place in each pattern."""
    taken, sequence, out = [0] * (size + 1), 0, []
    for pattern, repeats in planned:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + repeats, sequence, offset))
            taken[length] += repeats
            offset += length
        sequence += repeats
    return out


def place(cut: DataFrame, size: int = SIZE, rows_a_salt: int = 200_000) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` is read twice: give a written table."""
    spark = cut.sparkSession
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(size + 1, np.int64)
    for length, n in by_length.items():
        counts[length] = n
    table = spark.createDataFrame(
        slots(plan(counts, size), size), "length long, low long, high long, sequence long, offset long"
    )
    salts = max(16, int(counts.sum()) // rows_a_salt)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    # at most some places for each length: bounded by the sequence size
    p, s = ranked.alias("p"), F.broadcast(table).alias("s")
    found = p.join(s, F.expr("p.length = s.length AND p.rank >= s.low AND p.rank < s.high"))
    own = [F.col(f"p.{c}") for c in cut.columns]
    return found.select(*own, F.expr("s.sequence + p.rank - s.low").alias("sequence_id"), F.col("s.offset"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    doc_id: str = "doc_id",
    text: str = "text",
    added: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = pieces(docs, tokenizer, size, doc_id, text, added=added).drop("ids")
    return place(stage(cut, "pieces"), size)


def sequences(
    docs: DataFrame,
    tokenizer: str,
    size: int = SIZE,
    doc_id: str = "doc_id",
    text: str = "text",
    added: bool = False,
) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves, for writing."""
    cut = pieces(docs, tokenizer, size, doc_id, text, with_ids=True, added=added)
    placed = place(stage(cut, "pieces"), size)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
