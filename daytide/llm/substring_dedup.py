"""Substring deduplication by relative Lempel-Ziv parsing.

The documents are dealt into blocks of bounded size, by id and text. Every block is indexed as reference
text: each distinct window of ``window`` words, by hash, with its earliest place. The
index is spread over hash shards, so a block meets every other block without a pair of
blocks ever being formed, and a window that a third of the documents share is one entry a
block. A shard answers each block with the earliest place of those of its windows that
start in a document with a smaller id.

Each document is then parsed from left to right against all blocks at once: at a word the
pointer of its window gives the reference text, and the factor grows for as long as
the pointers move on with the document. A window that straddles the end of a factor has a
pointer of its own, which starts the next factor; so what one factor misses at its
boundary is still found. Words that a factor covers are duplicate; the others are
literals.

Windows are compared by 64-bit hashes of 64-bit word hashes.

Defined cases: a null text has no words; a document of fewer words than a window has no
factor; a null doc_id is smaller than every other; rows with one doc_id never remove each
other's words, and each gives a row (equal rows share a block); an empty table gives an empty result; columns other
than id and text are left behind.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.llm.common import NO_ID, group_count, pack, texts, unpack
from daytide.llm.words import Words

BLOCK_MB = 8.0
FACTORS = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"


def _block(table: pa.Table):
    """Ids, texts and words of a block, documents in ascending order.

    Places are word numbers in a block, and two passes make them from rows that arrive in
    any order; so rows of one id are in order of their texts.
    """
    by = [("doc_id", "ascending"), ("text", "ascending")]
    order = pc.sort_indices(table, by, null_placement="at_start")
    table = table.take(order)
    ids = pc.fill_null(table["doc_id"], NO_ID).to_numpy().astype(np.int64)
    return ids, table["text"], Words(table["text"])


def _windows(words: Words, n: int):
    """Places, hashes and representatives (earliest equal window) of the whole windows."""
    hashes, inside = words.windows(n)
    at = np.flatnonzero(inside)
    hashes = hashes[at]
    distinct, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    return at, distinct, first, same


def _index(n: int, shards: int):
    def kernel(table: pa.Table) -> pa.Table:
        ids, _, words = _block(table)
        block = table["block"][0].as_py()
        at, distinct, first, _ = _windows(words, n)
        number = words.text_number()
        shard = (distinct % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((first, shard))
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(part):
                continue
            place = at[first[part]]
            texts_, count = np.unique(number[place], return_counts=True)
            value = pack(place.astype(np.int32), ids[texts_], words.first[texts_].astype(np.int32))
            value = pack(np.frombuffer(value, np.uint8), np.cumsum(count).astype(np.int32))
            rows.append((int(shard[part[0]]), block, distinct[part].tobytes(), value))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table(dict(zip(("shard", "block", "hashes", "places"), columns)), INDEX)

    return kernel


INDEX = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("pointers", pa.binary())])


def _match(table: pa.Table) -> pa.Table:
    """Earliest place of every window of a shard, told to the blocks that have a later one."""
    hashes, docs, starts, places, owners = [], [], [], [], []
    for row, (raw, value) in enumerate(zip(table["hashes"].to_pylist(), table["places"].to_pylist())):
        inner, upto = unpack(value, np.uint8, np.int32)
        place, ids, first = unpack(inner.tobytes(), np.int32, np.int64, np.int32)
        count = np.diff(upto, prepend=np.int32(0))
        hashes.append(np.frombuffer(raw, np.uint64))
        docs.append(np.repeat(ids, count))
        starts.append(place - np.repeat(first, count))
        places.append(place)
        owners.append(np.full(len(place), row, np.int32))
    hashes, docs, starts, places, owners = map(np.concatenate, (hashes, docs, starts, places, owners))
    order = np.lexsort((starts, docs, hashes))
    head = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    later = np.flatnonzero(docs[earliest] < docs)
    rows = []
    blocks = table["block"].to_pylist()
    for part in np.split(later, np.flatnonzero(np.diff(owners[later])) + 1):
        if len(part):
            ref = earliest[part]
            rows.append((blocks[owners[part[0]]], pack(places[part], docs[ref], starts[ref])))
    columns = list(zip(*rows)) if rows else [()] * 2
    return pa.table(dict(zip(ANSWER.names, columns)), ANSWER)


def _parse(n: int):
    def kernel(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        ids, column, words = _block(table)
        at, _, first, same = _windows(words, n)
        number = words.text_number()
        own = ids[number[at]] if len(at) else np.zeros(0, np.int64)
        ref_doc, ref_start = own.copy(), (at - words.first[number[at]]).astype(np.int64)
        for value in answers["pointers"].to_pylist():
            place, docs, starts = unpack(value, np.int32, np.int64, np.int32)
            window = np.searchsorted(at, place)
            ref_doc[window], ref_start[window] = docs, starts
        if len(at):
            ref_doc, ref_start = ref_doc[first[same]], ref_start[first[same]]
        hit = np.flatnonzero(ref_doc < own)
        place, doc, start = at[hit], ref_doc[hit], ref_start[hit]
        moves_on = np.zeros(len(hit), bool)
        moves_on[1:] = (
            (np.diff(place) == 1)
            & (np.diff(doc) == 0)
            & (np.diff(start) == 1)
            & (number[place[1:]] == number[place[:-1]])
        )
        head = np.flatnonzero(~moves_on)
        length = np.diff(np.append(head, len(hit))) + n - 1
        cover = np.zeros(len(words.hash) + 1, np.int32)
        np.add.at(cover, place[head], 1)
        np.add.at(cover, place[head] + length, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept, removed = [], []
        for text, a, b in zip(column.to_pylist(), words.first[:-1], words.first[1:]):
            parts = (text or "").encode().split()
            gone = int(b - a - np.count_nonzero(keep[a:b]))
            kept.append(b" ".join(compress(parts, keep[a:b]) if gone else parts).decode())
            removed.append(gone)
        owner = number[place[head]]
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
        factors = pa.StructArray.from_arrays(
            [
                pa.array(place[head] - words.first[owner], pa.int32()),
                pa.array(length, pa.int32()),
                pa.array(doc[head], pa.int64(), mask=doc[head] == NO_ID),
                pa.array(start[head], pa.int32()),
            ],
            fields=list(FACTOR),
        )
        return pa.table(
            [
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(words.counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.ListArray.from_arrays(pa.array(bounds), factors),
            ],
            schema=RESULT,
        )

    return kernel


FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
        ("factors", pa.list_(FACTOR)),
    ]
)


def _dealt(kept: DataFrame, blocks: int) -> DataFrame:
    """Block, id and text of every row; rows of one id, or of none, go to many blocks."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return kept.select(block.alias("block"), "doc_id", "text")


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 13,
    block_mb: float = BLOCK_MB,
) -> DataFrame:
    """Documents without the words that windows of earlier documents already have.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the
    factors (word start and length in the document, place of the reference text).
    ``block_mb`` bounds a block; it changes speed, not the result.
    """
    kept = texts(docs, doc_id, text)
    blocks = group_count(kept, "text", block_mb)
    dealt = _dealt(kept, blocks).groupBy("block")
    index = dealt.applyInArrow(_index(window, blocks), "shard int, block int, hashes binary, places binary")
    answers = index.groupBy("shard").applyInArrow(_match, "block int, pointers binary")
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(
        _parse(window),
        f"doc_id long, n_words long, n_removed long, kept_text string, factors {FACTORS}",
    )
