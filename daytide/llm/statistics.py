"""Statistics of whole texts, as columns: what a text looks like, not what it is about."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daytide.llm.common import texts
from daytide.llm.words import Words, parts

NAMES = [
    "log_bytes",
    "log_words",
    "word_bytes",
    "long_words",
    "upper",
    "digits",
    "spaces",
    "lines",
    "line_words",
    "marks",
    "ends",
    "bars",
    "bangs",
    "symbols",
    "high_bytes",
    "distinct_words",
    "top_word",
    "repeated_pairs",
    "repeated_fives",
    "repeated_lines",
    "capital_words",
]

_LINES = np.zeros(256, bool)
_LINES[[0x0A, 0x0D]] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "upper": _class(bytes(range(0x41, 0x5B))),
    "digits": _class(b"0123456789"),
    "spaces": _class(b" \t"),
    "marks": _class(b".,;:!?\"'()-"),
    "ends": _class(b".?"),
    "bars": _class(b"|"),
    "bangs": _class(b"!"),
    "symbols": _class(b"#$%&*+/<=>@[\\]^_`{}~"),
    "high_bytes": _class(bytes(range(0x80, 0x100))),
}


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: values, distinct values, and the count of the most frequent one."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    head = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(o) != 0))) if len(h) else np.zeros(0, int)
    runs = np.diff(np.append(head, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[head], runs)
    return np.bincount(owner, minlength=n), np.bincount(o[head], minlength=n), top


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text; those of an empty text are 0."""
    words = Words(column, lower=True)
    data, offsets, n = words.data, words.offsets, len(words.first) - 1
    size, count = np.diff(offsets), words.counts
    some, any_words = np.maximum(size, 1), np.maximum(count, 1)
    number = words.text_number()
    length = words.end - words.begin
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count)}
    out["word_bytes"] = np.bincount(number, length, n) / any_words
    out["long_words"] = np.bincount(number, length > 12, n) / any_words
    for name, members in CLASSES.items():
        upto = np.append(0, np.cumsum(members[data], dtype=np.int64))
        out[name] = np.diff(upto[offsets]) / some
    _, distinct, top = _repeats(words.hash, number, n)
    out["distinct_words"] = distinct / any_words
    out["top_word"] = top / any_words
    for name, width in (("repeated_pairs", 2), ("repeated_fives", 5)):
        hashes, inside = words.windows(width)
        total, kinds, _ = _repeats(hashes[inside], number[: len(hashes)][inside], n)
        out[name] = 1 - kinds / np.maximum(total, 1)
        out[name][total == 0] = 0
    lines = Words(column, separator=_LINES)
    total, kinds, _ = _repeats(lines.hash, lines.text_number(), n)
    out["lines"] = np.log1p(total)
    out["line_words"] = count / np.maximum(total, 1)
    out["repeated_lines"] = np.where(total > 0, 1 - kinds / np.maximum(total, 1), 0)
    capital = CLASSES["upper"][data[words.begin]] & CLASSES["upper"][data[np.maximum(words.end - 1, 0)]]
    shouted = capital | (CLASSES["upper"][data[words.begin]] & CLASSES["upper"][data[np.minimum(words.begin + 1, max(0, len(data) - 1))]])
    out["capital_words"] = np.bincount(number, shouted & (length > 1), n) / any_words
    return {name: out[name].astype(np.float64) for name in NAMES}


def _kernel(batches):
    for batch in parts(batches):
        found = statistics(batch["text"])
        yield pa.record_batch([batch["doc_id"], *map(pa.array, found.values())], names=["doc_id", *NAMES])


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text."""
    return texts(docs, doc_id, text).mapInArrow(_kernel, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))
