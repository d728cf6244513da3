"""What several operators of this package share: document frames, sizes, packed arrays."""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.session import ship_package

#: Stands for a missing doc_id inside kernels; such documents come before all others.
NO_ID = -(2**63)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of a document frame; every other column is left behind."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def group_count(docs: DataFrame, text: str, megabytes: float) -> int:
    """Number of groups of about that many MB of text each; one aggregate over the table."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / (megabytes * 1e6)))


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length each as one compressed value; ascending ones get small."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    body = b"".join(np.diff(a, prepend=a.dtype.type(0)).tobytes() for a in arrays)
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(value: bytes, *kinds) -> list[np.ndarray]:
    """The arrays that pack() was given, by their dtypes."""
    lengths = np.frombuffer(value, "<i8", len(kinds))
    body, at, out = zstandard.ZstdDecompressor().decompress(value[8 * len(kinds) :]), 0, []
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        part = np.frombuffer(body, kind, int(n), at)
        out.append(np.cumsum(part, dtype=kind))
        at += part.nbytes
    return out
