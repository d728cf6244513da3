"""Exact interpolated quantiles of few, very large groups.

The built-in exact ``percentile`` merges every distinct value of a group in one task, so
one global group of a large table does not fit. Here each wanted rank is found by the
digits of its value:

1. a double is read as 64 bits in an order that agrees with that of the numbers. A pass
   counts the values of each group by their leading digit, and the running counts tell
   which digit holds the rank;
2. the next pass counts the values that begin so by their next digit, until what is left
   has at most ``rank_rows`` values, or one value;
3. these are counted by value and ordered.

Every pass is one aggregate of counts, combined map-side; nothing is estimated, no sketch
is merged, and no task orders more than ``rank_rows`` different values or one digit's
choices, however large a group is. The driver holds some numbers for each group and rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytide.session import ship_package

BITS = 64

#: Leading bits that a pass shared with other summaries has counted already.
BEGUN_BITS = 16


@dataclass
class Begun:
    """A first pass made elsewhere: keys, ``n`` and ``rows`` of each group; (keys, _d, _c, _low, _high)."""

    sizes: list
    counts: DataFrame


@dataclass
class _Rank:
    keys: tuple
    group: int
    name: str
    position: float  # fractional rank, from 0
    upper: bool  # of the two ranks around the position
    rest: int  # rank among the values that begin with the prefix
    prefix: int = 0
    inside: int = 0
    one_value: bool = False


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; -0 is 0."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << (BITS - 1))
    return np.where(bits >= top, ~bits, bits | top)


@dataclass
class _Slots:
    """The (group, prefix) pairs that hold a rank, numbered; prefixes have ``done`` bits."""

    done: int
    prefixes: np.ndarray  # distinct, ascending
    codes: np.ndarray  # group * prefixes + place of the prefix, ascending

    @staticmethod
    def of(ranks: list[_Rank], done: int) -> tuple[_Slots, list[int]]:
        """The slots, and the slot of each rank."""
        prefixes = np.unique(np.array([r.prefix for r in ranks], np.uint64))
        place = np.searchsorted(prefixes, np.array([r.prefix for r in ranks], np.uint64))
        code = np.array([r.group for r in ranks], np.int64) * len(prefixes) + place
        codes, slot = np.unique(code, return_inverse=True)
        return _Slots(done, prefixes, codes), slot.tolist()

    def of_values(self, group: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Slot of each value, -1 where no rank is."""
        top = bits >> np.uint64(BITS - self.done) if self.done else np.zeros_like(bits)
        place = np.minimum(np.searchsorted(self.prefixes, top), len(self.prefixes) - 1)
        code = group.astype(np.int64) * len(self.prefixes) + place
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.prefixes[place] == top) & (self.codes[slot] == code), slot, -1)


def _counted(slots: _Slots, bits: int):
    """(slot, digit, count, lowest, highest value) of each batch; by value where bits is 0."""

    def kernel(batches):
        for batch in batches:
            x = batch["_x"].to_numpy() + 0.0
            key = ordered_bits(x)
            slot = slots.of_values(batch["_g"].to_numpy(), key)
            inside = np.flatnonzero(slot >= 0)
            inside = inside[np.lexsort((key[inside], slot[inside]))]
            if not len(inside):
                continue
            slot, key, x = slot[inside], key[inside], x[inside]
            if bits:
                digit = (key >> np.uint64(BITS - slots.done - bits)) & np.uint64((1 << bits) - 1)
            else:
                digit = key
            new = np.ones(len(slot), bool)
            new[1:] = (slot[1:] != slot[:-1]) | (digit[1:] != digit[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(slot)) - 1
            shown = digit[first].astype(np.int64) if bits else np.zeros(len(first), np.int64)
            yield pa.record_batch(
                [pa.array(c) for c in (slot[first].astype(np.int32), shown, last - first + 1, x[first], x[last])],
                names=["_s", "_d", "_c", "_low", "_high"],
            )

    return kernel


def _values(key: np.ndarray) -> np.ndarray:
    """The doubles that ``ordered_bits`` gave."""
    top = np.uint64(1 << (BITS - 1))
    return np.where(key >= top, key ^ top, ~key).view(np.float64)


def _counted_columns(slots: _Slots, bits: int, groups: list[int]):
    """As ``_counted`` of wide rows, column i being the group ``groups[i]``, none if it is -1.

    A column is sorted, and what begins with a prefix is a run of it.
    """
    of_group: dict[int, list[tuple[int, int, int]]] = {}
    shift = BITS - slots.done
    for slot, code in enumerate(slots.codes.tolist()):
        group, place = divmod(code, len(slots.prefixes))
        prefix = int(slots.prefixes[place])
        of_group.setdefault(group, []).append((slot, prefix << shift, (prefix + 1 << shift) - 1))

    def kernel(batches):
        for batch in batches:
            out = []
            for group, column in zip(groups, batch.columns):
                known = column.drop_null().to_numpy(zero_copy_only=False) if group >= 0 else ()
                if not len(known):
                    continue
                key = np.sort(ordered_bits(known))
                for slot, low, high in of_group.get(group, ()):
                    a = int(np.searchsorted(key, np.uint64(low)))
                    own = key[a : int(np.searchsorted(key, np.uint64(high), "right"))]
                    if not len(own):
                        continue
                    digit = (own >> np.uint64(shift - bits)) & np.uint64((1 << bits) - 1) if bits else own
                    first = np.flatnonzero(np.concatenate(([True], digit[1:] != digit[:-1])))
                    last = np.append(first[1:], len(own)) - 1
                    shown = digit[first].astype(np.int64) if bits else np.zeros(len(first), np.int64)
                    named = np.full(len(first), slot, np.int32)
                    out.append((named, shown, last - first + 1, _values(own[first]), _values(own[last])))
            if out:
                yield pa.record_batch(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], names=["_s", "_d", "_c", "_low", "_high"]
                )

    return kernel


def _upto(counted: DataFrame, by: str) -> DataFrame:
    """Running counts of a slot along ``by``."""
    along = Window.partitionBy("_s").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_upto", F.sum("_c").over(along))


#: Whether a row of running counts holds a rank.
HOLDS = "_upto > _rest AND _upto - _c <= _rest"


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 65_536,
    rank_rows: int = 20_000,
    max_groups: int = 10_000,
    positions: Callable[[int, int], dict[str, float]] | None = None,
    begun: Begun | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """One row per group: keys, ``n`` and one linearly interpolated quantile per name.

    ``positions`` may give other fractional ranks (from 0) for the names in ``probs``, from the
    number of known values of the group and the number of its rows. A pass tells at least
    ``accuracy`` digits apart. ``keys`` must form few groups without missing keys (features,
    states): more than ``max_groups`` raise. Missing values are skipped. The input is scanned
    three times or more, so stage it when it is expensive.

    With ``columns`` the groups are these columns of ``df`` under the one key, and no row is made
    for each of their values.
    """
    spark = df.sparkSession
    ship_package(spark)
    if columns:
        every = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
        key_fields = [T.StructField(keys[0], T.StringType())]
    else:
        every = df.select(*keys, F.col(value).cast("double").alias("_x"))
        key_fields = [every.schema[k] for k in keys]
    if begun:
        rows = begun.sizes
    elif columns:
        found = every.agg(F.count("*"), *(F.count(c) for c in columns)).first()
        rows = [{keys[0]: c, "n": n, "rows": found[0]} for c, n in zip(columns, found[1:])]
    else:
        rows = every.groupBy(*keys).agg(F.count("_x").alias("n"), F.count("*").alias("rows"))
        rows = rows.limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"expected at most {max_groups} groups")
    ranks, sizes = [], {}
    for row in rows:
        if not row["n"]:
            continue
        group = tuple(row[k] for k in keys)
        wanted = positions(row["n"], row["rows"]) if positions else {}
        for name, p in probs.items():
            at = float(wanted.get(name, (row["n"] - 1) * p))
            for upper, rank in ((False, math.floor(at)), (True, math.ceil(at))):
                ranks.append(_Rank(group, len(sizes), name, at, upper, rank))
        sizes[group] = row["n"]
    kinds = [*key_fields, T.StructField("n", T.LongType())]
    if not ranks:
        kinds += [T.StructField(name, T.DoubleType()) for name in probs]
        return spark.createDataFrame([], T.StructType(kinds))

    # groups are few, see max_groups
    numbers = T.StructType([*key_fields, T.StructField("_g", T.IntegerType())])
    groups = spark.createDataFrame([(*k, i) for i, k in enumerate(sizes)], numbers)
    kind = "_s int, _d long, _c long, _low double, _high double"
    if columns:
        numbered = [list(sizes).index((c,)) if (c,) in sizes else -1 for c in columns]
    else:
        x = every.where("_x IS NOT NULL").join(F.broadcast(groups), keys).select("_g", "_x")

    def counted(slots: _Slots, bits: int) -> DataFrame:
        if columns:
            return every.mapInArrow(_counted_columns(slots, bits, numbered), kind)
        return x.mapInArrow(_counted(slots, bits), kind)

    digit, done = max(1, math.ceil(math.log2(accuracy))), 0
    while done < BITS:
        slots, slot = _Slots.of(ranks, done)
        if begun and not done:
            # one slot a group, in the order of their numbers
            bits = BEGUN_BITS
            counts = begun.counts.join(F.broadcast(groups), keys).withColumnRenamed("_g", "_s")
        else:
            bits = min(digit, BITS - done)
            counts = counted(slots, bits)
        counts = counts.groupBy("_s", "_d").agg(
            F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
        )
        held = spark.createDataFrame(
            [(i, s, r.rest) for i, (s, r) in enumerate(zip(slot, ranks))], "_i int, _s int, _rest long"
        )
        # one row for each rank
        found = _upto(counts, "_d").join(F.broadcast(held), "_s").where(HOLDS).collect()
        for row in found:
            rank = ranks[row["_i"]]
            rank.prefix = rank.prefix << bits | row["_d"]
            rank.rest -= row["_upto"] - row["_c"]
            rank.inside, rank.one_value = row["_c"], row["_low"] == row["_high"]
        done += bits
        if all(r.one_value or r.inside <= rank_rows for r in ranks):
            break

    slots, slot = _Slots.of(ranks, done)
    counts = counted(slots, 0)
    counts = counts.groupBy("_s", F.col("_low").alias("_x")).agg(F.sum("_c").alias("_c"))
    held = spark.createDataFrame(
        [(s, *r.keys, sizes[r.keys], r.name, r.position, r.upper, r.rest) for s, r in zip(slot, ranks)],
        T.StructType(
            [
                T.StructField("_s", T.IntegerType()),
                *kinds,
                T.StructField("_name", T.StringType()),
                T.StructField("_position", T.DoubleType()),
                T.StructField("_upper", T.BooleanType()),
                T.StructField("_rest", T.LongType()),
            ]
        ),
    )
    found = _upto(counts, "_x").join(F.broadcast(held), "_s").where(HOLDS)
    values = found.groupBy(*keys, "n", "_name", "_position").agg(
        F.max(F.when(~F.col("_upper"), F.col("_x"))).alias("_a"), F.max(F.when(F.col("_upper"), F.col("_x"))).alias("_z")
    )
    part = F.col("_position") - F.floor("_position")
    values = values.withColumn("_value", F.col("_a") + (F.col("_z") - F.col("_a")) * part)
    return values.groupBy(*keys, "n").agg(
        *(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in probs)
    )
