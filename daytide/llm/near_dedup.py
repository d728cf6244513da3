"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct shingles (``shingle`` words; a shorter document is one
shingle; without words the set is empty and links with nothing). Steps:

1. Documents with equal sets form one class, kept by its smallest id; a group of copies of
   any size is one row from here on, counted map-side.
2. A class keeps the ``k`` smallest of its hash values, its sketch. The sketch of a union
   is the k smallest of both sketches, and the share of common values in it estimates the
   Jaccard similarity. Classes that are similar enough share at least ``need`` sketch
   values but for a chance of about 1e-7 (never, for sets the sketch holds whole).
3. Inverted lists of the retained values give the overlaps. Values go by rarity, and a
   class enters only the lists of its rarest values, as many as suffice to meet every
   class that shares ``need`` values. A passage that a third of the documents carry is
   frequent, so its lists are entered by classes that consist of little else.
4. In a list no pairs are formed: each member is held against one member of another
   component, the smallest, and against another one in further rounds. Lists whose members
   are in one component are finished. What is left after the last round goes through a
   prefix join on the full sets, exact and bounded by place, which meets only members of
   different components that can still be similar.
5. A pair passes the estimate on the union sketch (with a margin below which a true link
   has a chance of about 1e-7) and then exact Jaccard on the full sets of shingle hashes.

Links are closed to components by spreading the smallest id, with tables written between
passes; no link or component comes to the driver.

Defined cases: null and empty texts are components of their own; repeated rows of one
doc_id give a row each; a null doc_id is smaller than every other and given back as null;
an empty table gives an empty result; columns other than id and text are left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytide.llm.common import NO_ID, texts
from daytide.llm.words import Words, parts
from daytide.session import stage

ROUNDS = 1


def shingle_sets(column, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    hashes, _ = words.windows(n)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            yield np.unique(hashes[a : b - n + 1])
        elif b > a:
            short = 0
            for h in words.hash[a:b].tolist():
                short = (short * 31 + h + int(b - a)) & 0xFFFFFFFFFFFFFFFF
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    """Sets as lists of signed numbers in the order of the unsigned ones."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat = (flat ^ np.uint64(1 << 63)).view(np.int64)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sketches(n: int, k: int):
    def kernel(batches):
        for batch in parts(batches):
            sets = list(shingle_sets(batch["text"], n))
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                    _lists([s[:k] for s in sets]),
                ],
                names=["doc_id", "n_shingles", "class", "sketch"],
            )

    return kernel


def _full_sets(n: int):
    def kernel(batches):
        for batch in parts(batches):
            sets = _lists(list(shingle_sets(batch["text"], n)))
            yield pa.record_batch([batch["doc_id"], sets], names=["rep", "shingles"])

    return kernel


def needed(size: Column, k: int, percent: int) -> Column:
    """Sketch values that a class of so many shingles shares with any similar class.

    Below k * percent / 100 shingles both sketches hold what the pair has in common, so
    the bound is exact; above, it is six deviations under the mean of the union sketch,
    less what a slightly larger partner's sketch may leave out.
    """
    share = percent / 100
    deviations = k * share - 6 * math.sqrt(k * share * (1 - share))
    left_out = k * (1 + share - 1 / share)
    least = max(1, math.floor(min(deviations, left_out)))
    exact = F.ceil(size * percent / 100)
    return F.when(size < k * percent / 100, exact).otherwise(F.lit(least)).cast("int")


def _components(links: DataFrame) -> DataFrame:
    """(rep, component): the smallest node reachable, for the nodes that links touch.

    Each pass takes the smallest component among the neighbours, then jumps to that one's
    own; passes grow with the logarithm of the longest chain.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = stage(both, "links")
    state = both.select(F.col("a").alias("rep")).distinct().withColumn("component", F.col("rep"))
    state = stage(state, "components")
    while True:
        near = (
            both.join(state, both["b"] == state["rep"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "rep")
        )
        step = state.join(near, "rep").select(
            "rep", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        jump = step.select(F.col("rep").alias("component"), F.col("component").alias("jumped"))
        after = step.join(jump, "component").select("rep", "was", F.col("jumped").alias("component"))
        after = stage(after, "components")
        state = after.select("rep", "component")
        if after.where("was <> component").isEmpty():
            return state


def _verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch passes and whose full sets are similar enough."""
    margin = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    least = max(0.0, margin)
    small = sets.select("rep", "n", "sketch")
    near = pairs.join(small.toDF("a", "n_a", "sketch_a"), "a").join(small.toDF("b", "n_b", "sketch_b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.array_intersect(F.array_intersect(union, "sketch_a"), F.col("sketch_b"))
    near = near.where(F.size(common) >= F.floor(F.size(union) * F.lit(least))).select("a", "b")
    full = sets.select("rep", "n", "shingles")
    both = near.join(full.toDF("a", "n_a", "set_a"), "a").join(full.toDF("b", "n_b", "set_b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    alike = F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent
    return both.where(alike).select("a", "b").distinct()


def _open(lists: DataFrame, state: DataFrame | None) -> DataFrame | None:
    """Rows of the lists whose members are in several components, with these; None if none are."""
    if state is None:
        placed = lists.withColumn("component", F.col("rep"))
    else:
        placed = lists.join(state, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    still = stage(placed.join(several.where("low < high"), "value"), "open")
    return None if still.isEmpty() else still


def _against_one(still: DataFrame, turn: int) -> DataFrame:
    """Pairs of each list member with one member of another component: (a, b, n_a, n_b).

    That is the smallest member of the smallest component, and in later rounds one of the
    largest component, in turn.
    """
    hub = F.struct("rep", "n", "component")
    of = F.expr("component = high" if turn % 2 else "component = low")
    pick = F.min if turn < 2 else F.max
    hubs = still.groupBy("value").agg(pick(F.when(of, hub)).alias("hub"))
    return (
        still.join(hubs, "value")
        .where("component <> hub.component")
        .select(
            F.least("rep", "hub.rep").alias("a"),
            F.greatest("rep", "hub.rep").alias("b"),
            F.col("n").alias("n_a"),
            F.col("hub.n").alias("n_b"),
        )
    )


def _left_over(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of what is still open, by a prefix join on the full sets.

    Two similar sets share percent / (100 + percent) of their joint size. With shingles in
    order of rarity, the first one they share stands so early in either that the rest still
    suffices. A text with many changes of its own has these in front, which takes it out of
    every list; so a large group of copies with many changes each leaves few pairs.
    """
    members = still.select("rep", "component").distinct()
    whole = members.join(sets.select("rep", "n", "shingles"), "rep")
    rows = whole.select("rep", "n", "component", F.explode("shingles").alias("value"))
    shared = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    of_rep = Window.partitionBy("rep", "n")
    rows = rows.join(shared, "value").withColumn(
        "place", F.row_number().over(of_rep.orderBy("df", "value")) + F.col("n") - F.count("*").over(of_rep)
    )
    # the partner is at least as large as the share asks for
    smallest = F.ceil(F.col("n") * percent / 100)
    rows = rows.select("value", "rep", "n", "component", (F.col("n") - F.col("place") + 1).alias("rest"))
    rows = stage(rows.where(F.col("rest") >= smallest), "prefixes")
    for _ in range(2):
        lists = rows.groupBy("value").agg(
            F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        joint = F.col("n") + F.greatest("least", smallest)
        rows = rows.join(lists.where("low < high"), "value").where(
            F.col("rest") * (100 + percent) >= joint * percent
        )
        rows = stage(rows.select("value", "rep", "n", "component", "rest"), "prefixes")
    a, b = rows.alias("a"), rows.alias("b")
    enough = F.expr(f"least(a.rest, b.rest) * {100 + percent} >= (a.n + b.n) * {percent}")
    met = a.join(b, F.expr("a.value = b.value AND a.component < b.component") & enough)
    return met.select(
        F.expr("least(a.rep, b.rep)").alias("a"),
        F.expr("greatest(a.rep, b.rep)").alias("b"),
        F.expr("a.n").alias("n_a"),
        F.expr("b.n").alias("n_b"),
    ).distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    k: int = 32,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A and B| >= percent * |A or B|; component_id is the
    smallest doc_id reachable over links.
    """
    given = texts(docs, doc_id, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    sketched = given.mapInArrow(
        _sketches(shingle, k), "doc_id long, n_shingles long, class binary, sketch array<long>"
    )
    sketched = stage(sketched, "sketches")
    classes = (
        sketched.where("n_shingles > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    )
    reps = stage(classes, "classes")
    # sketches of one class are equal; that of the representative's row stays
    kept = sketched.select(F.col("doc_id").alias("rep"), "class", "sketch").join(reps, ["rep", "class"])
    kept = kept.dropDuplicates(["rep", "class"])
    entries = kept.select("rep", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = entries.join(shared, "value")
    by_rarity = Window.partitionBy("rep").orderBy("df", "value")
    retained = F.least("n", F.lit(k))
    met = met.withColumn("place", F.row_number().over(by_rarity)).withColumn(
        "n_met", F.count("*").over(Window.partitionBy("rep"))
    )
    # the values that no other class has are the rarest ones and come first
    prefix = retained - needed(F.col("n"), k, percent) + 1
    lists = met.where(F.col("place") <= prefix - (retained - F.col("n_met"))).select("value", "rep", "n")
    lists = stage(lists, "lists")

    wanted = lists.select("rep").distinct()
    full = (
        given.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "text"])
        .mapInArrow(_full_sets(shingle), "rep long, shingles array<long>")
        .select("rep", F.size("shingles").alias("n"), F.slice("shingles", 1, k).alias("sketch"), "shingles")
    )
    sets = stage(full, "sets")
    links, state = None, None
    for turn in range(rounds + 1):
        still = _open(lists, state)
        if still is None:
            break
        pairs = _against_one(still, turn) if turn < rounds else _left_over(still, sets, percent)
        pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        found = stage(_verified(pairs.select("a", "b").distinct(), sets, k, percent), "found")
        links = found if links is None else links.union(found)
        state = _components(links)
    if state is None:
        state = lists.select("rep", F.col("rep").alias("component")).limit(0)

    # a class takes the component of its representative; a document that of its class
    of_class = reps.select("class", "rep").join(state, "rep", "left")
    of_class = of_class.select("class", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_shingles",
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )
