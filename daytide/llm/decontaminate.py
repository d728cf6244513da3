"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` words (an item of fewer words is one window).
A window occurs in a document only if all its words do, so a single necessary prefix word
is enough: words are ordered by rarity over the corpus, and each window is joined on its
rarest word. The place of that word in the window bounds the place of the window in the
document (it starts at or after the first word and ends at or before the last one), and
the document's words in just that stretch, which is as long as the window, are compared
with the window exactly.

The benchmark's words and windows are broadcast if their counted rows stay below
``broadcast_rows``; a larger benchmark is joined by shuffle. Documents are never joined
with each other, and hits are rows that passed the exact comparison.

Defined cases: null and empty texts have no words and no hits; an item without words has
no window; an item without id marks words but is not listed; rows with equal doc_id and
text give equal rows, rows with a null doc_id too; an empty table on either side gives no
hits; other columns are left behind (clean() keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.session import stage

# What separates words, after A-Z became a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def _key(doc_id: Column, text: Column) -> Column:
    """Never null: a row's id and a hash of its text."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("text"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """(number, words, item_ids): the distinct windows of a benchmark and their items."""
    split = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w"))
    split = split.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(key, start, length, item_ids): every occurrence of an item window in a document."""
    windows = item_windows(items, item_id, item_text, window)
    split = docs.select(_key(F.col(doc_id), F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = (
        split.select(F.explode("w").alias("word"))
        .join(_bounded(vocabulary, broadcast_rows), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    # the rarest word of each window; a window with an unseen word occurs nowhere
    placed = windows.select("words", "item_ids", F.posexplode("words").alias("offset", "word"))
    rarest = (
        placed.join(counts, "word", "left")
        .groupBy("words", "item_ids")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("first"))
        .where("first.n > 0")
        .select("words", "item_ids", F.col("first.word").alias("word"), F.col("first.offset").alias("offset"))
    )
    rarest = stage(rarest, "anchors")  # its size is checked before it is joined
    at = split.select("key", "w", F.posexplode("w").alias("place", "word")).alias("d")
    anchors = _bounded(rarest, broadcast_rows).alias("a")
    start = F.expr("d.place - a.offset")
    fits = (start >= 0) & (start + F.size("a.words") <= F.size("d.w"))
    same = F.slice("d.w", F.greatest(start + 1, F.lit(1)), F.size("a.words")) == F.col("a.words")
    joined = at.join(anchors, (F.col("d.word") == F.col("a.word")) & fits & same)
    return joined.select("d.key", start.alias("start"), F.size("a.words").alias("length"), "a.item_ids")


def _hits(docs, items, **names) -> DataFrame:
    """(key, n_hit, item_ids) of the documents with hits."""
    found = occurrences(docs, items, **names)
    grouped = found.groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    covered = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    return grouped.select("key", F.size(F.array_distinct(F.flatten(covered))).alias("n_hit"), "item_ids")


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is part of a benchmark window."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as text) and contaminated, for every row."""
    hits = _hits(docs, items, doc_id=doc_id, text=text, **names)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        _key(F.col(doc_id), F.col(text)).alias("key"),
        F.size(words(F.col(text))).cast("long").alias("n_words"),
    )
    out = rows.join(hits, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("item_ids", none).alias("item_ids"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    hits = _hits(docs, items, doc_id=doc_id, text=text, **names)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, body = F.col("row").getField(doc_id), F.col("row").getField(text)
    rows = given.withColumn("key", _key(id_, body)).join(hits.select("key", "n_hit"), "key", "left")
    dirty = contaminated(F.size(words(body)), F.coalesce("n_hit", F.lit(0)))
    # only rows with hits need their words counted
    return rows.where(F.col("n_hit").isNull() | ~dirty).select("row.*")
