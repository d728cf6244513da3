"""Frames with hostile extra columns, and plain reference versions."""

import random
import re

from pyspark.sql import functions as F

# Names that operators use inside or return.
CLASHING = [
    "block", "key", "w", "row", "label", "n", "rep", "class", "value", "digest", "word", "place", "score",
    "kept", "spans", "base", "start", "length", "n_words", "component_id", "lang_pred", "shard", "mark", "tail",
]


def documents(spark, rows, clash=True, kind="doc_id long, text string"):
    """(doc_id, text, ...) rows as a frame with extra columns that are all null."""
    df = spark.createDataFrame(rows, kind)
    for name in CLASHING if clash else []:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def random_texts(seed, n, vocabulary=40, longest=60, copies=0.3):
    """Texts over a small vocabulary; some repeat a passage of an earlier one, or all of it."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "a,b", "X"]
    out = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, longest))]
        if out and rng.random() < copies:
            other = rng.choice(out).split()
            a = rng.randint(0, max(0, len(other) - 20))
            text = text[: rng.randint(0, 10)] + other[a : a + rng.randint(10, 60)]
        if out and rng.random() < copies / 2:
            text = rng.choice(out).split()
            if text and rng.random() < 0.6:
                text[rng.randrange(len(text))] = "other"
        out.append(rng.choice([" ", "\n", " \t"]).join(text))
    return out
