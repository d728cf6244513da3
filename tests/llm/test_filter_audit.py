"""The filter audit against plain Python over every order, and its tries."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from daytide.llm import filter_audit
from tests.llm.helpers import CLASHING, random_texts

KIND = "doc_id long, text string, source string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    for name in [*CLASHING, "mask", "part", "head", "cell", "heavy", "good"]:
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fails(rows, at):
    """Letters of the filters that a row fails."""
    number, text, _ = rows[at]
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    same = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if number is not None and number > min(same) else "")


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = [fails(rows, i) for i in range(len(rows))]
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in own) - len(gone),
                    sum(f == letter for _, f in own),
                    sum(d in good for d in gone),
                    sum(d in toxic for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, rows, labels, pieces=3):
    got = filter_audit.audit(frame(spark, rows).repartition(pieces), labelled(spark, labels)).collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got}
    assert len(found) == len(got)
    assert found == brute(rows, labels)


def test_random_texts_labels_and_hostile_rows(spark):
    rng = random.Random(1)
    texts = random_texts(4, 60, vocabulary=900, longest=420)
    texts += [t.replace("w", "W", 40) for t in texts[:10]] + [t + " #" for t in texts[10:20]] + texts[:15]
    rows = [(rng.randrange(90), t, rng.choice(["a", "b", "", None])) for t in texts]
    rows += [(None, texts[0], "a"), (None, None, None), (3, None, "b"), (3, "", "b"), (4, "", "a"), (4, "", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(0, 1, 0), (None, 1, 1), (4, 0, 1)]
    check(spark, rows, labels)


def test_one_text_everywhere(spark):
    rows = [(i, "same text " * 150, "hot" if i % 3 else "cold") for i in range(120)]
    check(spark, rows, [(5, 1, 1)], 7)


def test_empty_tables(spark):
    assert filter_audit.audit(frame(spark, []), labelled(spark, [])).collect() == []
    check(spark, [(1, "a", "x")], [])


def test_long_shared_beginnings_are_cut_further(spark):
    head = "the same long licence text " * 200
    rows = [(i, head + f"{i % 30} end" * (i % 4), "x") for i in range(200)] + [(500, head[:12], "x"), (501, "é" * 9, "x")]
    marks = filter_audit.failures(frame(spark, rows).repartition(9), cell_bytes=20_000).collect()
    found = Counter({r.doc_id: r["mask"] & 16 for r in marks})
    assert {d for d, m in found.items() if m} == {r[0] for i, r in enumerate(rows) if "E" in fails(rows, i)}
    left = frame(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"))
    cells = filter_audit.prefix_cells(left, 20_000)
    sizes = cells.groupBy("head", "cell").agg(F.sum(F.octet_length("text")).alias("b"), F.count_distinct("text").alias("n"))
    assert all(r.b <= 20_000 or r.n == 1 for r in sizes.collect())


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_compressed_and_keeps_least(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    trie, ends, least = filter_audit.Trie(), [], {}
    for text in texts:
        number = rng.randrange(1000)
        ends.append(trie.insert(text, number))
        least[text] = min(least.get(text, number), number)
    assert [trie.least[e] for e in ends] == [least[t] for t in texts]
    assert len({e for e in ends}) == len(set(texts))
    for node, children in enumerate(trie.children):
        assert node == 0 or len(children) != 1 or trie.least[node] is not None


def test_edges_of_the_filters():
    import pyarrow as pa

    words = lambda n: " ".join(f"w{i}" for i in range(n))
    texts = [words(199), words(200), words(50) + " w1" * 50, words(50) + " w1" * 51, "A" + "b" * 49, "A" + "b" * 48, ""]
    masks = filter_audit.own_masks(pa.array(texts)).tolist()
    assert masks == [1, 0, 1, 3, 1, 5, 1]
    assert filter_audit.own_masks(pa.array(["é" * 49 + "A", "é" * 48 + "A", "a|b", "a\x0bb"])).tolist() == [1, 5, 9, 1]


def test_cells_need_no_join(spark):
    rows = [(i, "head " * 300 + str(i), "x") for i in range(50)]
    left = frame(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"))
    cells = filter_audit.prefix_cells(left, 5_000)
    assert "Join" not in cells._jdf.queryExecution().executedPlan().toString()
    assert cells.select("cell").distinct().count() > 10


def test_depths_stop_at_the_first_light_prefix():
    import numpy as np

    first, second = filter_audit._hashed([b"a" * 12, b"a" * 48])
    heavy = [np.array([first]), np.array([second])]
    texts = [b"", b"a" * 12, b"a" * 13, b"b" * 90, b"a" * 40 + b"b" * 50, b"a" * 49]
    assert filter_audit.cut_depths(texts, heavy).tolist() == [0, 0, 1, 0, 1, 2]
