import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daytide.llm import quality, statistics
from tests.llm.helpers import documents


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        good = rng.random() < 0.7
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 2 else text[:5] * 12
        rows.append((i, " ".join(text) + "."))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def run(spark, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("score", F.lit("x"))
    return quality.score(documents(spark, rows), marks).collect()


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in run(spark, rows, labels)}
    assert len(got) == len(rows)
    own = [(got[d], y) for d, y in labels if held(d)]
    assert len(own) > 60 and np.mean([r.predicted == y for r, y in own]) > 0.95
    for r in got.values():
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus()
    wrong = [(d, 1 - y if held(d) else y) for d, y in labels]
    key = lambda out: sorted((r.doc_id, round(r.score, 9)) for r in out)
    assert key(run(spark, rows, labels)) == key(run(spark, rows, wrong))


def test_edges(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (902, "w " * 40_000), (902, "w " * 40_000), (None, "a b")]
    got = run(spark, rows, [*labels, (900, 1), (12345, 0), (1, None), (None, 1)])
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (3, 0)], 0.0)])
def test_without_two_classes(spark, labels, score):
    got = run(spark, [(1, "a"), (3, None)], labels)
    assert [r.score for r in got] == [pytest.approx(score, abs=1e-9)] * 2


def test_empty_table(spark):
    assert run(spark, [], []) == []


def test_compiled_score_is_the_sum_of_its_rules(spark):
    model = quality.RuleModel(0.5, [((("upper", ">", 0.2),), -2.0), ((("bangs", "<=", 0.1), ("upper", "<=", 0.4)), 1.0)])
    df = spark.createDataFrame([(0.1, 0.0), (0.3, 0.0), (0.5, 0.5)], "upper double, bangs double")
    want = [1 / (1 + np.exp(-z)) for z in (1.5, -0.5, -1.5)]
    assert [r[0] for r in df.select(model.column()).collect()] == pytest.approx(want)


def test_rules_are_shortened():
    rule = (("a", "<=", 3.0), ("b", ">", 1.0), ("a", "<=", 2.0), ("a", ">", 0.0))
    assert quality._shortened(rule) == (("a", "<=", 2.0), ("a", ">", 0.0), ("b", ">", 1.0))


def test_statistics_against_plain_python():
    texts = ["One two two\nONE! 12", "", None, "é é | x\nx\nx", "  ", "A" * 20 + " b"]
    got = statistics.statistics(pa.array(texts))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        words = raw.lower().split()
        lines = [x for x in raw.split(b"\n") if x]
        n, k = max(len(raw), 1), max(len(words), 1)
        assert got["log_bytes"][i] == pytest.approx(np.log1p(len(raw)))
        assert got["log_words"][i] == pytest.approx(np.log1p(len(words)))
        assert got["word_bytes"][i] == pytest.approx(sum(map(len, words)) / k)
        assert got["upper"][i] == pytest.approx(sum(65 <= b <= 90 for b in raw) / n)
        assert got["bars"][i] == pytest.approx(raw.count(b"|") / n)
        assert got["distinct_words"][i] == pytest.approx(len(set(words)) / k)
        assert got["top_word"][i] == pytest.approx(max(map(words.count, words), default=0) / k)
        pairs = list(zip(words, words[1:]))
        assert got["repeated_pairs"][i] == pytest.approx(1 - len(set(pairs)) / len(pairs) if pairs else 0)
        assert got["repeated_lines"][i] == pytest.approx(1 - len(set(lines)) / len(lines) if lines else 0)
