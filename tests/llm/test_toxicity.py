import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daytide.llm import toxicity as t
from tests.llm.helpers import documents

BAD = ["gribble", "snorkfest", "vlumpish"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = [t.Term(w, False) for w in ("abba", "banana", "cabbages", "abcabcabc", "bab")] + [t.Term("caab", True)]
    lexicon = t.Lexicon(terms)
    lexicon.LIMIT = 500  # the automaton starts anew now and then
    hits = 0
    for _ in range(4000):
        if rng.random() < 0.5:
            word = "".join(rng.choice("abcn") for _ in range(rng.randint(0, 10)))
        else:
            word = list(rng.choice(terms).letters)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "g"])
            word = "".join(word)
        got, edits = lexicon.match(word)
        if any(term.stem and word.startswith(term.letters) for term in terms):
            assert (terms[got].stem, edits) == (True, 0)
            continue
        close = [distance(word, x.letters) for x in terms if not x.stem and distance(word, x.letters) <= x.edits]
        assert (got >= 0) == bool(close), word
        if close:
            assert edits == min(close) == distance(word, terms[got].letters)
            hits += 1
    assert hits > 300


def features(*texts):
    lexicon = t.Lexicon([t.Term(w, False) for w in BAD] + [t.Term("zorp", True)])
    return t.term_features(lexicon, pa.array(texts))


def test_terms_in_context():
    got = features(
        "You GRIBBLE!", "a gribbel and gr1bble", 'they said "gribble" and left', "«so ein vlumpish» ja, vlumpish",
        "zorping zorp", "clean words only", "", None, '"open gribble\nnext gribble',
    )
    count = {k: np.round(np.expm1(v)).astype(int).tolist() for k, v in got.items() if k in ("exact", "fuzzy", "quoted_exact", "kinds")}
    assert count["exact"] == [1, 0, 0, 1, 2, 0, 0, 0, 1]
    assert count["fuzzy"] == [0, 1, 0, 0, 0, 0, 0, 0, 0]  # a swap is two edits
    assert got["fuzzy"][1] == np.log1p(t.EDIT_WEIGHT)  # a near miss counts less
    assert count["quoted_exact"] == [0, 0, 1, 1, 0, 0, 0, 0, 1]


def test_window_counts_stay_in_a_text_and_in_reach():
    far = "gribble " + "w " * 30 + "gribble"
    got = np.round(np.expm1(features(far, "gribble x gribble x gribble", "gribble", "gribble")["crowded"])).astype(int)
    assert got.tolist() == [1, 3, 1, 1]


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in ("lon", "mer", "tas", "vik")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def run(spark, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    return t.score(documents(spark, rows), marks).collect()


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = corpus()
    new = [(1000, "calon gribblle dumer snorkfets snorkfesst calon " * 2), (1001, "calon dumer " * 10)]
    got = {r.doc_id: r for r in run(spark, rows + new, labels)}
    own = [got[d].predicted == y for d, y in labels if held(d)]
    assert len(own) > 80 and np.mean(own) > 0.98
    assert got[1001].score < 0.1 < 0.9 < max(got[d].score for d, y in labels if y)
    for r in got.values():
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_stems_allow_edits_before_their_last_letter():
    rng = random.Random(3)
    terms = [t.Term("abbab", True), t.Term("cabbages", True), t.Term("abbab", False), t.Term("caab", True)]
    lexicon = t.Lexicon(terms)
    hits = 0
    for _ in range(4000):
        word = list(rng.choice(terms).letters)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "g"])
        word = "".join(word) + rng.choice(["", "x", "aby"])
        close = [distance(word, terms[2].letters)] if distance(word, terms[2].letters) <= 1 else []
        for stem in terms:
            heads = [word[: i + 1] for i, x in enumerate(word) if stem.stem and x == stem.letters[-1]]
            edits = [distance(h[:-1], stem.letters[:-1]) for h in heads]
            close += [e for e in edits if e <= stem.edits]
        got, edits = lexicon.match(word)
        assert (got >= 0) == bool(close), word
        if close:
            assert edits == min(close), word
            hits += edits > 0
    assert hits > 300


def test_misspelled_documents_score_through_the_learnt_lexicon(spark, monkeypatch):
    bad = ["grumb", "vlirps", "snorkel", "plinkers"]  # of the lengths that stems have, and one more
    monkeypatch.setattr(f"{__name__}.BAD", bad)
    rows, labels = corpus(800)
    rng = random.Random(4)
    for i in range(0, 800, 3):  # misspelled in a third of the labelled documents as well
        for word in bad:
            at = rng.randrange(1, len(word) - 1)
            rows[i] = (i, rows[i][1].replace(word, word[:at] + "z" + word[at + 1 :]))
    wrong = {1000 + i: f"calon dumer {w[:2]}q{w[3:]} calon dumer {w[:1]}q{w[2:]} balon" for i, w in enumerate(bad)}
    marked = [(text, label) for (_, text), (_, label) in zip(rows, labels)]
    learnt = t.learn_lexicon(spark.createDataFrame(marked, "text string, label int"))
    assert {x.letters for x in learnt if not x.stem and x.edits} >= set(bad)
    got = {r.doc_id: r.score for r in run(spark, rows + list(wrong.items()) + [(2000, "calon dumer balon " * 3)], labels)}
    assert got[2000] < 0.1
    assert min(got[d] for d in wrong) > 0.5


def test_chance_against_counting():
    from itertools import combinations

    marked = {0, 1, 2}  # of eight documents
    for have in range(1, 6):
        for toxic in range(0, min(have, 3) + 1):
            if have - toxic > 5:
                continue
            draws = [len(marked & set(c)) for c in combinations(range(8), have)]
            want = sum(d >= toxic for d in draws) / len(draws)
            assert abs(t.chance_of(toxic, have - toxic, 3, 5) - want) < 1e-12


def test_chance_words_long_words_and_common_misses(spark):
    """Random labels give no lexicon; long and run-together words count; ordinary near misses do not."""
    rows, labels = corpus(600, 5)
    rng = random.Random(1)
    mixed = spark.createDataFrame([(x, rng.random() < 0.2) for _, x in rows], "text string, label boolean")
    assert t.learn_lexicon(mixed.withColumn("label", F.col("label").cast("int"))) == []
    long = "qu" * 20 + "x"
    texts = [x.replace("snorkfest", long) + (" vlumpist calm" if i % 2 else "") for i, (_, x) in enumerate(rows)]
    learnt = t.learn_lexicon(spark.createDataFrame([(x, y) for x, (_, y) in zip(texts, labels)], "text string, label int"))
    near = {x.letters: x.edits for x in learnt if not x.stem}
    assert near[long] == 2 and near["vlumpish"] == 0
    lexicon = t.Lexicon(learnt)
    assert lexicon.match(long)[0] >= 0 and lexicon.match("gribble" + "y" * 53)[0] >= 0
    found = t.term_features(lexicon, pa.array(["gribble" + "y" * 53, "calm " + "b" * 5000]))
    assert found["any_exact"].tolist() == [1, 0]


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = corpus(300)
    wrong = [(d, 1 - y if held(d) else y) for d, y in labels]
    key = lambda out: sorted((r.doc_id, round(r.score, 9)) for r in out)
    assert key(run(spark, rows, labels)) == key(run(spark, rows, wrong))


def test_edges(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (902, "gribble " * 30_000), (902, "gribble " * 30_000), (None, "gribble")]
    got = run(spark, rows, [*labels, (900, 1), (5, None), (77777, 1), (None, 1)])
    assert len(got) == len(rows)


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_two_classes(spark, labels, score):
    assert [r.score for r in run(spark, [(1, "a b"), (3, None)], labels)] == [score, score]


def test_empty_table(spark):
    assert run(spark, [], []) == []
