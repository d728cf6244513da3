"""The language model: counts against plain Python, the network against slow loops and finite differences."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from daytide.llm import lm
from daytide.llm.queries import queries
from daytide.llm.words import LOWER, Words
from tests.llm.helpers import documents, lower, random_texts


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def learnt(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def brute(rows):
    """(counts, N, V) of the training texts; None stands for the end."""
    counts = Counter()
    for d, t in rows:
        if learnt(d):
            counts.update([*tokens(t), None])
    return counts, sum(counts.values()), len(counts)


def check_base(got, rows):
    counts, total, kinds = brute(rows)
    want = Counter()
    for d, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        want[d, not learnt(d), len(own), sum(counts[w] > 0 for w in own), total, round(base, 5)] += 1
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    close = lambda a, b: a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-5
    assert sum(found.values()) == sum(want.values()) == len(rows)
    for key, n in want.items():
        assert sum(m for other, m in found.items() if close(key, other)) >= n


@pytest.fixture(scope="module")
def scored(spark):
    return queries()["op13_lm_scoring"](spark, "/root/testdata/sf0.01").collect()


def test_counts_and_base_of_the_query(scored):
    check_base(scored, duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())


def test_model_beats_counts_on_texts_it_never_saw(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)  # both are negative
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_small_short_list_nulls_and_copies(spark):
    texts = random_texts(3, 60) + ["", "A a A", "\x0b\x0c", "é É x"]
    rows = list(enumerate(texts)) + [(None, None), (None, "w1 unseen-word"), (7, "w1 w2"), (7, "w1 w2"), (11, "held only " * 9)]
    rows += [(i + 500, texts[0]) for i in range(10)]
    got = lm.score(documents(spark, rows).repartition(3), short=12, head=8, tails=4, share=2).collect()
    check_base(got, rows)
    assert all(r.score < 0 for r in got)
    same = {r.score for r in got if r.doc_id == 7 and r.n_tokens == 3}
    assert len(same) == 1


def test_empty_table_and_no_training_texts(spark):
    assert lm.score(documents(spark, [])).collect() == []
    held = next(i for i in range(100) if not learnt(i))
    got = lm.score(documents(spark, [(held, "a b"), (held, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [
        (1, 0, 0, 0.0, 0.0),
        (3, 0, 0, 0.0, 0.0),
    ]


def small(seed=0, kinds=150, docs=40):
    """A vocabulary and network over random counts, and texts of token numbers."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(kinds)]
    counts = np.sort(rng.integers(1, 90, kinds))[::-1]
    tails = rng.integers(0, 5, kinds)
    head = 71
    total = np.bincount(tails[head - 1 :], counts[head - 1 :], 5).astype(np.int64)
    vocab = lm.Vocabulary(
        docs, int(counts.sum()) + docs, kinds + 1, words, counts, tails, total, np.bincount(tails[head - 1 :], minlength=5), head
    )
    net = lm.start(vocab, seed)
    grown = [a + rng.normal(0, 0.2, a.shape).astype(np.float32) * (a > -1e8) for a in net.arrays()]
    lengths = np.array([1, 5, 90, 33, 32, 64, 2])
    texts = [np.append(rng.integers(1, head + 5, n - 1), lm.END) for n in lengths]
    return vocab, lm.Network(*grown), texts, lengths


def plain(net, text):
    """Log-likelihood of one text, step by step, in doubles."""
    e, i, u, b, c, cb, w, wb = (a.astype(float) for a in net.arrays())
    n, head = lm.HIDDEN, len(e) - (len(cb) - len(w))
    h, before, out = np.zeros(n), lm.END, 0.0
    for t in text:
        x = e[before] @ i + b
        g = 1 / (1 + np.exp(-(x[: 2 * n] + h @ u[:, : 2 * n])))
        new = np.tanh(x[2 * n :] + g[n:] * (h @ u[:, 2 * n :]))
        h = (1 - g[:n]) * new + g[:n] * h
        own = h @ c + cb
        k = t // lm.CLASS if t < head else len(w) + t - head
        out += own[k] - np.log(np.exp(own).sum())
        if t < head:
            inner = w[k] @ h + wb[k]
            out += inner[t % lm.CLASS] - np.log(np.exp(inner).sum())
        before = t
    return out


@pytest.mark.parametrize("window", [1, 7, 32, 1000])
def test_scores_of_whole_texts_in_any_windows(window):
    _, net, texts, lengths = small()
    got = lm.text_scores(net, np.concatenate(texts), lengths, window)
    assert np.allclose(got, [plain(net, t) for t in texts], rtol=1e-4)


def test_probabilities_sum_to_one():
    vocab, net, _, _ = small(2)
    rng = np.random.default_rng(1)
    states = rng.normal(0, 0.5, (3, lm.HIDDEN)).astype(np.float32)
    head, tails = vocab.head, len(vocab.tail_total)
    for h in states:
        every = np.arange(head + tails)
        assert abs(np.exp(lm.log_probabilities(net, np.tile(h, (len(every), 1)), every)).sum() - 1) < 1e-4
    # within a tail class the smoothed counts of its words, and of one unseen, are all its mass
    for t in range(tails):
        own = vocab.counts[head - 1 :][vocab.tails[head - 1 :] == t]
        assert math.isclose((own + 0.5).sum() + 0.5, vocab.tail_total[t] + 0.5 * (vocab.tail_kinds[t] + 1))


def test_start_is_the_unigram_model():
    vocab, _, _, _ = small()
    net = lm.start(vocab)
    every = np.arange(vocab.head)
    got = lm.log_probabilities(net, np.zeros((vocab.head, lm.HIDDEN), np.float32), every)
    counts = np.append(vocab.docs, vocab.counts[: vocab.head - 1]) + 0.5
    assert np.allclose(np.exp(got), counts / (counts.sum() + (vocab.tail_total + 0.5 * (vocab.tail_kinds + 1)).sum()))


def test_gradients_against_finite_differences():
    _, net, _, _ = small(4)
    rng = np.random.default_rng(4)
    seen, target = rng.integers(0, 76, (2, 6, 5))
    seen[3, 2] = seen[0, 1] = lm.END
    h = rng.normal(0, 0.3, (5, lm.HIDDEN)).astype(np.float32)
    wide = lm.Network(*(a.astype(np.float64) for a in net.arrays()))
    _, grad, _ = lm.gradients(wide, seen, target, h.astype(float))
    for name in ("embed", "into", "turn", "bias", "classes", "class_bias", "words", "word_bias"):
        a, g = getattr(wide, name), getattr(grad, name)
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(12)]:
            if a[at] < -1e8:
                continue
            sides = []
            for move in (1e-5, -1e-5):
                a[at] += move
                sides.append(lm.gradients(wide, seen, target, h.astype(float))[0])
                a[at] -= move
            assert math.isclose((sides[0] - sides[1]) / 2e-5, g[at], rel_tol=1e-4, abs_tol=1e-6), name


def test_training_learns_an_order():
    rng = random.Random(3)
    vocab, _, _, _ = small()
    firsts = [rng.choice([1, 5, 9]) for _ in range(4000)]
    stream = np.array([x for a in firsts for x in (a, a + 1, a + 2, lm.END)])
    net = lm.start(vocab)
    lengths = np.full(4, 4)
    before = lm.text_scores(net, stream[:16], lengths).sum()
    after, n = lm.train(net, [stream], 0.02)
    assert n == len(stream)
    assert lm.text_scores(after, stream[:16], lengths).sum() > before / 4


def test_every_training_text_is_learnt_from(spark, monkeypatch):
    """The rounds together see each training text once: their tokens add up to all of them."""
    rows = [(i, t) for i, t in enumerate(random_texts(5, 200)) if learnt(i)]
    docs = documents(spark, rows)
    counts = lm.word_counts(docs).cache()
    vocab = lm.vocabulary(counts, len(rows), 100, 64, lm.TAILS)
    frames, whole = [], type(docs).mapInArrow

    def kept(df, *given, **more):
        frames.append(df)
        return whole(df, *given, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    lm.fit(docs, vocab)
    texts = [r.text for f in frames for r in f.collect()]
    assert sorted(texts) == sorted(t for _, t in rows)
    with pytest.raises(ValueError):
        lm.fit(docs, vocab, share=len(lm.RATES) + 1)


def test_words_and_tails_as_strings():
    column = pa.array(["Ab ab é", None, "x"])
    words = Words(column, lower=True)
    data = LOWER[words.data]
    assert lm.strings_at(data, words.begin, words.end).to_pylist() == ["ab", "ab", "é", "x"]
    tail = lm.tail_of(data, words.begin, words.end, 64)
    assert tail[0] == tail[1] and (tail < 64).all()


def test_texts_of_several_slices_run_through_the_network_together(monkeypatch):
    vocab, net, texts, _ = small(6)
    words = ["w", "v", "x y", "z z z", "w v"] * 4
    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array(words)], names=["doc_id", "text"])
    calls, whole = [], lm.text_scores

    def counted(net, tokens, lengths, **kw):
        calls.append(len(lengths))
        return whole(net, tokens, lengths, **kw)

    monkeypatch.setattr(lm, "text_scores", counted)
    monkeypatch.setattr(lm, "SLICE", 4)
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda _: 0})())}))
    out = pa.Table.from_batches(lm._scored(vocab, net)([batch.slice(0, 9), batch.slice(9)]))
    assert calls == [20]
    rows = [r for r in out.to_pylist() if r["word"] is None]
    assert sorted(r["doc_id"] for r in rows) == list(range(20)) and len({r["row"] for r in rows}) == 20
    # equal texts score alike, wherever they lie, and each text is scored as if alone
    monkeypatch.setattr(lm, "SIDE_BY_SIDE", 1)
    alone = pa.Table.from_batches(lm._scored(vocab, net)([batch])).to_pylist()
    alone = {r["doc_id"]: r["model"] for r in alone if r["word"] is None}
    assert all(abs(r["model"] - alone[r["doc_id"]]) < 1e-4 for r in rows) and len(calls) > 5


def test_choices_of_any_size_neither_overflow_nor_vanish():
    vocab, net, _, _ = small(7)
    for by in (1, 300):
        grown = lm.Network(*net.arrays())
        grown.classes, grown.words = net.classes * np.float32(by), net.words * np.float32(by)
        texts = [np.append(np.arange(1, 9), lm.END)] * 2
        got = lm.text_scores(grown, np.concatenate(texts), np.array([9, 9]))
        with np.errstate(over="ignore", under="ignore"):
            assert np.isfinite(got).all()
        level = lm.levelled(np.ascontiguousarray(grown.classes.T), grown.class_bias)[1]
        assert level == (by == 1)
        h = np.full((1, lm.HIDDEN), 0.9, np.float32)
        every = np.arange(len(net.embed))
        logs = lm.log_probabilities(grown, np.tile(h, (len(every), 1)), every)
        assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_steps_take_a_bounded_number_of_texts(monkeypatch):
    """Texts beyond ``ABREAST`` wait, so that states stay in the cache; scores are those of each text alone."""
    _, net, texts, lengths = small(8)
    widths, whole = [], lm.step

    def counted(turn, moved, h):
        widths.append(h.shape[1])
        return whole(turn, moved, h)

    monkeypatch.setattr(lm, "step", counted)
    monkeypatch.setattr(lm, "ABREAST", 3)
    got = lm.text_scores(net, np.concatenate(texts).astype(np.int16), lengths, 7)
    assert max(widths) == 3
    assert np.allclose(got, [plain(net, t) for t in texts], rtol=1e-4)


@pytest.mark.parametrize("kinds", [0, 1, 900])
def test_places_of_words_whose_hashes_share_leading_bits(kinds):
    rng = np.random.default_rng(kinds)
    few = (rng.integers(0, 5, kinds).astype(np.uint64) << np.uint64(61)) + np.arange(kinds, dtype=np.uint64)
    known = rng.permutation(np.append(few, np.full(int(kinds > 1), 2**64 - 1, np.uint64)))
    vocab = type("V", (), {"hashes": known, "head": 2, "tail_total": np.zeros(4)})
    asked = np.concatenate([known, known + np.uint64(10_000), np.array([0, 2**63, 2**64 - 2], np.uint64)])
    where = {h: i for i, h in enumerate(known.tolist())}
    assert lm.Numbering(vocab).place(asked).tolist() == [where.get(h, -1) for h in asked.tolist()]


def test_rare_words_join_by_number_and_stay_apart(spark, monkeypatch):
    """Words outside the short list get their own counts, though all of them share the number joined by."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a B d", "a e", "f c f", ""]) if learnt(i)] + [(10, "zz B f c"), (7, "é e")]
    hashed = []

    def one(*columns):
        hashed.append(columns)
        return whole(*columns) if len(columns) > 1 else lm.F.lit(5).cast("long")

    whole = lm.F.xxhash64
    monkeypatch.setattr(lm.F, "xxhash64", one)
    got = lm.score(documents(spark, rows).repartition(2), short=1, head=2, tails=4).collect()
    assert ("word",) in hashed
    check_base(got, rows)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_hashes_of_words_do_not_depend_on_their_place(block):
    texts = ["ab cd ab", None, "", "x" * 300 + " ab", "\tcd\r\nAB", "é ab é"]
    words = Words(pa.array(texts), lower=True, block=block)
    data, by = LOWER[words.data], {}
    for h, a, b in zip(words.hash.tolist(), words.begin, words.end):
        by.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(hashes) == 1 for hashes in by.values()) and len(set.union(*by.values())) == len(by) == 4
    # the hash is the polynomial in the word's own bytes
    from daytide.llm import words as w

    for word, (h,) in by.items():
        value = sum(int(w._BYTES[c]) * pow(int(w._STEP), i, 1 << 64) for i, c in enumerate(word)) + len(word) * int(w._ODD)
        assert h == int(w.mixed(np.array([value % (1 << 64)], np.uint64))[0])
