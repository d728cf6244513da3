import random
import zlib

import numpy as np
import pytest

from daytide.llm import langid
from tests.llm.helpers import documents

SYLLABLES = {
    "aa": ["the", "ing", "ould", "wh", "tion", "ly"],
    "bb": ["sch", "ung", "über", "lich", "ei", "ß"],
    "cc": ["eaux", "qu", "é", "oi", "ment", "ç"],
}
KIND = "doc_id long, text string, lang string"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, text(rng, lang, rng.randint(5, 200)), lang))
    return out


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


@pytest.fixture(scope="module")
def net(spark):
    return langid.learn(documents(spark, rows(), kind=KIND))


def test_held_out_accuracy(spark, net):
    given = rows()
    got = {r.doc_id: r for r in langid.predict(documents(spark, given, kind=KIND), net).collect()}
    right = [got[d].lang_pred == lang for d, _, lang in given if held(d)]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, net):
    rng = random.Random(3)
    long = text(rng, "bb", 30_000) + " " + text(rng, "aa", 200)
    given = [(1, None, "aa"), (2, "", "aa"), (3, "123 !?\n", "aa"), (None, text(rng, "cc", 60), None), (4, long, None), (4, long, None), (5, "ü", "bb")]
    got = langid.predict(documents(spark, given, kind=KIND), net).collect()
    assert len(got) == len(given)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, None, 4)] == ["und", "und", "und", "cc", "bb"]
    assert by[1].score == 0.0
    assert langid.predict(documents(spark, [], kind=KIND), net).collect() == []


def test_every_window_counts(net):
    """A long text is scored as the byte-weighted mean of its windows, wherever slices end."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [text(rng, "aa", 400), "", text(rng, "cc", 3), text(rng, "bb", 90)]
    got = langid.document_probabilities(net, pa.array(texts))
    for row, one in zip(got, texts):
        raw = one.lower().encode()
        cuts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        if not cuts:
            continue
        windows = np.stack([np.frombuffer(c.ljust(langid.WINDOW), np.uint8) for c in cuts])
        want = (net.probabilities(windows) * np.array([len(c) for c in cuts])[:, None]).sum(axis=0)
        assert np.allclose(row, want / want.sum(), atol=1e-5)


def test_held_out_labels_are_not_learnt(spark):
    given = rows()
    wrong = [(d, t, "zz" if held(d) else lang) for d, t, lang in given]
    assert "zz" not in langid.learn(documents(spark, wrong, kind=KIND)).languages


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """The rounds and the cut take all labelled texts whole, however many a language has."""
    given = rows(1200) + [(5000, None, "aa"), (5001, "123", "bb"), (5002, "abc", None)]
    docs = documents(spark, given, kind=KIND)
    frames, whole = [], type(docs).mapInArrow

    def kept(df, *more):
        frames.append(df)
        return whole(df, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    monkeypatch.setattr(langid, "TRAINED", 1)
    net = langid.learn(docs)
    want = sorted(t for d, t, _ in given if d < 5000 and not held(d))
    found = [[r.text for r in f.collect()] for f in frames]
    assert sorted(t for one in found[: langid.ROUNDS] for t in one) == want
    assert all(sorted(one) == want for one in found[langid.ROUNDS :]) and len(found) == langid.ROUNDS + 2
    best = sorted(
        p.max()
        for t in want
        for p in net.probabilities(langid.windows_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    )
    assert abs(net.least - best[len(best) // 1000]) < 1e-4


def test_the_network_does_not_depend_on_partitions(spark):
    one, other = (langid.learn(documents(spark, rows(), kind=KIND).repartition(n)) for n in (1, 5))
    assert one.least == other.least and all((getattr(one, n) == getattr(other, n)).all() for n in langid.NAMES)


def test_keep_known(spark, net):
    df = documents(spark, [*rows(40), (90, "123", "aa"), (91, None, "aa"), (92, "", None)], kind=KIND)
    kept = langid.keep_known(df, net)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_keep_known_rejects_by_the_network(spark, net):
    rng = random.Random(8)
    clean = rows(200, seed=9)
    mixed = [(1000 + i, "\n".join(text(rng, lang, 300) for lang in SYLLABLES), None) for i in range(5)]
    assert 1 / len(net.languages) < net.least < 1
    kept = langid.keep_known(documents(spark, clean + mixed, kind=KIND), net)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_without_labels(spark):
    df = documents(spark, [(1, "text", None)], kind=KIND)
    assert langid.learn(df) is None
    assert [r.lang_pred for r in langid.predict(df, None).collect()] == ["und"]


def test_training_lowers_the_loss():
    """Training lowers the loss of a separable task."""
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 105, (64, 32)).astype(np.uint8)
    target = (windows[:, :2].sum(axis=1) > 200).astype(int)
    before = langid.train(windows, target, ["a", "b"], epochs=1)
    after = langid.train(windows, target, ["a", "b"], epochs=60)
    loss = lambda n: -np.log(n.probabilities(windows)[np.arange(64), target]).mean()
    assert loss(after) < 0.5 * loss(before)
