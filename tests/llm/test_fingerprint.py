import hashlib
import os.path
import random

import numpy as np
import pytest

from daytide.llm import fingerprint as f
from tests.llm.helpers import documents, random_texts


def prefixes(text):
    return f.Prefixes(f.points_of(text))


def test_spans_are_equal_where_the_text_is():
    text = "abcabcab🙂cabc"
    p = prefixes(text)
    for n in (1, 2, 3, 5):
        for i in range(len(text) - n + 1):
            for j in range(len(text) - n + 1):
                assert (p.span(i, n) == p.span(j, n)) == (text[i : i + n] == text[j : j + n])
        starts = np.arange(len(text) - n + 1)
        assert p.spans(starts, n).tolist() == [p.span(int(i), n) for i in starts]


def test_common_extension_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        want = len(os.path.commonprefix([a[i:], b[j:]]))
        assert f.common_extension(prefixes(a), i, prefixes(b), j) == want


def test_prefixes_taken_over_from_a_longer_text():
    a, b = "x" * 50 + "yz" * 40, "x" * 50 + "qr" * 30
    one, two = prefixes(b), f.Prefixes(f.points_of(b), prefixes(a), 50)
    assert f.fingerprint(one) == f.fingerprint(two)


def check(spark, rows):
    got = f.fingerprints(documents(spark, rows)).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    texts = [rows[i][1] or "" for i in order]
    want = []
    for at, text in enumerate(texts):
        after = texts[(at + 1) % len(texts)]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        want.append((rows[order[at]][0], len(text), hashlib.sha256(changed.encode()).hexdigest(), len(os.path.commonprefix([text, after]))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.common_next) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    return got


@pytest.mark.parametrize("n", [1, 2, 150])
def test_next_document(spark, n):
    texts = random_texts(3, n, vocabulary=900)
    ids = random.Random(n).sample(range(-10**12, 10**12), n)
    got = check(spark, list(zip(ids, texts)))
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(dict(zip(ids, texts))[r.doc_id])
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len(set(texts))


def test_edges(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(300_000))
    got = {r.doc_id: r for r in check(spark, [(3, None), (1, ""), (None, "é🙂" * 9), (7, long), (9, long + "x" * 50), (8, "a")])}
    assert got[1].near_next == 1.0 and got[3].near_next < 1
    assert got[7].near_edited > 0.6
    assert f.fingerprints(documents(spark, [])).collect() == []


def test_equal_ids(spark):
    rows = [(1, "one " * 9), (1, "two " * 9), (1, "two " * 9), (2, "three")]
    got = f.fingerprints(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]


def test_likeness_follows_the_shared_part():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    mark = f.fingerprint(prefixes(text))
    near = [f.likeness(mark, f.fingerprint(prefixes(text[:n] + other[n:]))) for n in (4000, 3600, 2400, 0)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.05
