import random

import pytest

from daytide.llm import near_dedup
from tests.llm.helpers import documents, lower, random_texts


def brute(rows, n=4, percent=80):
    sets = {}
    for d, t in rows:
        w = lower(t).encode().split()
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}, {d: sorted(map(len, s)) for d, s in sets.items()}


def check(spark, rows, **kw):
    got = near_dedup.near_duplicates(documents(spark, rows), shingle=4, **kw).collect()
    component, sizes = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == component[r.doc_id], r
        assert r.kept == (component[r.doc_id] == r.doc_id)
        assert r.n_shingles in sizes[r.doc_id]
    return len(set(component.values()))


def near_copies(seed, groups, size, length, changes):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        text = [f"v{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            one = list(text)
            for _ in range(rng.randint(0, changes)):
                one[rng.randrange(length)] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(one))
    rng.shuffle(out)
    return out


def test_random_texts(spark):
    rows = list(enumerate(random_texts(2, 150, copies=0.5)))
    assert check(spark, rows) < len(rows)


@pytest.mark.parametrize("rounds", [0, 3])
def test_groups_of_near_copies(spark, rounds):
    texts = near_copies(3, 6, 25, 150, 7) + near_copies(4, 4, 20, 30, 2)
    check(spark, list(enumerate(texts)), rounds=rounds)


def test_chain(spark):
    """Each text is near the next one only; one component."""
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(20)][::-1]
    assert check(spark, rows) == 1


def test_common_passage_is_no_link(spark):
    common = " ".join(f"license{i}" for i in range(30))
    rng = random.Random(5)
    rows = [(i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(80)]
    assert check(spark, rows) == 80


def test_edges(spark):
    a = " ".join(f"a{i}" for i in range(50))
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(9, a), (8, a.upper()), (8, a.upper()), (7, None), (6, ""), (5, "one two"), (4, "One  two"), (3, long), (2, long + " y"), (1, "one")]
    check(spark, rows)


def test_null_id(spark):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(None, a), (3, a), (4, "b")]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got[3].component_id is None and not got[3].kept
    assert got[None].kept and got[4].kept


def test_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert near_dedup.near_duplicates(documents(spark, [(1, None)])).count() == 1
