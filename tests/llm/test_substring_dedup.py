import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from daytide.llm import substring_dedup
from tests.llm.helpers import documents, random_texts


def brute(rows, window):
    """doc_id -> list of (n_words, kept text); a null id is the smallest."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def run(df, **kw):
    got = substring_dedup.remove_repeats(df, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr), got


@pytest.mark.parametrize("block_mb", [8.0, 0.002])
def test_against_brute_force(spark, block_mb):
    rows = list(enumerate(random_texts(1, 120)))[::-1]
    got, _ = run(documents(spark, rows), block_mb=block_mb)
    assert got == brute(rows, 13)
    assert sum(g[2] for g in got) > 100


def test_edges(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    a = " ".join(f"a{i}" for i in range(20))
    rows = [(3, None), (None, a), (1, a), (1, a), (2, ""), (4, " \n\t"), (5, long), (6, long + " end"), (7, "one two")]
    got, _ = run(documents(spark, rows))
    assert got == brute(rows, 13)


def test_equal_ids_keep_each_other(spark):
    a = " ".join(f"a{i}" for i in range(20))
    got, _ = run(documents(spark, [(1, a), (1, a)]))
    assert [g[2] for g in got] == [0, 0]


def repeated_ids():
    """Rows of null and repeated ids with different texts, many of them sharing passages."""
    ids = [None, None, 1, 1, 1, 2, 3, 3]
    return [(ids[i % 8] if i < 100 else i, text) for i, text in enumerate(random_texts(11, 160))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passes_that_meet_rows_in_another_order(seed):
    rows, rng = repeated_ids(), random.Random(seed)

    def block(number):  # the rows of one of two blocks as they happen to arrive
        own = rows[number::2]
        rng.shuffle(own)
        kind = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])
        return pa.table([[number] * len(own), *map(list, zip(*own))], schema=kind)

    index = pa.concat_tables([substring_dedup._index(5, 1)(block(n)) for n in (0, 1)])
    answers = substring_dedup._match(index)
    got = []
    for n in (0, 1):
        own = answers.filter(pc.equal(answers["block"], n))
        for r in substring_dedup._parse(5)(block(n), own).to_pylist():
            got.append((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]))
    assert sorted(got, key=repr) == brute(rows, 5)
    assert sum(g[2] for g in got) > 100


@pytest.mark.parametrize("block_mb", [8.0, 0.002])
def test_repeated_ids_with_different_texts(spark, block_mb):
    rows = repeated_ids()
    got, _ = run(documents(spark, rows), block_mb=block_mb, window=5)
    assert got == brute(rows, 5)


@pytest.mark.parametrize("doc", [None, 7])
def test_rows_of_one_id_go_to_many_blocks(spark, doc):
    rows = [(doc, f"a{i} b") for i in range(400)]
    dealt = substring_dedup._dealt(documents(spark, rows, clash=False), 8)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100


def test_factors_point_at_equal_text(spark):
    rows = list(enumerate(random_texts(5, 60)))
    words = {d: t.split() for d, t in rows}
    _, got = run(documents(spark, rows, clash=False), window=5, block_mb=0.001)
    seen = 0
    for r in got:
        for f in r.factors:
            assert f.ref_doc < r.doc_id
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]
            seen += 1
    assert seen > 10


def test_empty_table(spark):
    assert run(documents(spark, []))[0] == []
