import re

import pytest
from pyspark.sql import functions as F

from daytide.llm import decontaminate
from tests.llm.helpers import documents, lower, random_texts


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items, window=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    ids |= found
                    hit.update(range(k, k + n))
        named = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), named, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, rows, items, **kw):
    docs = documents(spark, rows)
    bench = documents(spark, items, kind="item_id long, text string")
    got = decontaminate.contamination(docs, bench, **kw).collect()
    kept = decontaminate.clean(docs, bench, **kw)
    assert kept.columns == docs.columns
    want = brute(rows, items)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    clean_ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert clean_ids == sorted((w[0] for w in want if not w[4]), key=repr)
    return want


@pytest.mark.parametrize("rows", [200_000, 0])
def test_against_brute_force(spark, rows):
    texts = random_texts(7, 80)
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(texts[::9])] + [(100, "w1 w2"), (101, "OTHER"), (102, texts[9])]
    want = run(spark, list(enumerate(texts)), items, broadcast_rows=rows)
    assert any(w[4] for w in want) and not all(w[4] for w in want)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"x{i % 701}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "!?"), (None, passage), (4, passage), (4, passage), (5, long + " " + passage), (6, "a a a a"), (7, "P0-P1_p2É")]
    items = [(1, passage.upper().replace(" ", "--")), (1, passage), (2, None), (3, "..."), (None, "a a"), (4, "p2É")]
    run(spark, rows, items)


def test_empty_tables(spark):
    run(spark, [], [(1, "a")])
    run(spark, [(1, "a b")], [])


def test_no_python_in_the_plan(spark):
    docs, items = documents(spark, [(1, "a b")]), documents(spark, [(1, "a")], kind="item_id long, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)




def test_share(spark):
    df = spark.createDataFrame([(40, 2), (41, 2), (0, 0), (1, 1)], "n long, h long")
    got = df.select(decontaminate.contaminated(F.col("n"), F.col("h"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]
