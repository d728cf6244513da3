"""Each stage of the pipeline on hostile tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import CLASHING

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=()):
    df = spark.createDataFrame(rows, KIND)
    for name in [*CLASHING, "kept_id", "letters", "found", "own", *extra]:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="module")
def rows():
    some = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    first = some[0]
    hostile = [(None, None, None, None, None), (None, first[1], first[2], "s", 1), (901, "", "en", None, 0), (902, None, "en", "s", None)]
    return some + hostile + [first, first, (903, first[1], first[2], "s", 1), (904, "12 34", None, "s", 5)]


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    assert STAGES[name](spark, table(spark, []), SF).count() == 0


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_nulls_repeated_rows_and_clashing_columns(spark, rows, name):
    docs = table(spark, rows)
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    given = [(r[0], r[1]) for r in rows]
    ids = [d for d, _ in found]
    if name == "secrets":
        assert sorted(map(str, ids)) == sorted(str(d) for d, _ in given)
        assert all(r.n_chars is None for r in got.where("text IS NULL").collect())
        return
    assert all(row in given for row in found)
    if name == "language_id":
        assert all(t for _, t in found) and 904 not in ids and ids.count(rows[0][0]) == 3
    if name == "near_duplicates":
        # of the copies of the first text, the row without an id comes first
        assert 903 not in ids and rows[0][0] not in ids and len(found) == len(set(found))
        assert {901, 902} <= set(ids)
    if name == "decontaminate":
        assert {901, 902, 904} <= set(ids) and ids.count(rows[0][0]) in (0, 3)


def test_near_duplicates_move_texts_once(spark, rows, tmp_path):
    """The join with the kept ids and the dropping of repeated rows share one exchange."""
    table(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many ids
    try:
        plan = STAGES["near_duplicates"](spark, docs, SF)._jdf.queryExecution().executedPlan()
        depth, moves = [], 0
        for line in plan.toString().splitlines():
            at = len(line) - len(line.lstrip(" :+-"))
            depth = [d for d in depth if d[0] < at] + [(at, "Exchange hash" in line)]
            if "docs" in line and "Scan" in line:
                moves = sum(moved for _, moved in depth)
        assert moves == 1, plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_near_duplicates_without_ids(spark):
    """Rows without an id stay, each text once; they take the rows with one that are like them."""
    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(300)]
    rows = [(None, t, "en", "s", 1) for t in texts] * 2
    rows += [(i, t, "en", "s", 1) for i, t in enumerate(texts[:50])] + [(900, "other words", "en", "s", 1)] * 3
    found = [(r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, table(spark, rows), SF).collect()]
    assert len(found) == 301 and set(found) == {(None, t) for t in texts} | {(900, "other words")}


def test_packing_of_hostile_rows(spark, rows):
    got = STAGES["packing"](spark, table(spark, rows), SF).collect()
    pieces = [r for r in got if r.piece == 0]
    assert sorted(str(r.doc_id) for r in pieces) == sorted(str(r[0]) for r in rows)
    assert [r.length for r in pieces if r.doc_id in (901, 902)] == [1, 1]
