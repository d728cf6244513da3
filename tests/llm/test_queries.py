"""The registered queries on the smallest tables, against SQL where SQL can express them."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from contract.compare import connect, differences
from daytide.llm import decontaminate, langid, near_dedup, packing, secrets
from daytide.llm import queries as Q
from daytide.llm.queries import table
from tests.llm.test_packing import placements

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    assert differences(connect(SF), Q.queries()[name](spark, SF), Q.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"op11_embedding_whitening"}))
def test_covers_the_table(spark, name):
    got = Q.queries()[name](spark, SF).select("doc_id").collect()
    want = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}
    assert {r.doc_id for r in got} == want


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.93), ("op5_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.queries()[name](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall()
    own = [got[d].predicted == y for d, y in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(own) >= least * len(own)


def test_pipeline_stage_by_stage(spark):
    """Each stage against the operators on the rows its predecessor kept."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontaminate", "secrets", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    known = stages["language_id"](spark, docs, SF).cache()
    pred = langid.predict(docs, langid.learn(docs))
    assert ids(known) == ids(pred.where("lang_pred <> 'und' AND score >= 0.3"))
    unique = stages["near_duplicates"](spark, known, SF).cache()
    assert ids(unique) == ids(near_dedup.near_duplicates(known).where("kept"))
    clean = stages["decontaminate"](spark, unique, SF).cache()
    marks = decontaminate.contamination(unique, table(spark, SF, "benchmark"))
    assert ids(clean) == ids(marks.where("NOT contaminated"))
    masked = stages["secrets"](spark, clean, SF).cache()
    assert ids(masked) == ids(clean)
    spans = {r.doc_id: r.spans for r in secrets.scan(clean).collect()}
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not spans[r.doc_id])
        assert not any(s.found in r.text for s in spans[r.doc_id] if len(s.found) > 12)
    for df in (known, unique, clean, masked):
        assert df.columns == docs.columns
    packed = stages["packing"](spark, masked, SF).collect()
    assert sorted({r.doc_id for r in packed}) == ids(masked)
    assert placements(packed, packing.SIZE) >= -(-sum(r.length for r in packed) // packing.SIZE)


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100
