import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from daytide.llm import warc
from daytide.session import shared_dir
from tests.llm.helpers import documents

KIND = "page_id long, url string, html string"
BIG, SMALL = "<p>" + "ü" * 60 + "</p>", "<p>x</p>"
PAGES = [
    (9, "http://a/9", BIG), (4, "http://a/4", BIG), (7, None, BIG), (5, "http://a/5", SMALL), (6, "http://a/6", SMALL),
    (1, "http://a/1", None), (2, "http://a/\r\nX: y", ""), (3, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100),
    (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "long", "long " * 200_000),
]


def archive(spark, pages):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archive(documents(spark, pages, kind=KIND), path)
    return path


def test_round_trip(spark):
    path = archive(spark, PAGES)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(PAGES)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(html or "", page)
    for page, url, html in PAGES:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and first[html or ""] != page
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.refers_to == (first[html or ""] if revisit else None)
            assert bytes(r.payload) == payload
            head, _, body = bytes(r.record).partition(b"\r\n\r\n")
            assert head + b"\r\n\r\n" == r.header.encode()
            assert body == (b"" if revisit else payload) + b"\r\n\r\n"
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert int(fields["Content-Length"]) == (0 if revisit else len(payload))
            assert r.url == fields.get("WARC-Target-URI")
    assert by[7][0].url is None and by[2][0].url == "http://a/%20%20X: y"
    # each payload is stored once
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in PAGES})


def test_a_payload_of_many_records_is_joined_from_copies(spark):
    pages = [(i, f"http://a/{i}", BIG if i % 3 else f"own {i}") for i in range(90)] + [(200 + i, "e", None) for i in range(40)]
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    warc.write_archive(documents(spark, pages, kind=KIND).repartition(4), path, records_a_copy=7)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({p[2] or "" for p in pages})
    assert {r.copies for r in stored.collect()} == {1, 6, 9}
    spread = spark.read.parquet(f"{path}/headers").groupBy("digest", "salt").count()
    assert spread.agg(F.max("count")).first()[0] < 25
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        assert bytes(got[page].payload) == (html or "").encode()
        assert got[page].record_type == ("revisit" if html == BIG and page != 1 else "response")


def test_null_page_comes_first(spark):
    got = {r.page_id: r for r in warc.read_archive(spark, archive(spark, [(None, "n", BIG), (1, "a", BIG)])).collect()}
    assert got[None].record_type == "response" and got[1].record_type == "revisit"
    assert got[1].refers_to is None


def test_a_changed_payload_fails(spark):
    path = archive(spark, PAGES)
    spark.read.parquet(f"{path}/payloads").select("digest", F.encode(F.lit("changed"), "UTF-8").alias("payload")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, f"{path}-2").select("payload_bytes").collect()


def test_empty_table(spark):
    assert warc.read_archive(spark, archive(spark, [])).collect() == []


def test_narrow_reads_do_not_move_payloads(spark):
    out = warc.read_archive(spark, archive(spark, PAGES)).select("page_id", "payload_bytes")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "payload#" not in plan.split("Join")[0]
