"""A content-addressed web archive: payloads once, by strong digest; record headers apart.

``payloads`` holds each distinct payload once, under its SHA-256. ``headers`` holds the exact
header block of every WARC record and the digest of its payload. A record is read back by
joining the two: a response record is its header block, the payload and two line ends; a
revisit record has no payload of its own and names the record it refers to. Every payload
is hashed again when it is read, and a payload that does not have its digest fails the job.

Of the records with equal payloads of at least ``least`` bytes, that of the smallest page_id
is the response and the others revisit it; smaller payloads are always responses (and still
stored once). Payloads are gathered by digest, combined map-side, so one that a third of the
pages share is a row a task. Its headers are spread: a payload of many records is joined
from several copies, made when the archive is read, and each of its headers names one.

Defined cases: a null html is an empty payload; a null page_id comes before all others and
stays null; of repeated rows with the smallest page_id all are responses; control characters
in a URL become %20, a null URL is left out of the header; an empty table gives an empty
archive; other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytide.llm.common import NO_ID
from daytide.session import stage

LEAST = 100
#: Records that one copy of a payload is joined to; digests of more are at most MOST_HOT.
RECORDS_A_COPY = 10_000
MOST_HOT = 100_000
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column, digest: Column) -> Column:
    number = F.when(page == NO_ID, F.lit("")).otherwise(page.cast("string"))
    return F.concat(F.lit("<urn:page:"), number, F.lit(":"), digest, F.lit(">"))


def header(page: Column, url: Column, digest: Column, size: Column, first: Column, date: str) -> Column:
    """The header block of a record, up to and with its empty line."""
    revisit = first.isNotNull()
    uri = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page, digest)),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(first, digest))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(size).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))  # null lines are left out


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST,
    date: str = DATE,
    records_a_copy: int = RECORDS_A_COPY,
) -> None:
    """Write the two tables of an archive below ``path``."""
    given = pages.select(
        F.coalesce(F.col(page_id).cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = given.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    narrow = stage(narrow, "pages")
    limit = max(records_a_copy, narrow.count() // MOST_HOT)
    copies = F.ceil(F.count("*") / limit).cast("int")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), copies.alias("copies"))
    first = stage(first, "firsts")
    # at most MOST_HOT digests have more than ``limit`` records
    hot = F.broadcast(first.where("copies > 1"))
    calm = narrow.join(hot.select("digest"), "digest", "left_anti").join(first, "digest")
    records = calm.unionByName(narrow.join(hot, "digest"))
    refers = F.when((F.col("size") >= least) & (F.col("page_id") != F.col("first")), F.col("first"))
    block = header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers, date)
    salt = F.floor(F.rand(7) * F.col("copies")).cast("int")
    records.select("digest", salt.alias("salt"), block.alias("header")).write.parquet(f"{path}/headers")
    once = given.groupBy("digest").agg(F.first("payload").alias("payload"))
    once = once.join(first, "digest").select("digest", "copies", "payload")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str, pattern: str = "[^\r\n]*") -> Column:
    """A header field of the record; null if it is not there."""
    found = F.regexp_extract("header", rf"\r\n{name}: ({pattern})", 1)
    return F.when(F.col("header").contains(f"{END}{name}: "), found)


def _page(name: str) -> Column:
    number = F.regexp_extract(_field(name), r"^<urn:page:(-?[0-9]*):", 1)
    return F.when(number != "", number.cast("long"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, joined with their verified payloads.

    page_id, url, record_type, refers_to, payload_digest and header come from the header
    block, payload and payload_bytes from the store; ``record`` is the original record, byte
    for byte. Columns that are not asked for are not read, and the payloads then not moved.
    """
    kind = "digest string, copies int, payload binary"
    store = spark.read.schema(kind).parquet(f"{path}/payloads")
    broken = F.raise_error(F.concat(F.lit("payload does not have its digest: "), F.col("digest")))
    sound = F.sha2("payload", 256) == F.col("digest")
    size = F.when(sound, F.octet_length("payload").cast("long")).otherwise(broken.cast("long"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))
    store = store.select("digest", size.alias("payload_bytes"), "payload", every.alias("salt"))
    headers = spark.read.schema("digest string, salt int, header string").parquet(f"{path}/headers")
    both = headers.join(store, ["digest", "salt"], "left")
    own = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), own, F.encode(F.lit(END + END), "UTF-8"))
    return both.select(
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]*)$", 1).alias("payload_digest"),
        "payload_bytes",
        "payload",
        "header",
        record.alias("record"),
    )
