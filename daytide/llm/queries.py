"""The registered query of each operator: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytide.llm import oracle
from daytide.llm import (
    decontaminate,
    filter_audit,
    fingerprint,
    langid,
    lm,
    near_dedup,
    packing,
    quality,
    secrets,
    substring_dedup,
    toxicity,
    warc,
    whitening,
)
from daytide.llm.common import held_out
from daytide.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Every document without the words that windows of earlier documents have."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_decontaminate(spark, sf_dir):
    """Words of every document that windows of benchmark items cover."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_quality(spark, sf_dir):
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, compared with each other and the next."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark, sf_dir):
    """Every document's token pieces with their place in sequences of 2048 tokens."""
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_warc(spark, sf_dir):
    """Every page written to an archive and read back, with the digest of its rebuilt record."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    out = warc.read_archive(spark, path)
    return out.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
    )


def op8_near_dedup(spark, sf_dir):
    """Components of documents that share four fifths of their four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_secret_scan(spark, sf_dir):
    """Secrets of every document: base kinds, and strings of high entropy."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base, spans = secrets.listed(F.col("base")), secrets.listed(F.col("spans"))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op10_language_id(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_embedding_whitening(spark, sf_dir):
    """Every vector on the leading principal components, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    """Counts of every step of every order of five filters, for each source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark, sf_dir):
    """Log-likelihood of every document under a recurrent model and under word counts."""
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = [
    op1_substring_dedup,
    op2_decontaminate,
    op3_quality,
    op4_fingerprints,
    op5_toxicity,
    op6_best_fit_packing,
    op7_warc,
    op8_near_dedup,
    op9_secret_scan,
    op10_language_id,
    op11_embedding_whitening,
    op12_filter_audit,
    op13_lm_scoring,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
