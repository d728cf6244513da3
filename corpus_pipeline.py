"""From raw documents to packed token sequences, in stages that each write a table.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
what stays. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytide.llm import decontaminate, langid, near_dedup, packing, secrets
from daytide.llm.common import NO_ID
from daytide.llm.queries import table, tokenizer_path
from daytide.session import stage

#: Rows without an id are dealt by their texts to so many parts, so that they do not meet in one task.
NO_ID_PARTS = 1024


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learnt; rejected ones go.

    Null and empty texts, and texts without a letter, go; without any labelled row all do.
    Rows of null or repeated ids are judged each.
    """
    return langid.keep_known(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Repeated rows of it go as well. A null id comes before all others; texts without words
    are like nothing else and stay, each id once.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    every = F.sequence(F.lit(0), F.lit(NO_ID_PARTS - 1))
    parts = F.when(F.col("id") == NO_ID, every).otherwise(F.array(F.lit(0)))
    found = kept.distinct().select("id", F.explode(parts).alias("part"))
    # columns by position, as the table may have any other ones
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    own_id = F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NO_ID))
    part = F.pmod(F.xxhash64(at["text"]), F.lit(NO_ID_PARTS)).cast("int")
    own = docs.toDF(*at.values()).withColumn("id", own_id)
    own = own.withColumn("part", F.when(F.col("id") == NO_ID, part).otherwise(0))
    # the join deals rows by columns that repeated rows share, so texts move once
    stay = own.join(found, ["id", "part"], "left_semi")
    stay = stay.dropDuplicates(["id", "part", at["doc_id"], at["text"]])
    return stay.select(*at.values()).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts are clean. An empty benchmark leaves all rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts masked; n_chars follows the text.

    A null text stays null, with a null n_chars.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences.

    A null or empty text is the one token that ends a document; repeated rows are packed each.
    """
    return packing.pack(docs, tokenizer_path(), added=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The network of the first stage is not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage but it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
