"""Event sources, point lookup and typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytide import schema


def read_events(
    spark: SparkSession, path: str, fmt: str = "parquet", utc_date: str | None = None
) -> DataFrame:
    """Event table on files with the declared schema; only used columns are read.

    Name ``utc_date`` to keep that column of a table with one folder per UTC date.
    """
    table = schema.EVENT_SCHEMA
    if utc_date is not None:
        table = T.StructType([*table.fields, T.StructField(utc_date, T.DateType())])
    reader = spark.read.format(fmt).schema(table)
    if fmt == "csv":
        reader = reader.option("header", True)
    # folder columns of the table come along unless left out
    return reader.load(path).select(*table.names)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int | None = None,
    fetch_size: int = 50_000,
) -> dict[str, str]:
    """Options of a partitioned JDBC read; without a partition column it is one task."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None or partitions is None:
            raise ValueError("a partition column needs lower, upper and partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": str(partitions),
        }
    return options


def read_events_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Event table in a database; filters and columns are pushed into its query."""
    df = spark.read.format("jdbc").options(**options).load()
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema.EVENT_SCHEMA.fields))


def lookup_user(events: DataFrame, user_id, limit: int | None = None) -> DataFrame:
    """All columns of one user's events, ids compared as text.

    A limit takes the earliest events, so the answer is repeatable.
    """
    rows = events.where(F.col("user_id").cast("string") == F.lit(str(user_id)))
    if limit is None:
        return rows
    return rows.orderBy("created_at", F.coalesce("event_id", "bullet_id")).limit(int(limit))


def lookup_summary(rows: DataFrame, user_id) -> DataFrame:
    """(user_id, row_count, columns) of a lookup."""
    return rows.agg(F.count("*").alias("row_count")).select(
        F.lit(str(user_id)).alias("user_id"),
        "row_count",
        F.array(*(F.lit(c) for c in rows.columns)).alias("columns"),
    )


def output_columns(df: DataFrame) -> list[str]:
    """Header of a query; needs analysis only, no job."""
    return df.columns


def read_csv(spark: SparkSession, path: str, table: T.StructType) -> DataFrame:
    """CSV with a header and declared types; empty fields are missing, ids stay text."""
    return spark.read.schema(table).option("header", True).option("nullValue", "").csv(path)
