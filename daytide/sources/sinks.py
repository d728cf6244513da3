"""Writers for tables, labelled matrices and small JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by_date: bool = False) -> None:
    """Parquet, optionally one folder per date. Rows are first brought together by date,
    spread over several tasks, so that no folder gets a file from every task."""
    if not by_date:
        df.write.mode("overwrite").parquet(path)
        return
    # rebalance lets Spark split a date that is much larger than the others
    df.hint("rebalance", "bet_date").write.mode("overwrite").partitionBy("bet_date").parquet(path)


def _indexed(df: DataFrame, row_group: int | None):
    """Parquet writer with a Bloom filter on the user, for lookups of one of them."""
    writer = df.write.mode("overwrite").option("parquet.bloom.filter.enabled#user_id", "true")
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    return writer


def write_sorted(df: DataFrame, path: str, row_group: int | None = None) -> None:
    """Parquet in order of (user_id, bet_date): the files hold ranges that follow each other,
    so a lookup of one user reads few of them. ``row_group`` is in bytes."""
    keys = ["user_id", "bet_date"]
    _indexed(df.repartitionByRange(*keys).sortWithinPartitions(*keys), row_group).parquet(path)


def write_events(events: DataFrame, path: str, utc_date: str = "utc_date", row_group: int | None = None) -> None:
    """Events as parquet, one folder per UTC date, in order of users within it.

    A date range reads its folders, a lookup of one user the row groups that may have it (by
    their range of users and by Bloom filter). Ranges are cut by time too, so a user with
    many events is spread over tasks. Events without a time go to the null folder.
    """
    keys = [utc_date, "user_id", "created_at"]
    dated = events.withColumn(utc_date, F.to_date("created_at"))
    ordered = dated.repartitionByRange(*keys).sortWithinPartitions(*keys)
    _indexed(ordered, row_group).partitionBy(utc_date).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; missing values are empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_matrix_csv(
    cells: DataFrame, row: str, column: str, value: str, labels: list, path: str, prefix: str = ""
) -> None:
    """Long cells as a square CSV with row labels in its first column."""
    wide = matrix(cells, row, column, value, labels, prefix)
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def matrix(
    cells: DataFrame, row: str, column: str, value: str, labels: list, prefix: str = ""
) -> DataFrame:
    """Long cells pivoted to one labelled row per row key, in label order."""
    wide = cells.groupBy(row).pivot(column, labels).agg(F.first(value))
    place = F.array_position(F.array(*(F.lit(v) for v in labels)), F.col(row))
    return wide.orderBy(place).select(
        F.concat(F.lit(prefix), F.col(row).cast("string")).alias("label"),
        *(F.col(str(v)).alias(f"{prefix}{v}") for v in labels),
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per row (statistics per feature, run summary, metadata)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
