"""Wide <-> long helpers for small, declared sets of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: list[str], columns: list[str], value: str = "x") -> DataFrame:
    """(keys, feature, value), one row per input row and column."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*keys, *doubles).unpivot(keys, columns, "feature", value)


def small_table(df: DataFrame, key: str, max_rows: int = 1000) -> dict[str, dict[str, float]]:
    """A table of fitted parameters as {key: row}; refuses anything that is not small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} parameter rows")
    return {r[key]: r.asDict() for r in rows}
