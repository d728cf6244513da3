"""Column names, declared schemas and default parameters of every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# Default event filters.
EXCLUDED_OP_CODES = ("B26", "TST", "TSB", "TSO")
CURRENCY = "CNY"
GAME = "FM01"
UTC_OFFSET_HOURS = 8

# The ten model features, in order.
MODEL_FEATURES = [
    "bet_days_7d",
    "no_bet_streak_days",
    "bet_interval_day",
    "bet_amount_ratio_today_vs_history",
    "bet_count_ratio_today_vs_history",
    "avg_bet_one_time_today_log",
    "rtp_7_bet_days",
    "rtp_day",
    "max_consecutive_loss_count_today",
    "current_balance_max_to_avg_bet_ratio",
]
Z_FEATURES = [f"{c}_z" for c in MODEL_FEATURES]

# Constants that replace a missing feature before the median does.
CONSTANT_FILLS = {
    "bet_interval_day": 0.0,
    "bet_amount_ratio_today_vs_history": 1.0,
    "bet_count_ratio_today_vs_history": 1.0,
    "current_balance_max_to_avg_bet_ratio": 0.0,
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("bullet_id", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("bet", T.DoubleType()),
        T.StructField("payout", T.DoubleType()),
        T.StructField("profit", T.DoubleType()),
        T.StructField("curr_balance", T.DoubleType()),
        T.StructField("op_code", T.StringType()),
        T.StructField("currency_type", T.StringType()),
        T.StructField("game_id", T.StringType()),
    ]
)

BASE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("bet_date", T.DateType()),
        T.StructField("bet_count_today", T.LongType()),
        T.StructField("bet_amount_today", T.DoubleType()),
        T.StructField("avg_bet_one_time_today", T.DoubleType()),
        T.StructField("payout_today", T.DoubleType()),
        T.StructField("profit_today", T.DoubleType()),
        T.StructField("rtp_day", T.DoubleType()),
        T.StructField("bet_interval_day", T.DoubleType()),
        T.StructField("current_balance_day_max", T.DoubleType()),
        T.StructField("max_consecutive_loss_count_today", T.LongType()),
    ]
)

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("bet_date", T.DateType()),
        T.StructField("bet_days_7d", T.LongType()),
        T.StructField("no_bet_streak_days", T.IntegerType()),
        T.StructField("bet_interval_day", T.DoubleType()),
        T.StructField("bet_amount_ratio_today_vs_history", T.DoubleType()),
        T.StructField("bet_count_ratio_today_vs_history", T.DoubleType()),
        T.StructField("avg_bet_one_time_today_log", T.DoubleType()),
        T.StructField("rtp_7_bet_days", T.DoubleType()),
        T.StructField("rtp_day", T.DoubleType()),
        T.StructField("max_consecutive_loss_count_today", T.LongType()),
        T.StructField("current_balance_max_to_avg_bet_ratio", T.DoubleType()),
        T.StructField("bet_count_today", T.LongType()),
        T.StructField("bet_amount_today", T.DoubleType()),
        T.StructField("payout_today", T.DoubleType()),
        T.StructField("profit_today", T.DoubleType()),
        T.StructField("current_balance_day_max", T.DoubleType()),
    ]
)
FEATURE_COLUMNS = FEATURE_SCHEMA.names

Z_SCHEMA = T.StructType(
    FEATURE_SCHEMA.fields[:2] + [T.StructField(c, T.DoubleType()) for c in Z_FEATURES]
)


def require_columns(df, schema: T.StructType):
    """Return df in the declared column order and types; fail early on a mismatch."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise ValueError(f"missing column {field.name}")
        if have[field.name] != field.dataType:
            raise TypeError(
                f"column {field.name} is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df.select(*schema.names)
