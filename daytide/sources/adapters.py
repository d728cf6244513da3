"""The given test tables seen as wager events (whole tables, no row dropped).

Unknown ids, codes, balances and profits are planted through values the rows carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _events_from(table: DataFrame, **columns: str) -> DataFrame:
    return table.selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: many users with a few events on most days.

    ``props`` is always {"k": number}, so plain text functions replace JSON parsing.
    """

    def k_is(n: int) -> str:
        return "props = '{\"k\": %d}'" % n

    k = "int(substring_index(substring_index(props, ': ', -1), '}', 1))"
    bet = "if(event_type = 'signup', 0D, value)"
    payout = f"({bet} * {k} / 50D)"
    return _events_from(
        spark.read.parquet(f"{sf_dir}/events.parquet"),
        user_id="string(user_id)",
        event_id=f"if({k_is(5)}, NULL, string(event_id))",
        bullet_id="string(event_id + 1000000)",
        created_at="ts",
        bet=bet,
        payout=payout,
        profit=f"if(event_type = 'click', NULL, {payout} - {bet})",
        curr_balance=f"if({k_is(6)}, NULL, 1000D + value * 7)",
        op_code=f"CASE WHEN {k_is(0)} THEN NULL WHEN {k_is(1)} THEN 'TST' "
        f"WHEN {k_is(2)} THEN 'B26' ELSE 'A01' END",
        currency_type=f"if({k_is(3)}, 'USD', 'CNY')",
        game_id=f"if({k_is(4)}, 'FM02', 'FM01')",
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders``: long gaps between betting days, users with one day to many."""
    payout = "(o_totalprice / 1000 * (o_orderkey % 100) / 50)"
    return _events_from(
        spark.read.parquet(f"{sf_dir}/orders.parquet"),
        user_id="string(o_custkey)",
        event_id="string(o_orderkey)",
        bullet_id="string(NULL)",
        created_at="o_orderdate",
        bet="o_totalprice / 1000",
        payout=payout,
        profit=f"if(o_orderstatus = 'P', NULL, {payout} - o_totalprice / 1000)",
        curr_balance="o_totalprice / 10",
        op_code="'A01'",
        currency_type="'CNY'",
        game_id="'FM01'",
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` by supplier: the largest table, with many equal timestamps."""
    return _events_from(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
        user_id="string(l_suppkey)",
        event_id="concat_ws('-', l_orderkey, l_linenumber)",
        bullet_id="string(l_partkey)",
        created_at="l_shipdate",
        bet="l_quantity",
        payout="l_quantity * l_discount * 20",
        profit="double(NULL)",
        curr_balance="l_extendedprice",
        op_code="'A01'",
        currency_type="'CNY'",
        game_id="'FM01'",
    )
