"""Events -> one row per user and local day, including the longest losing run.

The longest run needs the events of a user-day in time order, but a user-day may hold
a large part of all events. A sketch of the frequent user-days, of fixed size for each
task, names the candidates for being too large for a task; only their events are counted.
Large user-days are cut into time chunks, and chunks that are still too large by range,
after events that are equal in order are added up. Every chunk (an ordinary user-day is a
single one) is ordered by its own task and reduced to one row, and only these rows are put
together per user. A run crossing chunks is the trailing run of one chunk plus the leading
runs after it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytide import schema
from daytide.functions.columns import (
    local_timestamp,
    nan_to_null,
    second_of_day,
    second_steps,
    utc_bounds,
)
from daytide.session import stage

#: Events of one user-day, or of one chunk of it, that a task orders without trouble.
DAY_LIMIT = 1_000_000
#: Events, and user-days made of them, that a task takes on average. Tasks grow in number with
#: the table, so that what one of them sorts and holds does not grow.
TASK_EVENTS = 50_000
#: Keys that the sketch of frequent keys holds. A key with more than one in 18,000 of all
#: rows is always among its candidates; a key below that is no hot spot of its table.
SKETCH_KEYS = 65_536
#: Tasks whose sketches are merged first.
TOGETHER = 64
#: Rows up to which a table of large user-days is broadcast; there are at most rows / limit.
BROADCAST_ROWS = 100_000
EVENT_ORDER = ["ts_local", "event_sort_id", "is_loss"]
DAY_KEYS = ["user_id", "bet_date"]

# Partial totals that are added up again at every level.
SUMMED = ("n", "bet", "bets", "payout", "profit")
EXTREMES = {"balance": "max(balance)", "first_ts": "min(first_ts)", "last_ts": "max(last_ts)"}
TOTALS = {c: f"sum({c})" for c in SUMMED} | EXTREMES


def _aggregate(grouped, **exprs: str) -> DataFrame:
    return grouped.agg(*(F.expr(sql).alias(name) for name, sql in exprs.items()))


def filter_events(
    events: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    offset_hours: int = schema.UTC_OFFSET_HOURS,
    excluded_op_codes=schema.EXCLUDED_OP_CODES,
    currency: str | None = schema.CURRENCY,
    game: str | None = schema.GAME,
    utc_date_column: str | None = None,
) -> DataFrame:
    """Events of the wanted local dates [start, end), game and currency.

    The date range is turned into bounds on the raw ``created_at``, so it reaches the
    scan. If the table is partitioned by UTC date, name that column: folders outside the
    range are then not listed or read. An unknown (NULL) op_code is dropped, as
    ``NOT IN`` does.
    """
    out = events.where(~F.col("op_code").isin(*excluded_op_codes))
    if currency is not None:
        out = out.where(F.col("currency_type") == currency)
    if game is not None:
        out = out.where(F.col("game_id") == game)
    at = F.col("created_at")
    day = None if utc_date_column is None else F.col(utc_date_column)
    if start_date is not None:
        lo, _ = utc_bounds(start_date, start_date, offset_hours)
        out = out.where(at >= F.lit(str(lo)).cast("timestamp_ntz"))
        if day is not None:
            out = out.where(day >= F.lit(lo.date()))
    if end_date is not None:
        _, hi = utc_bounds(end_date, end_date, offset_hours)
        out = out.where(at < F.lit(str(hi)).cast("timestamp_ntz"))
        if day is not None:
            out = out.where(day <= F.lit(hi.date()))
    return out


def local_events(events: DataFrame, offset_hours: int = schema.UTC_OFFSET_HOURS) -> DataFrame:
    """Project filtered events to typed columns with local time and a loss flag.

    The sort id is compared as text ("10" before "9"). An unknown profit is not a loss.
    """
    ts = local_timestamp(F.col("created_at"), offset_hours)

    def money(name: str):
        return nan_to_null(F.col(name).cast("double"))

    profit = F.coalesce(money("profit"), money("payout") - money("bet"))
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.to_date(ts).alias("bet_date"),
        ts.alias("ts_local"),
        F.coalesce(
            F.col("event_id").cast("string"), F.col("bullet_id").cast("string"), F.lit("")
        ).alias("event_sort_id"),
        money("bet").alias("bet"),
        money("payout").alias("payout"),
        profit.alias("profit"),
        money("curr_balance").alias("curr_balance"),
        F.when(profit < 0, 1).otherwise(0).cast("long").alias("is_loss"),
    )


@dataclass(frozen=True)
class Cuts:
    """User-days, and chunks of them, with more events than a task should order."""

    days: DataFrame | None = None
    chunks: DataFrame | None = None
    chunk_seconds: int = 60
    #: Tasks that share the events, from their number.
    tasks: int | None = field(default=None, compare=False)


def task_count(events: int) -> int:
    return max(2, math.ceil(events / TASK_EVENTS))


def _frequent(df: DataFrame, keys: list[str], least: int) -> tuple[list[int], int]:
    """``frequent_keys`` and the number of rows, which the same pass counts."""
    task = F.floor(F.spark_partition_id() / TOGETHER)
    tagged = df.select(F.xxhash64(*keys).alias("key"), task.alias("together"))
    own = F.expr(f"approx_top_k_accumulate(key, {SKETCH_KEYS})")
    merged = F.expr(f"approx_top_k_combine(sketch, {SKETCH_KEYS})")
    sketches = tagged.groupBy("together").agg(own.alias("sketch"), F.count("*").alias("rows"))
    # grouped, as an empty table has no sketch to merge
    whole = sketches.groupBy(F.lit(0).alias("all")).agg(merged.alias("sketch"), F.sum("rows").alias("rows"))
    items = F.expr(f"approx_top_k_estimate(sketch, {SKETCH_KEYS})")
    found = whole.select("rows", F.filter(items, lambda i: i["count"] > least)["item"].alias("items")).collect()
    return (found[0]["items"], found[0]["rows"]) if found else ([], 0)


def frequent_keys(df: DataFrame, keys: list[str], least: int) -> list[int]:
    """Hashes of the keys that may have more than ``least`` rows, by a mergeable sketch.

    Each task sends a sketch of at most SKETCH_KEYS counters, never its keys. The sketch
    overestimates, so nothing frequent is missed; the caller counts what is named.
    """
    return _frequent(df, keys, least)[0]


def _over(events: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, int]:
    """Keys with more than ``limit`` events as a written table, None if there are none; all events."""
    hashes, rows = _frequent(events, keys, limit)
    if not hashes:
        return None, rows
    # at most as many as the sketch holds
    named = F.broadcast(events.sparkSession.createDataFrame([(h,) for h in hashes], "named long"))
    some = events.join(named, F.xxhash64(*keys) == F.col("named"), "left_semi")
    counts = some.groupBy(*keys).agg(F.count("*").alias("n"))
    large = stage(counts.where(F.col("n") > limit).select(*keys), "large")
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return None, rows
    return F.broadcast(large) if n <= BROADCAST_ROWS else large, rows


def find_cuts(events: DataFrame, limit: int = DAY_LIMIT, chunk_seconds: int = 60) -> Cuts:
    """The large user-days, and the large chunks within them."""
    days, rows = _over(events, DAY_KEYS, limit)
    tasks = task_count(rows)
    if days is None:
        return Cuts(chunk_seconds=chunk_seconds, tasks=tasks)
    inside = _chunked(events, Cuts(days, None, chunk_seconds)).where("chunk >= 0")
    return Cuts(days, _over(inside, [*DAY_KEYS, "chunk"], limit)[0], chunk_seconds, tasks)


def _shared(cuts: Cuts, events: DataFrame) -> Cuts:
    """Cuts that tell the number of tasks; cuts made by hand may not."""
    return cuts if cuts.tasks else replace(cuts, tasks=task_count(events.count()))


def _same(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}"))
    return out


def _chunked(events: DataFrame, cuts: Cuts) -> DataFrame:
    """Add ``chunk``: -1, or in a large user-day the place of its time chunk."""
    if cuts.days is None:
        return events.withColumn("chunk", F.lit(-1))
    large = cuts.days.withColumn("large", F.lit(True))
    found = events.alias("e").join(large.alias("l"), _same(DAY_KEYS), "left")
    chunk = F.floor(second_of_day(F.col("e.ts_local")) / cuts.chunk_seconds).cast("int")
    return found.select("e.*", F.when(F.col("l.large"), chunk).otherwise(-1).alias("chunk"))


def _weighed(events: DataFrame) -> DataFrame:
    """Events as rows that stand for ``n`` of them, ``bets`` with a known bet."""
    return events.withColumn("n", F.lit(1).cast("long")).withColumn(
        "bets", F.col("bet").isNotNull().cast("long")
    )


def _added_up(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events that are equal in time, id and flag as one row: no order among them matters.

    They are added up before the exchange, so that one instant without ids is a row a task.
    """
    return _aggregate(
        events.groupBy(*keys, *EVENT_ORDER),
        n="count(*)",
        bets="count(bet)",
        bet="sum(bet)",
        payout="sum(payout)",
        profit="sum(profit)",
        curr_balance="max(curr_balance)",
    )


def _with_pieces(events: DataFrame, cuts: Cuts, added_up: bool = False) -> DataFrame:
    """Add ``chunk`` and ``piece``: 0, or for a large chunk its place in a range partitioning.

    Range partitioning by the full event order cuts a chunk between any two events that
    differ in it. With ``added_up`` those that do not are one weighed row.
    """
    chunked = _chunked(events, cuts)
    if cuts.chunks is None:
        return chunked.withColumn("piece", F.lit(0))
    keys = [*DAY_KEYS, "chunk"]
    e, large = chunked.alias("e"), cuts.chunks.alias("l")
    calm = e.join(large, _same(keys), "left_anti")
    hot = e.join(large, _same(keys), "left_semi")
    if added_up:
        calm, hot = _weighed(calm), _added_up(hot, keys)
    own = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = [cuts.tasks] if (cuts.tasks or 0) > own else []
    split = hot.repartitionByRange(*ranges, *keys, *EVENT_ORDER).withColumn("piece", F.spark_partition_id())
    return calm.withColumn("piece", F.lit(0)).unionByName(split)


CHUNK_KEYS = [*DAY_KEYS, "chunk", "piece"]


def _chunk_runs(pieces: DataFrame, cuts: Cuts, breaks: str = "1 - is_loss") -> DataFrame:
    """Running count of non-losing events within each chunk: constant along a run."""
    # constant columns are no keys to Spark's planner, which would add an exchange for them
    keys = [*DAY_KEYS, *(["chunk"] if cuts.days is not None else []), *(["piece"] if cuts.chunks is not None else [])]
    pieces = pieces.repartition(cuts.tasks, *keys)
    run = (
        Window.partitionBy(*CHUNK_KEYS)
        .orderBy(*EVENT_ORDER)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return pieces.withColumn("loss_group", F.sum(F.expr(breaks)).over(run))


def loss_groups(events: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Events with the running count of non-losing events of their user-day.

    A prefix sum over chunks: counts per chunk are added up per user-day and joined back
    to the events, which only ever are ordered within their chunk. Events that are equal in
    time, id and flag stay in one chunk here, as each gets its own count.
    """
    cuts = _shared(cuts or find_cuts(events), events)
    pieces = _with_pieces(events, cuts)
    if cuts.chunks is not None:
        # Both uses below must see the same range partitions.
        pieces = stage(pieces, "pieces")
    earlier = (
        Window.partitionBy("user_id", "bet_date")
        .orderBy("chunk", "piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        pieces.groupBy(*CHUNK_KEYS)
        .agg(F.sum(1 - F.col("is_loss")).alias("breaks"))
        .withColumn("before", F.coalesce(F.sum("breaks").over(earlier), F.lit(0)))
        .drop("breaks")
    )
    runs, before = _chunk_runs(pieces, cuts).alias("e"), before.alias("l")
    return runs.join(before, _same(CHUNK_KEYS)).select(
        *(F.col(f"e.{c}") for c in events.columns),
        (F.col("e.loss_group") + F.col("l.before")).alias("loss_group"),
    )


def loss_runs(grouped: DataFrame) -> DataFrame:
    """(user_id, bet_date, loss_group, run_length) of the losing events."""
    return (
        grouped.where("is_loss = 1")
        .groupBy("user_id", "bet_date", "loss_group")
        .agg(F.count("*").alias("run_length"))
    )


def chunk_summaries(events: DataFrame, cuts: Cuts) -> DataFrame:
    """One row per (user, day, chunk, piece): partial totals and the shape of its runs.

    ``lead`` and ``trail`` are the losing runs touching the start and end of the chunk,
    ``breaks`` its number of non-losing events. One exchange, on the grouping keys.
    """
    cuts = _shared(cuts, events)
    pieces = _with_pieces(events, cuts, added_up=True)
    weighed = cuts.chunks is not None
    breaks = "(1 - is_loss) * n" if weighed else "1 - is_loss"
    runs = _aggregate(
        _chunk_runs(pieces, cuts, breaks).groupBy(*CHUNK_KEYS, "loss_group"),
        n="sum(n)" if weighed else "count(*)",
        losses="sum(is_loss * n)" if weighed else "sum(is_loss)",
        bet="sum(bet)",
        bets="sum(bets)" if weighed else "count(bet)",
        payout="sum(payout)",
        profit="sum(profit)",
        balance="max(curr_balance)",
        first_ts="min(ts_local)",
        last_ts="max(ts_local)",
    )
    return _aggregate(
        runs.groupBy(*CHUNK_KEYS),
        **TOTALS,
        breaks="max(loss_group)",
        longest="max(losses)",
        lead="coalesce(max(if(loss_group = 0, losses, NULL)), 0L)",
        trail="max_by(losses, loss_group)",
    )


def user_day_base(events: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """User-day metrics from ``local_events`` rows.

    Two exchanges: events by user-day (or chunk of a large one), then their summaries by
    user, one row for each user-day but the large ones. The second one also serves all
    per-user windows that follow. ``cuts`` is found by a pass with a sketch if not given.
    """
    cuts = _shared(cuts or find_cuts(events), events)
    chunks = chunk_summaries(events, cuts).repartition(cuts.tasks, "user_id")
    earlier = (
        Window.partitionBy("user_id", "bet_date")
        .orderBy("chunk", "piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A run that touches chunk borders is numbered by the broken chunks before it: the
    # leading part of a chunk belongs to run r, the trailing part of a broken one to r+1.
    # The totals of a chunk go with its leading part.
    parts = chunks.withColumn(
        "r", F.coalesce(F.sum((F.col("breaks") > 0).cast("int")).over(earlier), F.lit(0))
    ).withColumn(
        "part",
        F.expr(
            "explode(if(breaks > 0,"
            " array(struct(r AS run, lead AS len, true AS main),"
            "       struct(r + 1 AS run, trail AS len, false AS main)),"
            " array(struct(r AS run, lead AS len, true AS main))))"
        ),
    )
    spans = _aggregate(
        parts.groupBy("user_id", "bet_date", "part.run"),
        **{c: f"sum({c}) FILTER (WHERE part.main)" for c in SUMMED},
        **EXTREMES,
        span="sum(part.len)",
        longest="max(longest)",
    )
    days = _aggregate(
        spans.groupBy("user_id", "bet_date"), **TOTALS, longest="max(greatest(span, longest))"
    )
    seconds = second_steps(F.col("first_ts"), F.col("last_ts"))
    return days.withColumn("seconds", seconds.cast("double")).selectExpr(
        "user_id",
        "bet_date",
        "n AS bet_count_today",
        "bet AS bet_amount_today",
        "bet / nullif(bets, 0) AS avg_bet_one_time_today",
        "payout AS payout_today",
        "profit AS profit_today",
        "if(bet > 0, payout / bet, NULL) AS rtp_day",
        "if(n > 1, seconds / nullif(n - 1, 0), NULL) AS bet_interval_day",
        "balance AS current_balance_day_max",
        "longest AS max_consecutive_loss_count_today",
    )
