import random
from datetime import datetime, timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from daytide import schema
from daytide.operators import daily
from daytide.plans.workflow import features_from_events

NOON = datetime(2026, 1, 5, 4)  # local noon


def base_rows(events, chunk_seconds=60, limit=daily.DAY_LIMIT):
    local = daily.local_events(daily.filter_events(events))
    base = daily.user_day_base(local, daily.find_cuts(local, limit, chunk_seconds))
    base = schema.require_columns(base, schema.BASE_SCHEMA)
    return sorted(base.collect(), key=lambda r: (r.user_id, r.bet_date))


def longest_run(make_events, profits, **kw):
    rows = [
        {"event_id": str(i), "created_at": NOON + timedelta(seconds=40 * i), **p}
        for i, p in enumerate(profits)
    ]
    (row,) = base_rows(make_events(rows), **kw)
    return row.max_consecutive_loss_count_today


@pytest.mark.parametrize("chunk", [1, 60, 86_400])
def test_run_is_broken_by_zero(make_events, chunk):
    profits = [{"profit": p} for p in (-1.0, -1.0, 0.0, -1.0)]
    assert longest_run(make_events, profits, chunk_seconds=chunk, limit=1) == 2


@pytest.mark.parametrize("chunk", [1, 60, 86_400])
def test_run_is_broken_by_unknown_profit(make_events, chunk):
    profits = [{"profit": -1.0}, {"profit": None, "bet": None}, {"profit": -1.0}]
    assert longest_run(make_events, profits, chunk_seconds=chunk, limit=1) == 1


def test_no_loss(make_events):
    assert longest_run(make_events, [{"profit": 1.0}, {"profit": 2.0}]) == 0


def test_profit_falls_back_to_payout_minus_bet(make_events):
    assert longest_run(make_events, [{"bet": 2.0, "payout": 1.0}] * 3) == 3


def test_one_event_has_no_interval(make_events):
    (row,) = base_rows(make_events([{"created_at": NOON}]))
    assert row.bet_interval_day is None
    assert row.bet_count_today == 1


def test_interval_counts_second_boundaries(make_events):
    times = [NOON + timedelta(milliseconds=ms) for ms in (900, 2100)]
    (row,) = base_rows(make_events([{"created_at": t} for t in times]))
    assert row.bet_interval_day == 2.0


def test_zero_stake_day_has_no_rtp(make_events):
    (row,) = base_rows(make_events([{"created_at": NOON, "bet": 0.0, "payout": 3.0}]))
    assert row.rtp_day is None


def test_equal_timestamps_are_ordered_by_id_as_text(make_events):
    # text order: 10 (loss), 11 (loss), 9 (win), 90 (loss)
    profit = {"9": 1.0, "10": -1.0, "11": -1.0, "90": -1.0}
    rows = [{"event_id": i, "created_at": NOON, "profit": p} for i, p in profit.items()]
    (row,) = base_rows(make_events(rows))
    assert row.max_consecutive_loss_count_today == 2


def test_bullet_id_orders_when_event_id_is_missing(make_events):
    rows = [
        {"event_id": None, "bullet_id": "a", "created_at": NOON, "profit": -1.0},
        {"event_id": None, "bullet_id": "c", "created_at": NOON, "profit": -1.0},
        {"event_id": "b", "created_at": NOON, "profit": 1.0},
    ]
    (row,) = base_rows(make_events(rows))
    assert row.max_consecutive_loss_count_today == 1


def test_filters(make_events):
    rows = [
        {"created_at": NOON, "op_code": "TST"},
        {"created_at": NOON, "op_code": None},
        {"created_at": NOON, "currency_type": "USD"},
        {"created_at": NOON, "game_id": "FM02"},
        {"created_at": NOON, "game_id": None},
        {"created_at": NOON, "user_id": "kept"},
    ]
    assert [r.user_id for r in base_rows(make_events(rows))] == ["kept"]


def test_date_bounds_are_half_open_local_midnights(make_events):
    lower, upper = datetime(2026, 1, 4, 16), datetime(2026, 1, 5, 16)
    tick = timedelta(microseconds=1)
    rows = [
        {"user_id": name, "created_at": at}
        for name, at in {
            "before": lower - tick,
            "first": lower,
            "last": upper - tick,
            "after": upper,
        }.items()
    ]
    kept = daily.filter_events(make_events(rows), "2026-01-05", "2026-01-06")
    days = daily.local_events(kept).select("user_id", F.col("bet_date").cast("string"))
    assert sorted(map(tuple, days.collect())) == [("first", "2026-01-05"), ("last", "2026-01-05")]


def test_nan_amounts_are_missing(make_events):
    rows = [
        {"created_at": NOON, "bet": float("nan"), "event_id": "1"},
        {"created_at": NOON, "bet": 4.0, "payout": 2.0, "event_id": "2"},
    ]
    (row,) = base_rows(make_events(rows))
    assert (row.bet_amount_today, row.avg_bet_one_time_today) == (4.0, 4.0)


def random_events(seed, n=3000):
    """Half of the events in one user-day, many of them in one minute or one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < 0.5:
            user, at = "hot", NOON + timedelta(seconds=rng.choice([0, 0, 7, 30, 59, 300, 4000]))
        else:
            user = f"u{rng.randrange(8)}"
            at = NOON + timedelta(seconds=rng.randrange(3 * 86_400))
        profit = rng.choices([-1.0, 0.0, 2.0, None], [8, 1, 1, 0.3])[0]
        rows.append(
            {
                "user_id": user,
                "event_id": str(i),
                "created_at": at,
                "bet": None if profit is None else 1.0,
                "profit": profit,
            }
        )
    return rows


def expected_runs(rows):
    def place(r):
        local = r["created_at"] + timedelta(hours=8)
        return r["user_id"], local.date()

    out = {}
    for key, events in groupby(sorted(rows, key=place), key=place):
        events = sorted(events, key=lambda r: (r["created_at"], r["event_id"]))
        losses = [r["profit"] is not None and r["profit"] < 0 for r in events]
        runs = [len(list(g)) for lost, g in groupby(losses) if lost]
        out[key] = (len(losses), max(runs, default=0))
    return out


@pytest.mark.parametrize("chunk", [1, 60, 3600])
def test_runs_match_brute_force(make_events, chunk):
    rows = random_events(chunk)
    got = {
        (r.user_id, r.bet_date): (r.bet_count_today, r.max_consecutive_loss_count_today)
        for r in base_rows(make_events(rows), chunk_seconds=chunk, limit=100)
    }
    assert got == expected_runs(rows)


def test_large_days_and_chunks_are_split_without_changing_results(spark, make_events):
    rows = random_events(5)
    local = daily.local_events(daily.filter_events(make_events(rows))).repartition(5)
    cuts = daily.find_cuts(local, limit=20)
    assert 0 < cuts.days.count() <= len(rows) // 20 and 0 < cuts.chunks.count() <= len(rows) // 20
    # At this size Spark would merge the range partitions again.
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        pieces = daily.chunk_summaries(local, cuts)
        first_minute = pieces.where("user_id = 'hot' AND n > 20").agg(F.count("*"), F.max("n"))
        assert first_minute.first()[0] >= 3 and first_minute.first()[1] < 700
    finally:
        spark.conf.set(merging, "true")
    got = {
        (r.user_id, r.bet_date): (r.bet_count_today, r.max_consecutive_loss_count_today)
        for r in daily.user_day_base(local, cuts).collect()
    }
    assert got == expected_runs(rows)


def test_second_exchange_carries_one_row_for_each_ordinary_user_day(make_events):
    rows = [r for r in random_events(8) if r["user_id"] != "hot"]
    local = daily.local_events(daily.filter_events(make_events(rows)))
    cuts = daily.find_cuts(local)
    assert cuts.days is None and cuts.chunks is None
    assert daily.chunk_summaries(local, cuts).count() == len(expected_runs(rows))


def test_one_large_day_is_the_only_one_cut(make_events):
    rows = random_events(8)
    local = daily.local_events(daily.filter_events(make_events(rows)))
    cuts = daily.find_cuts(local, limit=1000)
    assert [r.user_id for r in cuts.days.collect()] == ["hot"]
    per_day = daily.chunk_summaries(local, cuts).groupBy("user_id", "bet_date").count()
    assert per_day.where("user_id <> 'hot' AND count > 1").isEmpty()
    assert not per_day.where("user_id = 'hot' AND count >= 3").isEmpty()


def test_frequent_keys_are_named_and_no_keys_are_sent(spark, make_events):
    rows = random_events(5)
    local = daily.local_events(daily.filter_events(make_events(rows))).repartition(4)
    counts = {tuple(r[:2]): r[2] for r in local.groupBy(*daily.DAY_KEYS).count().collect()}
    found = set(daily.frequent_keys(local, daily.DAY_KEYS, 20))
    named = local.select(*daily.DAY_KEYS, F.xxhash64(*daily.DAY_KEYS).alias("h")).distinct().collect()
    assert {tuple(r[:2]) for r in named if r.h in found} >= {k for k, n in counts.items() if n > 20}
    assert daily.frequent_keys(local.where("false"), daily.DAY_KEYS, 20) == []
    ids = spark.range(200_000).select(F.col("id").alias("user_id"), F.lit(1).alias("bet_date"))
    many = ids.unionAll(ids.where("id < 5000").withColumn("user_id", F.lit(-1).cast("long")))
    assert len(daily.frequent_keys(many, daily.DAY_KEYS, 4000)) == 1


def test_one_instant_without_ids_is_a_row_a_task(make_events):
    """Equal events cannot be cut by order: they are added up before they are moved."""
    rows = [
        {"user_id": "hot", "event_id": None, "bullet_id": None, "created_at": NOON, "bet": 2.0, "profit": -1.0 if i % 3 else 1.0}
        for i in range(600)
    ]
    rows += [{"user_id": "u", "event_id": str(i), "created_at": NOON, "profit": -1.0} for i in range(9)]
    local = daily.local_events(daily.filter_events(make_events(rows))).repartition(4)
    cuts = daily.find_cuts(local, limit=100)
    pieces = daily._with_pieces(local, cuts, added_up=True).where("user_id = 'hot'")
    assert pieces.count() == 2 and pieces.agg(F.sum("n")).first()[0] == 600
    got = {r.user_id: r for r in daily.user_day_base(local, cuts).collect()}
    assert got["hot"].bet_count_today == 600 and got["hot"].bet_amount_today == 1200.0
    assert got["hot"].max_consecutive_loss_count_today == 400  # losses come after the others
    assert got["u"].max_consecutive_loss_count_today == 9


def test_no_user_day_counts_are_shuffled_without_large_days(spark, make_events):
    """One job with sketches as its only aggregates, and nothing written."""
    local = daily.local_events(daily.filter_events(make_events(random_events(8))))
    counted = []
    real = daily.stage
    daily.stage = lambda *a: counted.append(a) or real(*a)
    try:
        assert daily.find_cuts(local) == daily.Cuts()
    finally:
        daily.stage = real
    assert counted == []


def test_unknown_users_keep_their_days(make_events):
    rows = [{"user_id": None, "event_id": str(i), "created_at": NOON, "profit": -1.0} for i in range(5)]
    for limit in (daily.DAY_LIMIT, 2):
        local = daily.local_events(daily.filter_events(make_events(rows)))
        (row,) = daily.user_day_base(local, daily.find_cuts(local, limit)).collect()
        assert (row.user_id, row.bet_count_today, row.max_consecutive_loss_count_today) == (None, 5, 5)
        assert daily.loss_groups(local, daily.find_cuts(local, limit)).count() == 5


def test_workflow_with_and_without_large_days_agrees(make_events):
    events = make_events(random_events(6, 800))
    plain = features_from_events(events)
    split = features_from_events(events, day_limit=15)
    assert plain.count() == split.count()
    picked = ["user_id", "bet_date", "bet_count_today", "max_consecutive_loss_count_today"]
    assert plain.select(picked).exceptAll(split.select(picked)).isEmpty()


def test_tasks_grow_with_the_events(make_events, monkeypatch):
    """However many partitions the session has, a task orders a bounded number of events."""
    rows = [r for r in random_events(8) if r["user_id"] != "hot"]
    local = daily.local_events(daily.filter_events(make_events(rows)))
    whole = daily.user_day_base(local, daily.find_cuts(local)).collect()
    monkeypatch.setattr(daily, "TASK_EVENTS", 50)
    cuts = daily.find_cuts(local)
    assert cuts.tasks == -(-local.count() // 50) > 8
    base = daily.user_day_base(local, cuts)
    assert base.rdd.getNumPartitions() == cuts.tasks
    assert sorted(map(str, base.collect())) == sorted(map(str, whole))
    assert daily.chunk_summaries(local, daily.Cuts()).rdd.getNumPartitions() == cuts.tasks
