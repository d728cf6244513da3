"""Physical plans keep the shape that makes them scale."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contract import queries as Q
from daytide.operators import daily, eda, hmm, normalize
from daytide.operators.features import user_day_features
from daytide.sources import adapters, events

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def full_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan.replace("BroadcastExchange", ""))


@pytest.fixture(scope="module")
def local(spark):
    return daily.local_events(daily.filter_events(adapters.from_orders(spark, SF)))


def test_features_need_two_exchanges(local):
    plan = plan_of(user_day_features(daily.user_day_base(local, daily.find_cuts(local))))
    assert exchanges(plan) == ["hashpartitioning", "hashpartitioning"]
    assert "Python" not in plan and "Join" not in plan


def test_base_plan_does_not_depend_on_the_size_of_the_table(spark):
    def shape(sf):
        rows = daily.local_events(daily.filter_events(adapters.from_events(spark, sf)))
        plan = plan_of(daily.user_day_base(rows, daily.find_cuts(rows)))
        return re.findall(r"[A-Z]\w+(?=[ (])", re.sub(r"#\d+L?|Location: .*", "", plan))

    assert shape(SF) == shape("/root/testdata/sf0.1")


def test_date_range_reaches_the_scan(spark):
    kept = daily.filter_events(adapters.from_events(spark, SF), "2024-01-05", "2024-01-07")
    plan = plan_of(daily.local_events(kept).select("user_id", "bet"))
    assert "GreaterThanOrEqual(ts,2024-01-04T16:00" in plan
    assert "LessThan(ts,2024-01-06T16:00" in plan


def test_filters_on_stored_codes_reach_the_scan(spark, tmp_path, make_events):
    path = str(tmp_path / "events")
    make_events([{"event_id": "1"}]).write.parquet(path)
    kept = daily.filter_events(events.read_events(spark, path))
    plan = plan_of(kept.select("bet"))
    assert "EqualTo(currency_type,CNY)" in plan and "EqualTo(game_id,FM01)" in plan
    assert "Not(In(op_code" in plan
    assert "payout" not in plan.split("ReadSchema")[1]


def test_point_lookup_is_pushed_down(spark, tmp_path, make_events):
    path = str(tmp_path / "events")
    make_events([{"event_id": "1"}]).write.parquet(path)
    plan = plan_of(events.lookup_user(events.read_events(spark, path), 7))
    assert "EqualTo(user_id,7)" in plan and exchanges(plan) == []


def test_summaries_read_only_what_they_need(spark):
    table = Q.staged(spark, SF, "orders")
    plan = plan_of(eda.daily_summary(table))
    assert "rtp_day" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_global_aggregates_combine_before_the_shuffle(spark):
    table = Q.staged(spark, SF, "orders")
    for df in (
        eda.correlation_long(table),
        eda.feature_counts(table),
        eda.feature_quantiles(table),
        normalize.fit_stats(table),
    ):
        plan = plan_of(df)
        assert "partial_" in plan
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["labelled_user_days", "state_profile", "rtp_scatter", "hist_clipped"])
def test_no_cross_joins(spark, name):
    plan = plan_of(Q.queries()[name](spark, SF))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_labels_sort_once_per_user(spark):
    plan = plan_of(Q.labelled(spark, SF, "orders"))
    assert len(exchanges(plan.split("Subqueries")[0])) <= 2
    assert plan.count("Sort [") == 1


def test_decode_is_a_narrow_arrow_pass(spark):
    sequences = Q.sequences(spark, SF)[1]
    plan = plan_of(hmm.decode(sequences, Q.fixed_params()))
    assert "MapInArrow" in plan and exchanges(plan) == []


def test_date_folders_outside_the_range_are_pruned(spark, tmp_path, make_events):
    path = str(tmp_path / "by-day")
    rows = [{"event_id": str(d), "created_at": datetime(2026, 1, d, 12)} for d in (3, 4, 5, 6, 7)]
    table = make_events(rows).withColumn("day", F.to_date("created_at"))
    table.write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    kept = daily.filter_events(stored, "2026-01-05", "2026-01-06", utc_date_column="day")
    assert kept.inputFiles() and [r["event_id"] for r in kept.collect()] == ["5"]
    plan = plan_of(kept)
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert ">= 2026-01-04" in filters and "<= 2026-01-05" in filters
