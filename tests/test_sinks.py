import json
from datetime import date, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from daytide import schema
from daytide.plans import workflow
from daytide.session import shared_dir, stage
from daytide.sources import events, sinks
from tests.test_daily import random_events
from tests.test_features import base_frame
from daytide.operators.features import user_day_features


def test_csv_keeps_text_ids_and_missing_values(spark, tmp_path):
    table = user_day_features(base_frame(spark, [{"user_id": "007", "bet_date": date(2026, 1, 1)}]))
    sinks.write_csv(table, str(tmp_path / "csv"))
    back = events.read_csv(spark, str(tmp_path / "csv"), schema.FEATURE_SCHEMA)
    assert back.schema == schema.FEATURE_SCHEMA
    assert back.collect() == table.collect()


def test_matrix_csv_has_row_labels(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75), (1, 0, 1.0)], "a int, b int, p double")
    sinks.write_matrix_csv(cells, "a", "b", "p", [0, 1], str(tmp_path / "m"), "state_")
    (part,) = (tmp_path / "m").glob("*.csv")
    lines = part.read_text().split()
    assert lines == ["label,state_0,state_1", "state_0,0.25,0.75", "state_1,1.0,"]


def test_json_keeps_missing_fields(spark, tmp_path):
    row = spark.createDataFrame([(1, None)], "a int, b double").coalesce(1)
    sinks.write_json(row, str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("*.json")
    assert json.loads(part.read_text()) == {"a": 1, "b": None}


def test_table_by_date(spark, tmp_path):
    rows = [{"user_id": f"u{i}", "bet_date": date(2026, 1, 1 + i % 3)} for i in range(30)]
    table = user_day_features(base_frame(spark, rows)).repartition(6)
    sinks.write_table(table, str(tmp_path / "t"), by_date=True)
    folders = sorted(p.name for p in (tmp_path / "t").glob("bet_date=*"))
    assert folders == [f"bet_date=2026-01-0{d}" for d in (1, 2, 3)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 30


def test_stage_cuts_the_plan_and_keeps_the_schema(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    back = stage(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert "Range" not in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 10


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("spark://host:7077", False)])
def test_folder_is_made_up_only_for_local_sessions(master, allowed):
    context = SimpleNamespace(master=master, applicationId="app")
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context
    )
    if allowed:
        assert shared_dir(session) == shared_dir(session)
    else:
        with pytest.raises(RuntimeError):
            shared_dir(session)


def test_jdbc_options():
    options = events.jdbc_options("jdbc:x://h/d", "events", "created_at", "2026-01-01", "2026-02-01", 64)
    assert options["fetchsize"] == "50000" and options["numPartitions"] == "64"
    assert "partitionColumn" not in events.jdbc_options("jdbc:x://h/d", "events")
    with pytest.raises(ValueError):
        events.jdbc_options("jdbc:x://h/d", "events", "created_at")


def test_lookup_compares_ids_as_text(make_events):
    rows = [
        {"user_id": u, "event_id": str(i), "created_at": datetime(2026, 1, 1, 0, i % 60)}
        for i, u in enumerate(["7", "07", "7", "77", "7"])
    ]
    table = make_events(rows)
    found = events.lookup_user(table, 7)
    assert [r["event_id"] for r in found.orderBy("event_id").collect()] == ["0", "2", "4"]
    assert [r["event_id"] for r in events.lookup_user(table, "7", 2).collect()] == ["0", "2"]
    row = events.lookup_summary(found, 7).first()
    assert (row["user_id"], row["row_count"], row["columns"]) == ("7", 3, table.columns)
    assert events.output_columns(found) == table.columns


def test_whole_run_writes_every_table(spark, make_events, tmp_path):
    run = workflow.run(make_events(random_events(9, 600)), n_states=2, max_iter=3, day_limit=50)
    assert run.labelled.count() == run.features.count()
    assert run.profile.agg(F.sum("rows")).first()[0] == run.features.count()
    assert run.profile.agg(F.sum("row_share")).first()[0] == pytest.approx(1.0)
    workflow.write_run(run, str(tmp_path / "run"))
    workflow.write_eda(run.features, str(tmp_path / "eda"))
    (summary,) = spark.read.json(str(tmp_path / "run" / "model_summary")).collect()
    assert summary["rows"] == run.features.count() and summary["iterations"] <= 3
    names = {p.name for p in (tmp_path / "run").iterdir()} | {p.name for p in (tmp_path / "eda").iterdir()}
    assert names == {
        "user_day_with_state", "features", "stats", "state_profile", "state_profile_readable", "state_means_z",
        "state_covars_z", "transition_matrix", "transition_matrix_2step", "transition_matrix_readable_pct",
        "history", "model", "model_summary", "feature_summary", "daily_summary", "correlation", "metadata",
        "report_features", "report_top_correlations", "top_correlations", "charts",
    }
    assert {p.name for p in (tmp_path / "eda" / "charts").iterdir()} == {
        "missing_zero", "histogram", "histogram_log1p", "correlation_cells", "daily_trends",
        "ratio_scatter", "rtp_scatter",
    }
    assert summary["min_train_days"] == run.parameters["min_train_days"] == 3


def test_tables_are_written_in_order(spark, tmp_path):
    rows = [(f"u{i % 7}", date(2026, 1, 1) + timedelta(days=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id string, bet_date date").repartition(5)
    sinks.write_sorted(df, str(tmp_path / "sorted"))
    ranges = []
    for part in sorted((tmp_path / "sorted").glob("part-*")):
        got = [(r.user_id, r.bet_date) for r in spark.read.parquet(str(part)).collect()]
        assert got == sorted(got)
        ranges += [(got[0], got[-1])] if got else []
    assert all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))


def scanned_rows(df):
    """Rows that the scan handed on, after folders, row groups and pages were skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def many_events(make_events, users=2_000, each=20):
    begin = datetime(2026, 1, 5, 4)
    return make_events(
        [
            {"user_id": f"u{u:05d}", "event_id": f"{u}-{i}", "created_at": begin + timedelta(hours=12 * (i % 4), seconds=i)}
            for u in range(0, 2 * users, 2)
            for i in range(each)
        ]
    )


def test_lookup_skips_what_cannot_have_the_user(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    sinks.write_events(many_events(make_events), path, row_group=16_384)
    table = events.read_events(spark, path)
    found = events.lookup_user(table, "u00500")
    assert len(found.collect()) == 20
    assert scanned_rows(events.lookup_user(table, "u00500")) < 0.1 * table.count()
    # within the range of every file, yet in no Bloom filter
    absent = scanned_rows(events.lookup_user(table, "u00501"))
    assert absent < 0.05 * table.count()


def test_sorted_table_is_skipped_over(spark, tmp_path):
    rows = [{"user_id": f"u{i:04d}", "bet_date": date(2026, 1, 1 + d)} for i in range(1_500) for d in range(4)]
    sinks.write_sorted(user_day_features(base_frame(spark, rows)), str(tmp_path / "s"), row_group=16_384)
    table = spark.read.parquet(str(tmp_path / "s"))
    one = table.where("user_id = 'u0700'")
    assert one.count() == 4
    assert scanned_rows(one) < 0.2 * table.count()


def test_stored_events_come_back_by_date(spark, make_events, tmp_path):
    table = many_events(make_events, users=40).union(
        make_events([{"user_id": None}, {"user_id": "x", "created_at": None}])
    )
    sinks.write_events(table, str(tmp_path / "e"))
    back = events.read_events(spark, str(tmp_path / "e"), utc_date="utc_date")
    assert back.drop("utc_date").exceptAll(table).isEmpty() and back.count() == table.count()
    assert back.where("utc_date <> to_date(created_at)").isEmpty()
    plan = back.where("utc_date = DATE'2026-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(utc_date" in plan


def test_empty_event_table_is_stored(spark, make_events, tmp_path):
    sinks.write_events(make_events([{}]).where("false"), str(tmp_path / "none"))
    assert events.read_events(spark, str(tmp_path / "none")).isEmpty()
