"""The whole run, from an event table to labelled user-days and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide import schema
from daytide.operators import chartdata, daily, eda, hmm, normalize, states
from daytide.operators.features import user_day_features
from daytide.session import stage
from daytide.sources import sinks


def base_from_events(
    events: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    offset_hours: int = schema.UTC_OFFSET_HOURS,
    day_limit: int = daily.DAY_LIMIT,
    **filters,
) -> DataFrame:
    """Event rows -> user-day base; ``filters`` as for ``daily.filter_events``.

    User-days of more than ``day_limit`` events are counted out and cut into chunks.
    """
    kept = daily.filter_events(events, start_date, end_date, offset_hours, **filters)
    local = daily.local_events(kept, offset_hours)
    return daily.user_day_base(local, daily.find_cuts(local, day_limit))


def features_from_events(events: DataFrame, *args, **kwargs) -> DataFrame:
    """Event rows -> 17-column user-day features; arguments as for the base."""
    return user_day_features(base_from_events(events, *args, **kwargs))


@dataclass
class Run:
    features: DataFrame
    stats: DataFrame
    sequences: DataFrame
    fit: hmm.HmmFit
    labelled: DataFrame
    profile: DataFrame
    parameters: dict = field(default_factory=dict)


def run(
    events: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    n_states: int = 4,
    min_train_days: int = 3,
    max_iter: int = 150,
    tol: float = 1e-3,
    seed: int = 42,
    offset_hours: int = schema.UTC_OFFSET_HOURS,
    excluded_op_codes=schema.EXCLUDED_OP_CODES,
    currency: str | None = schema.CURRENCY,
    game: str | None = schema.GAME,
    utc_date_column: str | None = None,
    low: float = 0.01,
    high: float = 0.99,
    churn_days: int = 7,
    day_limit: int = daily.DAY_LIMIT,
) -> Run:
    """All stages in order. Tables read by several passes are staged in the shared folder.

    Name ``utc_date_column`` if the event table is partitioned by UTC date: folders out of
    the range are then not read. Every user-day gets one state, or the run fails.
    """
    parameters = {k: v for k, v in locals().items() if k != "events"}
    features = features_from_events(
        events,
        start_date,
        end_date,
        offset_hours,
        day_limit,
        excluded_op_codes=excluded_op_codes,
        currency=currency,
        game=game,
        utc_date_column=utc_date_column,
    )
    features = stage(features, "features")
    stats = stage(normalize.fit_stats(features, low, high), "stats")
    sequences = hmm.staged_sequences(normalize.transform(features, stats))
    fit = hmm.fit(sequences, n_states, min_train_days, max_iter, tol, seed)
    decoded = hmm.decode(sequences, fit.params)
    labelled = stage(states.label_decoded(features, decoded, churn_days), "labelled")
    states.check_attached(features, labelled)
    return Run(features, stats, sequences, fit, labelled, states.state_profile(labelled), parameters)


def write_run(run: Run, path: str, names: dict[int, str] | None = None) -> None:
    """Write every output table of a run below ``path``; ``names`` are hand-written state labels."""
    spark = run.features.sparkSession
    k = run.fit.params.states
    tables = hmm.parameter_tables(spark, run.fit.params)
    steps = {
        "transition_matrix": tables["transitions"],
        "transition_matrix_2step": states.two_step_transitions(tables["transitions"]),
    }
    profile = stage(run.profile, "profile")
    readable = states.readable_profile(profile, names)
    labels = {r["hmm_state"]: f"S{r['hmm_state']} {r['manual_label']}" for r in readable.limit(k).collect()}
    labels = {s: labels.get(s, f"S{s}") for s in range(k)}
    sinks.write_sorted(run.labelled, f"{path}/user_day_with_state")
    sinks.write_sorted(run.features, f"{path}/features")
    sinks.write_json(run.stats, f"{path}/stats")
    sinks.write_csv(profile, f"{path}/state_profile")
    sinks.write_csv(readable, f"{path}/state_profile_readable")
    sinks.write_csv(tables["means"], f"{path}/state_means_z")
    sinks.write_csv(tables["covars"], f"{path}/state_covars_z")
    for name, cells in steps.items():
        sinks.write_matrix_csv(
            cells, "from_state", "to_state", "p", list(range(k)), f"{path}/{name}", "state_"
        )
    pct = states.readable_transitions(tables["transitions"], labels)
    sinks.write_csv(pct, f"{path}/transition_matrix_readable_pct")
    sinks.write_csv(hmm.history_table(spark, run.fit), f"{path}/history")
    hmm.save_params(spark, run.fit.params, f"{path}/model")
    min_train_days = run.parameters.get("min_train_days", 3)
    summary = hmm.run_summary(run.features, run.sequences, run.fit, min_train_days)
    sinks.write_json(summary, f"{path}/model_summary")


def write_eda(features: DataFrame, path: str, sample: int = 50_000) -> None:
    """Write the summaries, report tables and chart data of a (written) feature table."""
    shared = eda.profile(features)
    corr = stage(eda.correlation_long(features, profile=shared), "correlation")
    summary = stage(eda.feature_summary(features, profile=shared), "summary")
    daily_rows = stage(eda.daily_summary(features), "daily")
    top = eda.top_correlations(corr)
    tables = {
        "feature_summary": summary,
        "daily_summary": daily_rows.orderBy("bet_date"),
        "report_features": eda.report_feature_table(summary),
        "report_top_correlations": eda.report_top_correlations(top),
        "top_correlations": top,
        "charts/missing_zero": chartdata.missing_zero_rates(summary),
        "charts/histogram": chartdata.histogram(features),
        "charts/histogram_log1p": chartdata.histogram(features, log=True),
        "charts/correlation_cells": chartdata.correlation_cells(corr),
        "charts/daily_trends": chartdata.daily_trends(daily_rows),
        "charts/ratio_scatter": chartdata.ratio_scatter(features, sample),
        "charts/rtp_scatter": chartdata.rtp_scatter(features, sample),
    }
    for name, table in tables.items():
        sinks.write_csv(table, f"{path}/{name}")
    sinks.write_matrix_csv(
        corr, "feature_a", "feature_b", "corr", schema.MODEL_FEATURES, f"{path}/correlation"
    )
    metadata = eda.dataset_metadata(features)
    sinks.write_json(metadata.withColumn("features", F.concat_ws(",", "features")), f"{path}/metadata")
