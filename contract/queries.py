"""Registered queries: (spark, sf_dir) -> DataFrame, each over whole tables.

Doubles are rounded and integers widened, so that another engine can be compared.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract import oracle as O
from daytide import schema
from daytide.functions.columns import fixed4, numeric, percent2, plain4, rounded
from daytide.functions.sampling import seeded_sample
from daytide.functions.sequence_kernels import HmmParams
from daytide.functions.shape import small_table
from daytide.operators import chartdata, daily, eda, hmm, normalize, start, states
from daytide.operators.features import user_day_features, user_day_history
from daytide.plans import workflow
from daytide.session import shared_dir, stage
from daytide.sources import adapters, events, sinks

SOURCES = {
    "events": adapters.from_events,
    "orders": adapters.from_orders,
    "lineitem": adapters.from_lineitem,
}
MODEL = schema.MODEL_FEATURES
SAMPLE = 50_000
BOUNDS = ("2024-01-05", "2024-01-20")

_queries: dict = {}
_oracles: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + F.lit(O.NUDGE), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def keep(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        query.__doc__ = fn.__doc__
        _queries[name] = query
        if sql is not None:
            _oracles[name] = sql
        return fn

    return keep


def local(spark, sf_dir, source="events", **kw):
    return daily.local_events(daily.filter_events(SOURCES[source](spark, sf_dir), **kw))


def base(spark, sf_dir, source="events"):
    return workflow.base_from_events(SOURCES[source](spark, sf_dir))


def features(spark, sf_dir, source="events"):
    return user_day_features(base(spark, sf_dir, source))


def staged(spark, sf_dir, source="events"):
    return stage(features(spark, sf_dir, source), "features")


# --- events ------------------------------------------------------------------------


@register("event_filter", O.select(O.base_ctes(), f"SELECT {O.EVENT_COLS} FROM ev"))
def _(spark, sf_dir):
    return local(spark, sf_dir)


@register(
    "utc_bounds",
    O.select(
        O.base_ctes("events", BOUNDS),
        f"SELECT bet_date, {O.big('count(*)', 'n')}, min(created_at) AS first_utc, max(created_at) AS last_utc "
        "FROM (SELECT *, CAST(created_at + INTERVAL 8 HOURS AS DATE) AS bet_date FROM kept) GROUP BY 1",
    ),
)
def _(spark, sf_dir):
    kept = daily.filter_events(adapters.from_events(spark, sf_dir), *BOUNDS)
    day = F.to_date(F.col("created_at") + F.expr("INTERVAL 8 HOURS"))
    return kept.groupBy(day.alias("bet_date")).agg(
        F.count("*").alias("n"),
        F.min("created_at").alias("first_utc"),
        F.max("created_at").alias("last_utc"),
    )


LOOKUP_COLS = (
    "user_id, event_id, bullet_id, created_at, "
    + ", ".join(O.r(c) for c in ("bet", "payout", "profit", "curr_balance"))
    + ", op_code, currency_type, game_id"
)


@register(
    "user_lookup",
    O.select(O.base_ctes(), f"SELECT {LOOKUP_COLS} FROM src WHERE user_id = '7'"),
)
def _(spark, sf_dir):
    return events.lookup_user(adapters.from_events(spark, sf_dir), 7)


@register(
    "user_lookup_limit",
    O.select(
        O.base_ctes(),
        f"SELECT {LOOKUP_COLS} FROM (SELECT * FROM src WHERE user_id = '7' "
        "ORDER BY created_at, coalesce(event_id, bullet_id) LIMIT 20)",
    ),
)
def _(spark, sf_dir):
    return events.lookup_user(adapters.from_events(spark, sf_dir), "7", 20)


@register(
    "user_lookup_summary",
    O.select(
        O.base_ctes(),
        "SELECT '7' AS user_id, CAST(count(*) AS BIGINT) AS row_count, "
        "'user_id,event_id,bullet_id,created_at,bet,payout,profit,curr_balance,op_code,currency_type,game_id' "
        "AS columns FROM src WHERE user_id = '7'",
    ),
)
def _(spark, sf_dir):
    rows = events.lookup_user(adapters.from_events(spark, sf_dir), "7")
    return events.lookup_summary(rows, "7").withColumn("columns", F.concat_ws(",", "columns"))


# --- user-days ---------------------------------------------------------------------


@register(
    "loss_groups",
    O.select(
        O.base_ctes(),
        f"SELECT user_id, bet_date, event_sort_id, {O.big('is_loss')}, {O.big('loss_group')} FROM grouped",
    ),
)
def _(spark, sf_dir):
    return daily.loss_groups(local(spark, sf_dir)).select(
        "user_id", "bet_date", "event_sort_id", "is_loss", "loss_group"
    )


@register(
    "loss_runs",
    O.select(
        O.base_ctes("lineitem"),
        f"SELECT user_id, bet_date, {O.big('loss_group')}, {O.big('run_length')} FROM runs",
    ),
)
def _(spark, sf_dir):
    return daily.loss_runs(daily.loss_groups(local(spark, sf_dir, "lineitem")))


def _base_query(name, source, columns=None):
    picked = columns or schema.BASE_SCHEMA.names
    exprs = ", ".join(
        c
        if c in ("user_id", "bet_date")
        else (O.big(c) if c in O.COUNTS else O.r(c))
        for c in picked
    )

    @register(name, O.select(O.base_ctes(source), f"SELECT {exprs} FROM base"))
    def _(spark, sf_dir):
        table = base(spark, sf_dir, source)
        return schema.require_columns(table, schema.BASE_SCHEMA).select(*picked)


KEYS = ["user_id", "bet_date"]
_base_query("daily_base", "events")
_base_query("daily_base_orders", "orders")
_base_query("daily_base_lineitem", "lineitem")


@register("daily_base_crowded", O.select(O.base_ctes("lineitem"), f"SELECT {O.BASE_COLS} FROM base"))
def _(spark, sf_dir):
    """A limit of two events cuts user-days into half-days, and these by range."""
    rows = local(spark, sf_dir, "lineitem")
    return daily.user_day_base(rows, daily.find_cuts(rows, 2, 43_200))


@register(
    "loss_groups_crowded",
    O.select(
        O.base_ctes("lineitem"),
        f"SELECT user_id, bet_date, event_sort_id, {O.big('is_loss')}, {O.big('loss_group')} FROM grouped",
    ),
)
def _(spark, sf_dir):
    rows = local(spark, sf_dir, "lineitem")
    return daily.loss_groups(rows, daily.find_cuts(rows, 2, 43_200)).select(
        "user_id", "bet_date", "event_sort_id", "is_loss", "loss_group"
    )


_base_query(
    "daily_counts",
    "events",
    KEYS + ["bet_count_today", "bet_amount_today", "avg_bet_one_time_today", "payout_today"],
)
_base_query("daily_rtp", "events", KEYS + ["rtp_day"])
_base_query("bet_interval", "events", KEYS + ["bet_interval_day"])
_base_query("balance_max", "events", KEYS + ["current_balance_day_max"])
_base_query("max_loss_run", "lineitem", KEYS + ["max_consecutive_loss_count_today"])


def _feature_query(name, source, columns=None):
    picked = columns or schema.FEATURE_COLUMNS
    exprs = ", ".join(
        c
        if c in ("user_id", "bet_date")
        else (O.big(c) if c in O.COUNTS else O.r(c))
        for c in picked
    )

    @register(name, O.select(O.feature_ctes(source), f"SELECT {exprs} FROM feat"))
    def _(spark, sf_dir):
        return features(spark, sf_dir, source).select(*picked)


@register(
    "no_bet_streak",
    O.select(
        O.feature_ctes("orders"),
        f"SELECT user_id, bet_date, prev_bet_date, {O.big('no_bet_streak_days')} FROM hist",
    ),
)
def _(spark, sf_dir):
    return user_day_history(base(spark, sf_dir, "orders")).select(*KEYS, "prev_bet_date", "no_bet_streak_days")


@register(
    "history_means",
    O.select(
        O.feature_ctes(),
        f"SELECT user_id, bet_date, {O.r('hist_amount')}, {O.r('hist_count')}, {O.r('hist_single')} FROM hist",
    ),
)
def _(spark, sf_dir):
    return user_day_history(base(spark, sf_dir)).select(
        *KEYS, "hist_amount", "hist_count", "hist_single"
    )


_feature_query("bet_days_7d", "events", KEYS + ["bet_days_7d"])
_feature_query(
    "hist_ratios",
    "events",
    KEYS
    + [
        "bet_amount_ratio_today_vs_history",
        "bet_count_ratio_today_vs_history",
        "current_balance_max_to_avg_bet_ratio",
    ],
)
_feature_query("log_single_bet", "events", KEYS + ["avg_bet_one_time_today_log"])
_feature_query("rtp_7_rows", "events", KEYS + ["rtp_7_bet_days"])
_feature_query("user_day_features", "events")
_feature_query("user_day_features_orders", "orders")
_feature_query("user_day_features_lineitem", "lineitem")

# --- normalisation -----------------------------------------------------------------


@register("constant_fill", O.select(O.norm_ctes(), f"SELECT {O.MODEL_COLS} FROM filled"))
def _(spark, sf_dir):
    return normalize.fill_constants(features(spark, sf_dir))


@register(
    "median_fill",
    O.select(O.norm_ctes(), f"SELECT feature, {O.r('fill_value')} FROM meds"),
)
def _(spark, sf_dir):
    return normalize.fit_fill_values(normalize.fill_constants(staged(spark, sf_dir)))


def _stats_query(name, source):
    @register(
        name,
        O.select(
            O.norm_ctes(source),
            "SELECT feature, "
            + ", ".join(O.r(c) for c in ("fill_value", "p01", "p99", "mean", "std"))
            + " FROM stats",
        ),
    )
    def _(spark, sf_dir):
        return normalize.fit_stats(staged(spark, sf_dir, source))


_stats_query("normalize_stats", "events")
_stats_query("normalize_stats_orders", "orders")


@register(
    "winsorized",
    O.select(
        O.norm_ctes(), f"SELECT user_id, bet_date, feature, {O.r('x')} FROM winsor_long"
    ),
)
def _(spark, sf_dir):
    table = staged(spark, sf_dir)
    filled = normalize.fill_constants(table)
    fill = {k: v["fill_value"] for k, v in small_table(normalize.fit_fill_values(filled), "feature").items()}
    imputed = normalize.impute(filled, fill)
    bounds = small_table(normalize.fit_bounds(imputed), "feature")
    return normalize.winsorize(imputed, bounds).unpivot(KEYS, MODEL, "feature", "x")


def z_table(spark, sf_dir, source="events"):
    table = staged(spark, sf_dir, source)
    return table, normalize.transform(table, normalize.fit_stats(table))


@register(
    "z_features",
    O.select(
        O.norm_ctes(), f"SELECT user_id, bet_date, {', '.join(O.r(c + '_z') for c in MODEL)} FROM z"
    ),
)
def _(spark, sf_dir):
    return z_table(spark, sf_dir)[1]


# --- summaries ---------------------------------------------------------------------


def _summary_query(name, source):
    cols = ["mean", "std", "min", *O.SUMMARY_QUANTILES, "max", "skew"]

    @register(
        name,
        O.select(
            O.eda_ctes(source),
            f"SELECT feature, {O.big('rows')}, {O.big('missing_count')}, {O.r('missing_rate')}, "
            f"{O.big('zero_count')}, {O.r('zero_rate')}, {', '.join(O.r(c) for c in cols)} FROM summary",
        ),
    )
    def _(spark, sf_dir):
        return eda.feature_summary(staged(spark, sf_dir, source))


_summary_query("feature_summary", "events")
_summary_query("feature_summary_orders", "orders")


@register(
    "feature_quantiles",
    O.select(
        O.eda_ctes("lineitem"),
        f"SELECT feature, {', '.join(O.r(c) for c in O.SUMMARY_QUANTILES)} FROM summary",
    ),
)
def _(spark, sf_dir):
    return eda.feature_quantiles(staged(spark, sf_dir, "lineitem"))


@register(
    "feature_skew",
    O.select(O.eda_ctes(), f"SELECT feature, {O.r('std')}, {O.r('skew')} FROM summary"),
)
def _(spark, sf_dir):
    return eda.feature_counts(features(spark, sf_dir)).select("feature", "std", "skew")


def _daily_query(name, source):
    doubles = ["bet_amount", "payout", "profit", "avg_bet_days_7d", "avg_no_bet_streak_days", "rtp"]

    @register(
        name,
        O.select(
            O.eda_ctes(source),
            f"SELECT bet_date, {O.big('user_days')}, {O.big('users')}, "
            f"{', '.join(O.r(c) for c in doubles)} FROM daily_sum",
        ),
    )
    def _(spark, sf_dir):
        return eda.daily_summary(features(spark, sf_dir, source))


_daily_query("daily_summary", "events")
_daily_query("daily_summary_lineitem", "lineitem")


@register(
    "correlation_long",
    O.select(O.eda_ctes(), f"SELECT feature_a, feature_b, {O.r('corr')} FROM corrs"),
)
def _(spark, sf_dir):
    return eda.correlation_long(features(spark, sf_dir)).select("feature_a", "feature_b", "corr")


@register(
    "correlation_wide",
    O.select(
        O.eda_ctes("orders"),
        "SELECT feature_a, "
        + ", ".join(O.r(f"max(CASE WHEN feature_b = '{c}' THEN corr END)", c) for c in MODEL)
        + " FROM corrs GROUP BY 1",
    ),
)
def _(spark, sf_dir):
    return eda.correlation_wide(eda.correlation_long(features(spark, sf_dir, "orders")))


@register(
    "correlation_cells",
    O.select(O.eda_ctes(), f"SELECT feature_a, feature_b, {O.rounded('corr', 2, 'corr')} FROM corrs"),
)
def _(spark, sf_dir):
    return chartdata.correlation_cells(eda.correlation_long(features(spark, sf_dir)))


@register(
    "top_correlations",
    O.select(O.eda_ctes(), f"SELECT feature_a, feature_b, {O.r('corr')} FROM top_corr"),
)
def _(spark, sf_dir):
    return eda.top_correlations(eda.correlation_long(features(spark, sf_dir)))


@register(
    "dataset_metadata",
    O.select(
        O.feature_ctes(),
        f"SELECT {O.big('count(*)', 'rows')}, {O.big('count(DISTINCT user_id)', 'users')}, "
        f"min(bet_date) AS date_min, max(bet_date) AS date_max, '{','.join(MODEL)}' AS features FROM feat",
    ),
)
def _(spark, sf_dir):
    meta = eda.dataset_metadata(features(spark, sf_dir))
    return meta.withColumn("features", F.concat_ws(",", "features"))


@register(
    "report_feature_table",
    O.select(
        O.eda_ctes(),
        f"SELECT feature, {O.percent('missing_rate', 'missing')}, {O.percent('zero_rate', 'zero')}, "
        f"{O.fixed4('mean', 'mean')}, {O.fixed4('median', 'p50')}, {O.fixed4('p95', 'p95')}, "
        f"{O.fixed4('p99', 'p99')}, {O.fixed4('max', 'max')}, {O.fixed4('skew', 'skew')} FROM summary",
    ),
)
def _(spark, sf_dir):
    return eda.report_feature_table(eda.feature_summary(staged(spark, sf_dir)))


@register(
    "report_top_corr",
    O.select(
        O.eda_ctes(), "SELECT feature_a, feature_b, printf('%.4f', corr) AS corr FROM top_corr"
    ),
)
def _(spark, sf_dir):
    top = eda.top_correlations(eda.correlation_long(features(spark, sf_dir)))
    return eda.report_top_correlations(top)


# --- chart data --------------------------------------------------------------------


@register(
    "missing_zero_long",
    O.select(
        O.eda_ctes(),
        f"""SELECT feature, metric, {O.r('rate')},
            {O.r('least(1.0, greatest(0.05, (SELECT max(greatest(missing_rate, zero_rate)) FROM summary) * 1.15))', 'axis_max')}
            FROM (SELECT feature, 'Missing' AS metric, missing_rate AS rate FROM summary
                  UNION ALL SELECT feature, 'Zero', zero_rate FROM summary)""",
    ),
)
def _(spark, sf_dir):
    return chartdata.missing_zero_rates(eda.feature_counts(staged(spark, sf_dir)))


@register("hist_clipped", O.histogram_sql("events", False))
def _(spark, sf_dir):
    return chartdata.histogram(staged(spark, sf_dir))


@register("hist_log1p", O.histogram_sql("events", True))
def _(spark, sf_dir):
    return chartdata.histogram(staged(spark, sf_dir), log=True)


@register(
    "daily_trends",
    O.select(
        O.eda_ctes(),
        " UNION ALL ".join(
            f"SELECT bet_date, '{c}' AS series, {O.r(c, 'value')} FROM daily_sum"
            for c in ("user_days", "bet_amount", "rtp", "avg_no_bet_streak_days")
        ),
    ),
)
def _(spark, sf_dir):
    return chartdata.daily_trends(eda.daily_summary(features(spark, sf_dir)))


# The samples of ``lineitem`` are smaller than its table; those of the other sources may take all rows.
def _sample_queries(source: str, suffix: str, scatter_source: str):
    @register(
        f"seeded_sample{suffix}",
        O.select(
            f"{O.feature_ctes(source)}, {O.sample_cte(SAMPLE, 42)}",
            f"SELECT user_id, bet_date, {O.r('rtp_day')} FROM sampled",
        ),
    )
    def _(spark, sf_dir):
        table = staged(spark, sf_dir, source)
        return seeded_sample(table, KEYS, SAMPLE, 42).select(*KEYS, "rtp_day")

    @register(
        f"ratio_scatter{suffix}",
        O.select(
            f"{O.feature_ctes(scatter_source)}, {O.sample_cte(SAMPLE, 42)}",
            f"""SELECT user_id, bet_date, {O.r('bet_amount_ratio_today_vs_history', 'amount_ratio')},
            {O.r('bet_count_ratio_today_vs_history', 'count_ratio')},
            {O.r('ln(1 + greatest(bet_amount_ratio_today_vs_history, 0))', 'amount_ratio_log')},
            {O.r('ln(1 + greatest(bet_count_ratio_today_vs_history, 0))', 'count_ratio_log')}
            FROM sampled WHERE bet_amount_ratio_today_vs_history IS NOT NULL
              AND bet_count_ratio_today_vs_history IS NOT NULL""",
        ),
    )
    def _(spark, sf_dir):
        return chartdata.ratio_scatter(staged(spark, sf_dir, scatter_source), SAMPLE)

    @register(
        f"rtp_scatter{suffix}",
        O.select(
            f"""{O.feature_ctes(scatter_source)}, {O.sample_cte(SAMPLE, 43)},
    pts AS (SELECT user_id, bet_date, rtp_day, rtp_7_bet_days FROM sampled
            WHERE rtp_day IS NOT NULL AND rtp_7_bet_days IS NOT NULL)""",
            f"""SELECT user_id, bet_date, {O.r('rtp_day')}, {O.r('rtp_7_bet_days')} FROM pts
            WHERE rtp_day <= (SELECT quantile_cont(rtp_day, 0.99) FROM pts)
              AND rtp_7_bet_days <= (SELECT quantile_cont(rtp_7_bet_days, 0.99) FROM pts)""",
        ),
    )
    def _(spark, sf_dir):
        return chartdata.rtp_scatter(staged(spark, sf_dir, scatter_source), SAMPLE)


_sample_queries("orders", "", "events")
_sample_queries("lineitem", "_lineitem", "lineitem")


# --- states given by a rule --------------------------------------------------------


def rule_states(table: DataFrame, source: str) -> DataFrame:
    return table.withColumn("hmm_state", F.expr(O.RULE_STATE[source]))


def labelled(spark, sf_dir, source):
    return states.label_user_days(rule_states(staged(spark, sf_dir, source), source))


LABEL_COLS = [
    "user_id",
    "bet_date",
    "hmm_state",
    "hmm_state_duration_days",
    "next_bet_date",
    "next_gap_days",
    "churn7_proxy",
]


def _label_query(name, source, columns):
    exprs = {
        "user_id": "user_id",
        "bet_date": "bet_date",
        "next_bet_date": "next_bet_date",
        "churn7_proxy": O.r("churn7_proxy"),
    }

    @register(
        name,
        O.select(
            O.state_ctes(source),
            f"SELECT {', '.join(exprs.get(c, O.big(c)) for c in columns)} FROM labelled",
        ),
    )
    def _(spark, sf_dir):
        return labelled(spark, sf_dir, source).select(*columns)


_label_query("state_duration", "events", KEYS + ["hmm_state", "hmm_state_duration_days"])
_label_query("next_gap", "orders", KEYS + ["next_bet_date", "next_gap_days"])
_label_query("churn7", "orders", KEYS + ["churn7_proxy"])
_label_query("labelled_user_days", "events", LABEL_COLS)


def _profile_query(name, source):
    @register(name, O.select(O.state_ctes(source), f"SELECT {O.PROFILE_COLS} FROM prof"))
    def _(spark, sf_dir):
        return states.state_profile(stage(labelled(spark, sf_dir, source), "labelled"))


_profile_query("state_profile", "events")
_profile_query("state_profile_orders", "orders")


@register(
    "state_labels",
    O.select(O.state_ctes("orders"), f"SELECT {O.big('hmm_state')}, label FROM prof"),
)
def _(spark, sf_dir):
    table = stage(labelled(spark, sf_dir, "orders"), "labelled")
    return states.state_profile(table).select("hmm_state", "label")


READABLE = [
    "users",
    "bet_days_7d_mean",
    "no_bet_streak_days_mean",
    "bet_interval_day_mean",
    "bet_amount_ratio_today_vs_history_median",
    "bet_count_ratio_today_vs_history_median",
    "rtp_7_bet_days_mean",
    "rtp_day_mean",
    "max_consecutive_loss_count_today_median",
    "current_balance_max_to_avg_bet_ratio_median",
    "state_duration_median",
]


@register(
    "state_readable",
    O.select(
        O.state_ctes(),
        f"SELECT {O.big('hmm_state')}, label AS manual_label, {O.big('rows')}, "
        f"{O.rounded('row_share * 100', 2, 'row_share_pct')}, {O.rounded('churn7_rate * 100', 2, 'churn7_rate_pct')}, "
        + ", ".join(O.big(c) if c == "users" else O.r(c) for c in READABLE)
        + " FROM prof",
    ),
)
def _(spark, sf_dir):
    table = stage(labelled(spark, sf_dir, "events"), "labelled")
    return states.readable_profile(states.state_profile(table))


@register(
    "state_bars",
    O.select(
        O.state_ctes(),
        f"""SELECT 'S' || hmm_state || ' ' || CASE hmm_state WHEN 0 THEN 'Stable Active'
                WHEN 1 THEN 'High-Churn Decline' WHEN 2 THEN 'Low-Bet Active'
                WHEN 3 THEN 'Reactivation' ELSE 'State' END AS state_label,
            {O.rounded('row_share * 100', 2, 'row_share_pct')},
            {O.rounded('churn7_rate * 100', 2, 'churn7_rate_pct')} FROM prof""",
    ),
)
def _(spark, sf_dir):
    table = stage(labelled(spark, sf_dir, "events"), "labelled")
    return chartdata.state_bars(states.readable_profile(states.state_profile(table)))


def observed_transitions(spark, sf_dir):
    """Transition shares seen between rule states, as input of the matrix operators."""
    by_day = Window.partitionBy("user_id").orderBy("bet_date")
    moves = (
        rule_states(features(spark, sf_dir), "events")
        .select(
            F.col("hmm_state").alias("from_state"),
            F.lead("hmm_state").over(by_day).alias("to_state"),
        )
        .where("to_state IS NOT NULL")
        .groupBy("from_state", "to_state")
        .agg(F.count("*").alias("n"))
    )
    # At most states x states rows from here on.
    share = F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))
    return stage(moves.select("from_state", "to_state", share.alias("p")), "transitions")


@register(
    "transitions_2step",
    O.select(
        O.state_ctes(),
        f"SELECT {O.big('a.from_state', 'from_state')}, {O.big('b.to_state', 'to_state')}, "
        f"{O.r('sum(a.p * b.p)', 'p')} FROM trans a JOIN trans b ON a.to_state = b.from_state "
        "GROUP BY a.from_state, b.to_state",
    ),
)
def _(spark, sf_dir):
    return states.two_step_transitions(observed_transitions(spark, sf_dir))


STATE_LABELS = {s: f"S{s} {n}" for s, n in chartdata.STATE_NAMES.items()}


@register(
    "transitions_readable",
    O.select(
        O.state_ctes(),
        f"SELECT 'S' || from_state || ' ' || CASE from_state "
        + " ".join(f"WHEN {s} THEN '{n}'" for s, n in chartdata.STATE_NAMES.items())
        + " END AS state, "
        + ", ".join(
            f"max(CASE WHEN to_state = {s} THEN CAST(printf('%.1f', p * 100) AS DOUBLE) END) AS \"{n}\""
            for s, n in STATE_LABELS.items()
        )
        + " FROM trans GROUP BY from_state",
    ),
)
def _(spark, sf_dir):
    return states.readable_transitions(observed_transitions(spark, sf_dir), STATE_LABELS)


# --- hidden Markov model -----------------------------------------------------------


def fixed_params() -> HmmParams:
    """Three clearly separated states, for decoding without a fit."""
    level = np.array([0.8, 0.0, -0.8])
    means = level[:, None] * np.linspace(1.0, 0.4, len(MODEL))[None, :]
    stay = 0.7
    trans = np.full((3, 3), (1 - stay) / 2) + np.eye(3) * (stay - (1 - stay) / 2)
    return HmmParams(np.array([0.5, 0.3, 0.2]), trans, means, np.full((3, len(MODEL)), 0.9))


def _plain(p: HmmParams):
    return p.start.tolist(), p.trans.tolist(), p.means.tolist(), p.covars.tolist()


def sequences(spark, sf_dir, source="events"):
    table, z = z_table(spark, sf_dir, source)
    return table, hmm.staged_sequences(z)


def _decode_query(name, source):
    @register(name, O.decode_sql(_plain(fixed_params()), source))
    def _(spark, sf_dir):
        return hmm.decode(sequences(spark, sf_dir, source)[1], fixed_params())


_decode_query("hmm_decode", "events")
_decode_query("hmm_decode_orders", "orders")


@register(
    "sequence_lengths",
    O.select(O.feature_ctes("orders"), f"SELECT user_id, {O.big('count(*)', 'days')} FROM feat GROUP BY 1"),
)
def _(spark, sf_dir):
    return hmm.sequence_lengths(features(spark, sf_dir, "orders"))


@register(
    "train_user_days",
    O.select(
        O.feature_ctes("orders"),
        "SELECT user_id, bet_date FROM feat SEMI JOIN "
        "(SELECT user_id FROM feat GROUP BY 1 HAVING count(*) >= 8) USING (user_id)",
    ),
)
def _(spark, sf_dir):
    return hmm.train_user_days(staged(spark, sf_dir, "orders"), 8).select(*KEYS)


def decoded_days(spark, sf_dir):
    """Path of fixed parameters, attached to the raw features and labelled."""
    table, seqs = sequences(spark, sf_dir)
    out = stage(states.label_decoded(table, hmm.decode(seqs, fixed_params())), "labelled")
    states.check_attached(table, out)
    return out


DECODED = O.path_ctes(_plain(fixed_params()), "events")


@register("decoded_user_days", O.select(O.state_ctes("events", DECODED), f"SELECT {O.LABELLED_COLS} FROM labelled"))
def _(spark, sf_dir):
    return decoded_days(spark, sf_dir).select(*LABEL_COLS)


@register("decoded_profile", O.select(O.state_ctes("events", DECODED), f"SELECT {O.PROFILE_COLS} FROM prof"))
def _(spark, sf_dir):
    return states.state_profile(decoded_days(spark, sf_dir))


@register("hmm_start_seeds", O.seeds_sql("events", 3, 4, 10, 42))
def _(spark, sf_dir):
    """The rows that the ten tries of the fit's k-means start from."""
    train = sequences(spark, sf_dir)[1].where(F.col("days") >= 3)
    drawn = start.seed_rows(train, 4, len(MODEL), 42, 10)
    rows = [
        (t, r, user, day, float(v.sum()))
        for t, own in enumerate(drawn)
        for r, (_, user, day, v) in enumerate(own)
    ]
    return spark.createDataFrame(rows, "try int, round int, user_id string, bet_date date, total double")


def fitted(spark, sf_dir):
    table, seqs = sequences(spark, sf_dir)
    return table, seqs, hmm.fit(seqs)


@register(
    "hmm_fit_facts",
    O.select(
        O.feature_ctes(),
        f"""SELECT {O.big('count(*)', 'rows')}, {O.big('count(DISTINCT (user_id, bet_date))', 'keys')},
            {O.big('count(*)', 'labelled')}, CAST(4 AS BIGINT) AS proper_transition_rows,
            true AS converged, true AS objective_never_falls FROM feat""",
    ),
)
def _(spark, sf_dir):
    """What holds for any full fit: every user-day labelled once, proper rows, a rising objective."""
    table, seqs, result = fitted(spark, sf_dir)
    out = states.label_decoded(table, hmm.decode(seqs, result.params))
    proper = int(np.isclose(result.params.trans.sum(axis=1), 1).sum())
    gains = np.diff(result.objectives)
    return out.agg(
        F.count("*").alias("rows"),
        F.count_distinct("user_id", "bet_date").alias("keys"),
        F.count("hmm_state").alias("labelled"),
        F.lit(proper).alias("proper_transition_rows"),
        F.lit(result.converged).alias("converged"),
        F.lit(bool((gains >= -1e-6 * np.abs(result.objectives[:-1])).all())).alias("objective_never_falls"),
    )


@register("hmm_states")
def _(spark, sf_dir):
    """Fit, decode, attach to the raw features and label: the flagship run."""
    table, seqs, result = fitted(spark, sf_dir)
    return states.label_decoded(table, hmm.decode(seqs, result.params))


@register("hmm_state_profile")
def _(spark, sf_dir):
    table, seqs, result = fitted(spark, sf_dir)
    labelled_days = states.label_decoded(table, hmm.decode(seqs, result.params))
    return states.state_profile(stage(labelled_days, "labelled"))


def parameter_rows(spark, params: HmmParams) -> DataFrame:
    """(kind, state, item, value) of every parameter."""
    tables = hmm.parameter_tables(spark, params)
    parts = [
        tables["start"].selectExpr("'start' AS kind", "hmm_state AS state", "'p' AS item", "p AS value"),
        tables["transitions"].selectExpr("'transition'", "from_state", "string(to_state)", "p"),
    ]
    for kind in ("means", "covars"):
        parts.append(
            tables[kind]
            .unpivot("hmm_state", schema.Z_FEATURES, "item", "value")
            .selectExpr(f"'{kind}'", "hmm_state", "item", "value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@register("hmm_parameters")
def _(spark, sf_dir):
    *_, result = fitted(spark, sf_dir)
    return parameter_rows(spark, result.params)


def _em_query(name, source, min_days):
    @register(name, O.em_step_sql(_plain(fixed_params()), source, min_days))
    def _(spark, sf_dir):
        """One EM step from fixed parameters: log-likelihood before, parameters after."""
        train = sequences(spark, sf_dir, source)[1].where(F.col("days") >= min_days)
        counts = hmm.expectation(train, fixed_params())
        loglik, params = hmm.maximization(counts, fixed_params())
        before = spark.createDataFrame(
            [("loglik", 0, "", loglik)], "kind string, state int, item string, value double"
        )
        return before.union(parameter_rows(spark, params))


_em_query("hmm_em_step", "events", 3)
_em_query("hmm_em_step_orders", "orders", 8)


@register("hmm_history")
def _(spark, sf_dir):
    *_, result = fitted(spark, sf_dir)
    return hmm.history_table(spark, result)


@register(
    "run_counts",
    O.select(
        f"{O.feature_ctes('orders')}, lens AS (SELECT user_id, count(*) AS days FROM feat GROUP BY 1)",
        f"""SELECT {O.big('sum(days)', 'rows')}, {O.big('count(*)', 'users')},
            {O.big('coalesce(sum(days) FILTER (days >= 8), 0)', 'train_rows')},
            {O.big('count(*) FILTER (days >= 8)', 'train_users')},
            CAST(3 AS BIGINT) AS states, CAST(8 AS BIGINT) AS min_train_days,
            (SELECT min(bet_date) FROM feat) AS date_min, (SELECT max(bet_date) FROM feat) AS date_max
            FROM lens""",
    ),
)
def _(spark, sf_dir):
    table, seqs = sequences(spark, sf_dir, "orders")
    result = hmm.HmmFit(fixed_params(), converged=False)
    return hmm.run_summary(table, seqs, result, 8).drop(
        "converged", "iterations", "log_likelihood"
    )


@register("run_summary")
def _(spark, sf_dir):
    table, seqs, result = fitted(spark, sf_dir)
    return hmm.run_summary(table, seqs, result)


# --- sources and sinks -------------------------------------------------------------


def out_path(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register(
    "csv_round_trip", O.select(O.feature_ctes("orders"), f"SELECT {O.FEATURE_COLS} FROM feat")
)
def _(spark, sf_dir):
    path = out_path(spark, "csv")
    sinks.write_csv(features(spark, sf_dir, "orders"), path)
    return events.read_csv(spark, path, schema.FEATURE_SCHEMA)


@register(
    "partitioned_table", O.select(O.feature_ctes(), f"SELECT {O.FEATURE_COLS} FROM feat")
)
def _(spark, sf_dir):
    path = out_path(spark, "by-date")
    sinks.write_table(features(spark, sf_dir), path, by_date=True)
    return spark.read.schema(schema.FEATURE_SCHEMA).parquet(path).select(*schema.FEATURE_COLUMNS)


@register(
    "stored_lookup",
    O.select(O.base_ctes(), f"SELECT {LOOKUP_COLS} FROM src WHERE user_id = '7'"),
)
def _(spark, sf_dir):
    """One user's events out of the stored event table."""
    path = out_path(spark, "stored-events")
    sinks.write_events(adapters.from_events(spark, sf_dir), path)
    return events.lookup_user(events.read_events(spark, path), 7)


@register(
    "stored_features",
    O.select(O.feature_ctes(), f"SELECT {O.FEATURE_COLS} FROM feat"),
)
def _(spark, sf_dir):
    """Features of a stored event table, its folders pruned by UTC date."""
    path = out_path(spark, "stored-events")
    sinks.write_events(adapters.from_events(spark, sf_dir), path)
    stored = events.read_events(spark, path, utc_date="utc_date")
    return workflow.features_from_events(stored, utc_date_column="utc_date").select(*schema.FEATURE_COLUMNS)


@register("sorted_table", O.select(O.feature_ctes("orders"), f"SELECT {O.FEATURE_COLS} FROM feat"))
def _(spark, sf_dir):
    path = out_path(spark, "sorted")
    sinks.write_sorted(features(spark, sf_dir, "orders"), path)
    return spark.read.schema(schema.FEATURE_SCHEMA).parquet(path).select(*schema.FEATURE_COLUMNS)


@register("labelled_table", _oracles["labelled_user_days"])
def _(spark, sf_dir):
    path = out_path(spark, "labelled")
    table = labelled(spark, sf_dir, "events").select(*LABEL_COLS)
    sinks.write_sorted(table, path)
    return spark.read.schema(table.schema).parquet(path)


@register(
    "stats_json",
    O.select(
        O.norm_ctes(),
        "SELECT feature, "
        + ", ".join(O.r(c) for c in ("fill_value", "p01", "p99", "mean", "std"))
        + " FROM stats",
    ),
)
def _(spark, sf_dir):
    path = out_path(spark, "json")
    stats = normalize.fit_stats(staged(spark, sf_dir))
    sinks.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


@register(
    "matrix_csv",
    O.select(
        O.state_ctes(),
        "SELECT 'state_' || from_state AS label, "
        + ", ".join(
            O.r(f"max(CASE WHEN to_state = {s} THEN p END)", f"state_{s}") for s in range(4)
        )
        + " FROM trans GROUP BY from_state",
    ),
)
def _(spark, sf_dir):
    path = out_path(spark, "matrix")
    cells = observed_transitions(spark, sf_dir)
    sinks.write_matrix_csv(cells, "from_state", "to_state", "p", [0, 1, 2, 3], path, "state_")
    wide = T.StructType(
        [T.StructField("label", T.StringType())]
        + [T.StructField(f"state_{s}", T.DoubleType()) for s in range(4)]
    )
    return events.read_csv(spark, path, wide)


@register("model_reload", O.decode_sql(_plain(fixed_params()), "events"))
def _(spark, sf_dir):
    """Parameters written and read back decode the same path."""
    path = out_path(spark, "model")
    hmm.save_params(spark, fixed_params(), path)
    return hmm.decode(sequences(spark, sf_dir)[1], hmm.load_params(spark, path))


@register(
    "text_of_ties",
    "SELECT CAST(o_orderkey AS BIGINT) AS k, format('{:,.4f}', v * 1000) AS fixed, printf('%.4f', v) AS plain, "
    "printf('%.2f%%', v * 100) AS share, CAST(printf('%.2f', v) AS DOUBLE) + 0.0 AS two "
    "FROM (SELECT o_orderkey, (o_orderkey % 3200) / 3200.0 AS v FROM (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders))",
)
def _(spark, sf_dir):
    """Display text of numbers that often lie on or next to a half of the last digit."""
    v = (F.col("o_orderkey").cast("double") % 3200) / 3200.0
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("long").alias("k"),
        fixed4(v * 1000).alias("fixed"),
        plain4(v).alias("plain"),
        percent2(v).alias("share"),
        rounded(v, 2).alias("two"),
    )


def dirty_events(spark, sf_dir) -> DataFrame:
    """A CSV copy of the events, some numbers bad text, NaN or infinite, read by the declared scan."""
    path, table = out_path(spark, "dirty"), adapters.from_events(spark, sf_dir)
    n = F.coalesce(F.col("event_id"), F.col("bullet_id")).cast("long")
    bad = F.when(n % 11 == 0, "n/a").when(n % 13 == 0, "NaN").when(n % 17 == 0, "Infinity")
    columns = [
        F.when(n % 19 == 0, None).otherwise(F.col("user_id")).alias("user_id")
        if c == "user_id"
        else F.coalesce(bad, F.col(c).cast("string")).alias(c)
        if c == "curr_balance"
        else F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        if c == "created_at"
        else F.col(c)
        for c in schema.EVENT_SCHEMA.names
    ]
    table.select(columns).write.option("header", True).csv(path)
    return events.read_events(spark, path, "csv")


DIRTY = f"""src AS ({O.EVENT_SOURCES["events"]}),
    n AS (SELECT *, CAST(coalesce(event_id, bullet_id) AS BIGINT) AS k FROM src)"""


@register(
    "dirty_scan",
    O.select(
        DIRTY,
        f"""SELECT CASE WHEN k % 19 <> 0 THEN user_id END AS user_id, {O.big('count(*)', 'n')},
            {O.r('sum(bet)', 'bet')},
            {O.r('max(CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 THEN curr_balance END)', 'balance')}
            FROM n GROUP BY 1""",
    ),
)
def _(spark, sf_dir):
    """Rows of unknown users stay; bad text, NaN and infinities are missing."""
    table = dirty_events(spark, sf_dir)
    return table.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("bet").alias("bet"), F.max(numeric("curr_balance")).alias("balance")
    )


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
