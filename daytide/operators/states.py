"""Analytics of user-days that carry a state, whatever model gave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytide.functions.columns import nan_to_null, rounded
from daytide.functions.quantiles import exact_quantiles
from daytide.functions.shape import to_long

# Profile columns by the aggregate they use.
MEAN_COLUMNS = {
    "bet_days_7d_mean": "bet_days_7d",
    "no_bet_streak_days_mean": "no_bet_streak_days",
    "bet_interval_day_mean": "bet_interval_day",
    "avg_bet_one_time_today_log_mean": "avg_bet_one_time_today_log",
    "rtp_7_bet_days_mean": "rtp_7_bet_days",
    "rtp_day_mean": "rtp_day",
    "churn7_rate": "churn7_proxy",
    "next_gap_days_mean": "next_gap_days",
}
MEDIAN_COLUMNS = {
    "bet_amount_ratio_today_vs_history_median": "bet_amount_ratio_today_vs_history",
    "bet_count_ratio_today_vs_history_median": "bet_count_ratio_today_vs_history",
    "max_consecutive_loss_count_today_median": "max_consecutive_loss_count_today",
    "current_balance_max_to_avg_bet_ratio_median": "current_balance_max_to_avg_bet_ratio",
    "bet_count_today_median": "bet_count_today",
    "bet_amount_today_median": "bet_amount_today",
    "state_duration_median": "hmm_state_duration_days",
}
PROFILE_COLUMNS = [
    "hmm_state",
    "rows",
    "users",
    "bet_days_7d_mean",
    "no_bet_streak_days_mean",
    "bet_interval_day_mean",
    "bet_amount_ratio_today_vs_history_median",
    "bet_count_ratio_today_vs_history_median",
    "avg_bet_one_time_today_log_mean",
    "rtp_7_bet_days_mean",
    "rtp_day_mean",
    "max_consecutive_loss_count_today_median",
    "current_balance_max_to_avg_bet_ratio_median",
    "bet_count_today_median",
    "bet_amount_today_median",
    "churn7_rate",
    "next_gap_days_mean",
    "state_duration_median",
    "row_share",
]


def attach_states(features: DataFrame, states: DataFrame) -> DataFrame:
    """Join (user_id, bet_date, hmm_state) to the raw features by key.

    Days of an unknown (NULL) user form one sequence like any other and keep their rows.
    """
    f, s = features.alias("f"), states.alias("s")
    same = F.col("f.user_id").eqNullSafe(F.col("s.user_id")) & (F.col("f.bet_date") == F.col("s.bet_date"))
    added = [F.col(f"s.{c}") for c in states.columns if c not in ("user_id", "bet_date")]
    return f.join(s, same).select("f.*", *added)


def _key_sums(table: DataFrame) -> list:
    """Rows and two sums of hashes over the keys: equal for equal keys in any order."""
    keys = ("user_id", "bet_date")
    sums = [F.sum(F.xxhash64(F.lit(i), *keys).cast("decimal(38,0)")) for i in range(2)]
    return [F.count("*"), *sums]


def check_attached(features: DataFrame, labelled: DataFrame) -> None:
    """Raise unless every user-day got exactly one state. Give written tables.

    The keys are compared by sums of their hashes, so no key is moved: lost, foreign and
    repeated keys change the sums.
    """
    want = features.agg(*_key_sums(features)).first()
    *got, states = labelled.agg(*_key_sums(labelled), F.count("hmm_state")).first()
    if got != list(want) or states != want[0]:
        raise ValueError(f"{want[0]} user-days, but {got[0]} labelled rows, {states} states, or other keys")


def label_decoded(features: DataFrame, decoded: DataFrame, churn_days: int = 7) -> DataFrame:
    """Features joined to (user_id, bet_date, hmm_state) and its labels.

    The windows run on the three narrow columns; the wide features move once, in the join.
    """
    return attach_states(features, label_user_days(decoded, churn_days, features))


def label_user_days(
    labelled: DataFrame, churn_days: int = 7, calendar: DataFrame | None = None
) -> DataFrame:
    """Add duration in state, next betting date, gap and churn proxy.

    Durations count betting-day rows. The churn rule is not symmetric: a seen gap needs
    ``churn_days`` idle days, the last row only a date ``churn_days`` before the end.
    All windows share one exchange by user; a user has one row per day at most. The last
    date is read from ``calendar`` if that is cheaper to scan than the labelled rows.
    """
    by_day = Window.partitionBy("user_id").orderBy("bet_date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    changed = F.lag("hmm_state").over(by_day).eqNullSafe(F.col("hmm_state"))
    next_date = F.col("next_bet_date")
    last_date = (labelled if calendar is None else calendar).agg(F.max("bet_date")).scalar()
    return (
        labelled.withColumn("next_bet_date", F.lead("bet_date").over(by_day))
        .withColumn("_row", F.row_number().over(by_day))
        .withColumn("_start", F.when(~changed, F.col("_row")))
        .withColumn(
            "hmm_state_duration_days",
            (F.col("_row") - F.max("_start").over(so_far) + 1).cast("long"),
        )
        .withColumn("next_gap_days", F.datediff(next_date, F.col("bet_date")) - 1)
        .withColumn(
            "churn7_proxy",
            F.when(
                next_date.isNotNull(), (F.col("next_gap_days") >= churn_days).cast("double")
            ).when(F.col("bet_date") <= F.date_sub(last_date, churn_days), F.lit(1.0)),
        )
        .select(
            *labelled.columns,
            "hmm_state_duration_days",
            "next_bet_date",
            "next_gap_days",
            "churn7_proxy",
        )
    )


def state_label(
    idle_streak: float = 3.0,
    rare_days: float = 1.25,
    churn_high: float = 0.55,
    surge: float = 1.4,
    chasing_rtp: float = 0.75,
    active_days: float = 2.3,
    churn_low: float = 0.35,
) -> Column:
    """Rule label of a profile row; the first rule that holds wins, missing never holds."""
    col = F.col
    rare = (col("no_bet_streak_days_mean") >= idle_streak) | (
        col("bet_days_7d_mean") <= rare_days
    )
    surging = (col("bet_amount_ratio_today_vs_history_median") >= surge) | (
        col("bet_count_ratio_today_vs_history_median") >= surge
    )
    leaving = col("churn7_rate") >= churn_high
    chasing = col("rtp_day_mean") < chasing_rtp
    steady = (col("bet_days_7d_mean") >= active_days) & (col("churn7_rate") <= churn_low)
    # Label texts.
    return (
        F.when(rare & leaving, F.lit("衰退/流失前状态"))
        .when(rare, F.lit("低频回访状态"))
        .when(surging & chasing, F.lit("高投入追损状态"))
        .when(surging, F.lit("高投入增长状态"))
        .when(steady, F.lit("稳定活跃状态"))
        .otherwise(F.lit("低频试探状态"))
    )


def state_profile(labelled: DataFrame) -> DataFrame:
    """One row per state on raw features, missing values skipped; riskiest first.

    Few states share all rows, so medians use the distributed quantiles and the rest
    combines map-side. Scans the input several times: pass a staged table.
    """
    means = labelled.groupBy("hmm_state").agg(
        F.count("*").alias("rows"),
        F.count_distinct("user_id").alias("users"),
        *(
            F.avg(nan_to_null(F.col(c).cast("double"))).alias(name)
            for name, c in MEAN_COLUMNS.items()
        ),
    )
    long = to_long(
        labelled.select(
            "hmm_state",
            *(nan_to_null(F.col(c).cast("double")).alias(n) for n, c in MEDIAN_COLUMNS.items()),
        ),
        ["hmm_state"],
        list(MEDIAN_COLUMNS),
    )
    medians = (
        exact_quantiles(long, ["hmm_state", "feature"], "x", {"m": 0.5})
        .groupBy("hmm_state")
        .agg(*(F.max(F.when(F.col("feature") == n, F.col("m"))).alias(n) for n in MEDIAN_COLUMNS))
    )
    # One row per state on both sides, and in the window.
    return (
        means.join(F.broadcast(medians), "hmm_state", "left")
        .withColumn("row_share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
        .select(*PROFILE_COLUMNS, state_label().alias("label"))
        .orderBy(
            F.col("churn7_rate").desc_nulls_last(),
            F.col("no_bet_streak_days_mean").desc_nulls_last(),
        )
    )


def readable_profile(profile: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Profile by state with a display label and percentages.

    State numbers of a fitted model are arbitrary, so hand-written names are an argument;
    without them the rule label is shown.
    """
    label = F.col("label")
    if names:
        pairs = [F.lit(v) for item in names.items() for v in item]
        label = F.coalesce(F.create_map(*pairs)[F.col("hmm_state")], label)
    return profile.select(
        "hmm_state",
        label.alias("manual_label"),
        "rows",
        rounded(F.col("row_share") * 100, 2).alias("row_share_pct"),
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
        rounded(F.col("churn7_rate") * 100, 2).alias("churn7_rate_pct"),
        "state_duration_median",
    ).orderBy("hmm_state")


def two_step_transitions(transitions: DataFrame) -> DataFrame:
    """(from_state, to_state, p) after two steps: the matrix times itself."""
    a = transitions.alias("a")
    b = transitions.alias("b")
    return (
        a.join(b, F.col("a.to_state") == F.col("b.from_state"))
        .groupBy(F.col("a.from_state").alias("from_state"), F.col("b.to_state").alias("to_state"))
        .agg(F.sum(F.col("a.p") * F.col("b.p")).alias("p"))
    )


def readable_transitions(transitions: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Square table of percentages with one decimal and labelled rows and columns."""
    pairs = [F.lit(v) for item in labels.items() for v in item]
    name = F.create_map(*pairs)
    return (
        transitions.select(
            F.col("from_state"),
            name[F.col("from_state")].alias("state"),
            name[F.col("to_state")].alias("to_label"),
            rounded(F.col("p") * 100, 1).alias("pct"),
        )
        .groupBy("from_state", "state")
        .pivot("to_label", list(labels.values()))
        .agg(F.first("pct"))
        .orderBy("from_state")
        .drop("from_state")
    )
