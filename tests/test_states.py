from datetime import date, timedelta

import pytest

from daytide.operators import chartdata, states

DAY = date(2026, 1, 1)

# Published profile of a four-state run and its transition matrix.
PROFILE = [
    # state, streak, days7, amount ratio, count ratio, churn, rtp, share, label
    (1, 3.3822691241550356, 1.2327919077955551, 0.3140073761854584, 0.3478260869565217,
     0.7657068860450944, 0.7336044725360857, 0.5582719984361977, "衰退/流失前状态"),
    (3, 8.742364952997796, 2.1604146988710475, 3.5673874893690583, 3.107817640607865,
     0.396082067926278, 1.0316875163824921, 0.12072228119663457, "低频回访状态"),
    (2, 0.5989990757230776, 4.05707973579206, 0.0519675202998126, 0.0692515239332467,
     0.24184858337203902, 0.34947588801185614, 0.12043178319618389, "稳定活跃状态"),
    (0, 0.08634505536154201, 3.9069411732856874, 0.8907737639023725, 0.8950411640819453,
     0.194992067324274, 0.934571160226405, 0.20057393717098387, "稳定活跃状态"),
]
TRANSITIONS = [
    [0.5721272213822274, 0.10579278856244441, 0.22515189595163929, 0.0969280941036889],
    [0.11338667047325557, 0.5018242303315839, 0.11621354475607192, 0.26857555443908865],
    [0.21621124639853334, 0.22327253653026255, 0.4314790733406003, 0.1290371437306037],
    [0.27767074765280286, 0.27922667587547056, 0.18417037891105328, 0.2589321975606732],
]
TWO_STEP_FIRST_ROW = [0.4149195179127543, 0.19095146328672757, 0.2561096988325182, 0.13801931996799988]
PERCENT_LAST_ROW = [27.8, 27.9, 18.4, 25.9]


def profile_frame(spark, rows=PROFILE):
    return spark.createDataFrame(
        rows,
        "hmm_state int, no_bet_streak_days_mean double, bet_days_7d_mean double, "
        "bet_amount_ratio_today_vs_history_median double, "
        "bet_count_ratio_today_vs_history_median double, churn7_rate double, "
        "rtp_day_mean double, row_share double, expected string",
    )


def transition_frame(spark):
    cells = [(a, b, p) for a, row in enumerate(TRANSITIONS) for b, p in enumerate(row)]
    return spark.createDataFrame(cells, "from_state int, to_state int, p double")


def days(spark, rows):
    return spark.createDataFrame(
        [(u, DAY + timedelta(days=d), s) for u, d, s in rows],
        "user_id string, bet_date date, hmm_state int",
    )


def labelled(spark, rows):
    out = states.label_user_days(days(spark, rows)).orderBy("user_id", "bet_date")
    return out.collect()


def test_published_profile_gives_published_labels(spark):
    out = profile_frame(spark).withColumn("label", states.state_label()).collect()
    assert [r["label"] for r in out] == [r["expected"] for r in out]


@pytest.mark.parametrize(
    "streak, days7, amount, count, churn, rtp, label",
    [
        (3.0, 5.0, 9.0, 9.0, 0.55, 0.1, "衰退/流失前状态"),
        (0.0, 1.25, 9.0, 9.0, None, 0.1, "低频回访状态"),
        (0.0, 5.0, 1.4, 0.0, 0.9, 0.74, "高投入追损状态"),
        (0.0, 5.0, None, 1.4, 0.9, None, "高投入增长状态"),
        (0.0, 2.3, 1.0, 1.0, 0.35, 1.0, "稳定活跃状态"),
        (0.0, 2.3, 1.0, 1.0, None, 1.0, "低频试探状态"),
        (None, None, None, None, None, None, "低频试探状态"),
    ],
)
def test_label_rules(spark, streak, days7, amount, count, churn, rtp, label):
    df = profile_frame(spark, [(0, streak, days7, amount, count, churn, rtp, 1.0, label)])
    assert df.select(states.state_label()).first()[0] == label


def test_two_step_matrix(spark):
    out = states.two_step_transitions(transition_frame(spark)).where("from_state = 0")
    got = [r["p"] for r in out.orderBy("to_state").collect()]
    assert got == pytest.approx(TWO_STEP_FIRST_ROW, abs=1e-15)


def test_readable_transitions(spark):
    labels = {s: f"S{s}" for s in range(4)}
    out = states.readable_transitions(transition_frame(spark), labels).collect()
    assert out[3]["state"] == "S3"
    assert list(out[3][1:]) == PERCENT_LAST_ROW


def test_durations_restart_with_every_change(spark):
    rows = [("u", 0, 0), ("u", 1, 0), ("u", 9, 1), ("u", 10, 0), ("v", 0, 0)]
    assert [r["hmm_state_duration_days"] for r in labelled(spark, rows)] == [1, 2, 1, 1, 1]


def test_churn_rule_is_asymmetric(spark):
    rows = [("a", 0, 0), ("a", 7, 0), ("a", 15, 0)]  # gaps 6 and 7
    rows += [("last", 20, 0), ("seven", 13, 0), ("six", 14, 0)]
    got = {(r["user_id"], (r["bet_date"] - DAY).days): r["churn7_proxy"] for r in labelled(spark, rows)}
    assert got["a", 0] == 0.0
    assert got["a", 7] == 1.0
    assert got["a", 15] is None
    assert got["seven", 13] == 1.0
    assert got["six", 14] is None
    assert got["last", 20] is None


def test_next_gap(spark):
    out = labelled(spark, [("u", 0, 0), ("u", 1, 0), ("u", 5, 0)])
    assert [r["next_gap_days"] for r in out] == [0, 3, None]
    assert out[0]["next_bet_date"] == DAY + timedelta(days=1)


def test_states_attach_by_key(spark):
    features = days(spark, [("u", 0, 5), ("u", 1, 5)]).drop("hmm_state")
    marks = days(spark, [("u", 1, 1), ("u", 0, 0)])
    out = states.attach_states(features, marks).orderBy("bet_date").collect()
    assert [r["hmm_state"] for r in out] == [0, 1]


def test_state_bars_from_readable_profile(spark):
    cols = {n: 1.0 for n in states.PROFILE_COLUMNS} | {"rows": 1, "users": 1}
    rows = [cols | {"hmm_state": s, "row_share": share, "churn7_rate": churn, "label": label}
            for s, _, _, _, _, churn, _, share, label in PROFILE]
    profile = spark.createDataFrame(
        [tuple(r[c] for c in [*states.PROFILE_COLUMNS, "label"]) for r in rows],
        [*states.PROFILE_COLUMNS, "label"],
    )
    readable = states.readable_profile(profile)
    assert [(r["row_share_pct"], r["churn7_rate_pct"]) for r in readable.collect()] == [
        (20.06, 19.5), (55.83, 76.57), (12.04, 24.18), (12.07, 39.61),
    ]
    named = states.readable_profile(profile, {0: "calm"}).collect()
    assert [r["manual_label"] for r in named][:2] == ["calm", "衰退/流失前状态"]
    assert chartdata.state_bars(readable).first()["state_label"] == "S0 Stable Active"


def test_attached_keys_are_compared(spark):
    days = [("a", date(2026, 1, 1)), ("a", date(2026, 1, 2)), (None, date(2026, 1, 1))]
    features = spark.createDataFrame(days, "user_id string, bet_date date")
    kind = "user_id string, bet_date date, hmm_state int"

    def check(rows):
        states.check_attached(features, spark.createDataFrame(rows, kind))

    whole = [(*d, 1) for d in days]
    check(whole[::-1])
    others = [
        whole[:2],
        whole + whole[:1],
        whole[:2] + whole[:1],
        whole[:2] + [("b", date(2026, 1, 1), 1)],
        whole[:2] + [(*days[2], None)],
    ]
    for rows in others:
        with pytest.raises(ValueError):
            check(rows)
