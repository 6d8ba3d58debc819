"""A card's series goes through one exchange, its history through no window, and reports sort counts, not rows."""

import datetime as dt
import math
import statistics

import pyarrow as pa

from thinmarket.operators import desk as D
from thinmarket.operators import history as H
from thinmarket.operators import indicators as I
from thinmarket.operators import predictions as R
from thinmarket.operators import series as S
from thinmarket.plans import desk
from thinmarket.plans.binding import Tables

BAR = "card_id long, date date, seq long, variant string, condition string, market_price double, low_price double, high_price double, mid_price double"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_last_bar_of_a_day_takes_one_exchange(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 5, "a", "x", 1.0), (1, day, 7, "a", "x", 2.0), (1, day, 7, "b", None, 3.0), (1, day, None, "z", "z", 4.0), (1, dt.date(2024, 1, 2), 1, "a", "x", 5.0),
            (2, None, 1, "a", "x", 6.0), (2, None, 2, "a", "x", 7.0), (3, None, 1, "a", "x", 8.0), (3, day, 1, "a", "x", 9.0), (3, day, 9, "a", "x", None)]
    bars = spark.createDataFrame([(*r, r[5], r[5], r[5]) for r in rows], BAR)
    got = {(r.card_id, r.date): r.price for r in S.dedup_by_date(bars).collect()}
    assert got == {(1, day): 3.0, (1, dt.date(2024, 1, 2)): 5.0, (2, None): 7.0, (3, None): 8.0, (3, day): 9.0}
    assert physical(S.series_arrays(S.dedup_by_date(bars))).count("Exchange hashpartitioning") == 1


def test_histories_by_position_against_plain_slices():
    series = [[10.0 + (7 * k) % 11 + 0.1 * k for k in range(230)], [5.0] * 70, [3.0, 4.0], []]
    made = I.history_lists(pa.array(series, pa.list_(pa.float64()))).to_pylist()

    def near(a, b):
        return a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)

    for xs, t in zip(series, made):
        mean = lambda i, k: statistics.fmean(xs[max(0, i - k + 1) : i + 1])
        for i in range(len(xs)):
            last = lambda k: xs[max(0, i - k + 1) : i + 1]
            for k in (7, 30, 200):
                assert near(t[f"sma_{k}"][i], mean(i, k) if i + 1 >= k else None)
            for k in (7, 30):
                assert near(t[f"prev_sma_{k}"][i], mean(i - 1, k) if i >= k else None)
            assert near(t["old_sma_200"][i], mean(i - 10, 200) if i >= 209 else mean(i, 200) if i >= 199 else None)
            assert near(t["mean_60"][i], mean(i, 60)) and near(t["std_60"][i], statistics.pstdev(last(60)))
            assert near(t["mid20"][i], mean(i, 20)) and near(t["dev20"][i], statistics.stdev(last(20)) if i else None)
            assert (t["high_30"][i], t["low_30"][i], t["high_90"][i]) == (max(last(30)), min(last(30)), max(last(90)))
            assert [t[f"p{k + 1}"][i] for k in (6, 13, 29)] == [xs[i - k] if i >= k else None for k in (6, 13, 29)]
    assert set(made[1]["std_60"]) == {0.0} and len(made[3]["rsi"]) == 0


def test_the_history_of_a_card_needs_no_window(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=2 * k) for k in range(8)]
    series = spark.createDataFrame([(1, d, 5.0 + k, 4.0, 6.0, 5.0) for k, d in enumerate(days)], "card_id long, date date, price double, low double, high double, mid double")
    panel = H.trajectory_panel(series)
    assert "Window" not in physical(panel)
    got = {r.i: r for r in panel.collect()}
    assert [got[k].next_date for k in range(1, 9)] == [*days[1:], None]
    assert got[8].p7 == 6.0 and got[8].change_7 == 1.0 and got[8].sma_7 == 9.0 and got[1].p7 is None


def test_the_report_sorts_counts_and_keeps_the_first_of_equals(spark):
    rows = [(9, "a", "buy", 5.0, "correct"), (4, "a", "buy", 5.0, "correct"), (6, "a", "hold", -2.0, "incorrect"), (3, "b", "buy", -2.0, "incorrect"),
            (1, "b", "buy", None, "incorrect"), (2, "b", "buy", 99.0, "pending")]
    done = spark.createDataFrame(rows, "prediction_id long, source string, signal string, return_pct_30d double, outcome string")
    report = R.accuracy_report(done)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand"):]
    got = {(r.source, r.signal): tuple(r)[2:] for r in report.collect()}
    assert got == {(None, None): (5, 2, 40.0, 4, 3), ("a", None): (3, 2, 66.7, 4, 6), ("b", None): (2, 0, 0.0, 3, 3), (None, "buy"): (4, 2, 50.0, 4, 3), (None, "hold"): (1, 0, 0.0, 6, 6)}


def test_rules_ask_for_no_trend_of_the_metrics(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    hits = D.rule_hits(desk.panel(t), ("velocity_spike",)).select("card_id", "strength", "composite_score")
    assert "n_rows" not in hits._jdf.queryExecution().optimizedPlan().toString()
