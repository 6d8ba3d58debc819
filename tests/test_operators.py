import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

import lists as L
from thinmarket.functions import text as X
from thinmarket.operators import backtest as B
from thinmarket.operators import catalogue as C
from thinmarket.operators import ledger as G
from thinmarket.operators import market as M
from thinmarket.operators import picks as P
from thinmarket.operators import sales as A
from thinmarket.operators import series as S
from thinmarket.operators import strategies as H

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def test_medians_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0, round(rng.uniform(1, 50), 1)) for _ in range(5001)] + [(k, float(v)) for k in range(1, 6) for v in range(k)]
    got = A.grouped_medians(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", {"m": F.lit(True), "low": F.col("v") < 25})
    for row in got.collect():
        mine = sorted(v for g, v in rows if g == row["g"])
        assert row["m_median"] == statistics.median(mine) and row["m_upper"] == mine[len(mine) // 2] and row["m_count"] == len(mine)
        small = [v for v in mine if v < 25]
        assert row["low_median"] == statistics.median(small)


def test_rank_filters_are_cut_before_the_shuffle(spark):
    rows = spark.range(10000).select((F.col("id") % 3).alias("card_id"), F.col("id").cast("timestamp").alias("order_date"), F.col("id").alias("seq"), F.col("id").alias("item_id"), F.col("id").cast("double").alias("purchase_price"))
    df = A.newest_sales(rows, 5)
    assert df.count() == 15
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_nearest_price_earlier_wins_and_tolerance(spark):
    series = spark.createDataFrame([(1, day(0), 10.0), (1, day(4), 20.0), (1, day(20), 30.0)], "card_id long, date date, price double")
    asked = spark.createDataFrame([(1, day(2), 1), (1, day(3), 2), (1, day(10), 3), (1, day(19), 4)], "card_id long, day date, k long")
    got = {r["k"]: r["near_price"] for r in S.nearest_price(asked, series, ["card_id"], "day", 3, "k").collect()}
    assert got == {1: 10.0, 2: 20.0, 3: None, 4: 30.0}
    back = {r["k"]: r["asof_price"] for r in S.asof_price(asked, series, ["card_id"], "day", "k").collect()}
    assert back == {1: 10.0, 2: 10.0, 3: 20.0, 4: 20.0}


def test_holdings_summary_by_hand(spark):
    rows = [(1, 10, "NM", 120.0, 20.0, 20.0), (1, 11, "NM", 50.0, -50.0, -50.0), (1, 12, "LP", 60.0, 10.0, 20.0), (1, 13, "NM", 500.0, 500.0, None), (2, 10, "NM", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "portfolio_id long, card_id long, condition string, value double, pnl double, pnl_pct double")
    got = {r.portfolio_id: r for r in G.holdings_summary(df).collect()}
    one, two = got[1], got[2]
    assert (one.holdings, one.total_value, one.total_cost, one.total_pnl) == (4, 730.0, 250.0, 480.0)
    assert (one.best_card_id, one.best_pct, one.worst_card_id, one.worst_pct) == (10, 20.0, 11, -50.0)  # 12 ties, 13 has no cost
    assert (one.largest_card_id, one.largest_pct) == (13, round(500 / 730 * 100, 2))
    assert (two.best_card_id, two.worst_card_id, two.largest_card_id, two.largest_pct, two.total_pnl) == (None, None, None, 0.0, None)
    assert G.holdings_summary(df.limit(0)).count() == 0


def test_recent_trades_are_cut_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.col("id").alias("trade_id"), (F.col("id") % 50 == 0).cast("long").alias("portfolio_id"), (F.col("id") % 3).alias("card_id"), (F.col("id") / 2).cast("long").cast("timestamp").alias("executed_at"))
    df = G.recent_trades(rows, spark.createDataFrame([(0, "a"), (1, None)], "card_id long, name string"))
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    got = sorted((r.rank, r.trade_id, r.card_name) for r in df.filter("portfolio_id = 0").collect())
    want = [i for i in range(4999, 0, -1) if i % 50][:20]
    assert got == [(k + 1, i, "a" if i % 3 == 0 else "Unknown") for k, i in enumerate(want)]


def test_snapshots_carry_the_last_mark_of_the_day(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    marks = spark.createDataFrame([(1, 1, at(1, 9), 110.0, 60.0, 50.0, 2), (1, 2, at(1, 17), 120.0, 20.0, 100.0, 3), (1, 3, at(2, 9), 90.0, 90.0, None, 0)], "portfolio_id long, mark_id long, marked_at timestamp, total_value double, cash double, positions_value double, num_positions int")
    got = [(r.total_value, r.daily_pnl, r.cash, r.positions_value, r.num_positions, r.drawdown_pct) for r in G.daily_snapshots(marks, 100.0).orderBy("date").collect()]
    assert got == [(120.0, 20.0, 20.0, 100.0, 3, 0.0), (90.0, -30.0, 90.0, None, 0, 25.0)]
    assert "cash" not in G.daily_snapshots(marks.drop("cash"), 100.0).columns


def test_overview_tiers_count_viable_cards_and_totals_tracked_ones(spark):
    cards = spark.createDataFrame([
        (1, "a", "s", "n", True, 200.0, True), (2, "b", "s", "n", False, 60.0, True), (3, "c", "s", "n", True, 30.0, False), (4, "d", "s", "n", True, None, True),
    ], "card_id long, name string, set_name string, price_variant string, is_tracked boolean, current_price double, is_viable boolean")
    bars = spark.createDataFrame([(1, day(1), "n", 100.0), (1, day(10), "n", 200.0), (3, day(1), "n", 40.0), (3, day(10), "n", 30.0)], "card_id long, date date, variant string, market_price double")
    rows = {r.section: r for r in M.market_overview(cards, bars, F.lit(day(10))).collect()}
    m = rows["market"]
    assert (m.total_cards, m.avg_price, m.total_value, m.min_price, m.max_price) == (2, 115.0, 230.0, 30.0, 200.0) and (m.premium, m.mid_high, m.mid) == (1, 1, 0)
    assert (rows["gainer"].card_id, rows["gainer"].change_pct, rows["loser"].card_id, rows["loser"].change_pct) == (1, 100.0, 3, -25.0)


def wild_series(spark, n_cards=12, n=90, seed=11):
    rng = random.Random(seed)
    rows = []
    for c in range(n_cards):
        p = 60.0
        for i in range(n):
            p = max(2.0, p * rng.uniform(0.8, 1.24))
            rows.append((c, day(i), p, p * 0.9, p * 1.1, p))
    return spark.createDataFrame(rows, "card_id long, date date, price double, low double, high double, mid double")


def points_of(spark, series, strategies):
    rows = H.signal_rows(H.indicator_panel(series), strategies).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        out.setdefault((r["card_id"], r["strategy"]), []).append((r["price"], r["signal"]))
    return out


def test_backtest_equals_the_loop(spark):
    series = wild_series(spark).cache()
    loops = points_of(spark, series, tuple(H.STRATEGIES))
    assert any(s for pts in loops.values() for _, s in pts)
    for r in B.backtest_all(series).collect():
        final, trades, _, values = L.walk(loops[(r["card_id"], r["strategy"])])
        assert r["total_trades"] == trades
        assert L.close(r["strategy_return_pct"], round(L.percent(1000, final), 2), 0.011)
        peak, worst = 1000.0, 0.0
        for v in values:
            peak = max(peak, v)
            worst = max(worst, (peak - v) / peak * 100)
        assert L.close(r["max_drawdown_pct"], round(worst, 2), 0.011)


def test_fees_and_an_emptied_account(spark):
    series = wild_series(spark, seed=17).cache()
    loops = points_of(spark, series, ("combined", "bollinger_bounce"))
    emptied = 0
    for capital in (1000.0, 12.0):
        for r in B.backtest_fees(series, ("combined", "bollinger_bounce"), capital).collect():
            final, trades, fees, _ = L.walk(loops[(r["card_id"], r["strategy"])], capital, 0.1325, 4.8)
            emptied += final == 0
            assert r["total_trades"] == trades
            assert L.close(r["total_fees_paid"], round(fees, 2), 0.02)
            assert L.close(r["strategy_return_pct"], round(L.percent(capital, final), 2), 0.02)
    assert emptied > 0


def test_rsi_strategy_fires_on_trends(spark):
    down = [(1, day(i), 200.0 - 3 * i) for i in range(40)] + [(2, day(i), 50.0 + 3 * i) for i in range(40)]
    df = spark.createDataFrame([(c, d, p, p, p, p) for c, d, p in down], "card_id long, date date, price double, low double, high double, mid double")
    got = {(r["card_id"], r["signal"]) for r in H.signal_rows(H.indicator_panel(df), ("rsi_mean_reversion",)).collect()}
    assert got == {(1, "buy"), (2, "sell")}


def test_similar_cards_against_all_pairs(spark):
    rng = random.Random(8)
    names = ["ember", "ember ex", "embers V", "tide", "tide GX", "riptide", "moss", "mossy", "stone"]
    rows = [(i, rng.choice(names), f"s{rng.randrange(4)}", float(rng.randrange(1, 400)) + i / 1000) for i in range(120)]
    cards = spark.createDataFrame(rows, "card_id long, name string, set_name string, current_price double")
    prices = cards.select("card_id", F.lit(DAY0).alias("date"), F.col("current_price").alias("price"))
    got = {}
    for r in C.similar_cards(cards, prices, F.lit(day(30))).collect():
        got.setdefault((r["card_id"], r["kind"]), set()).add(r["similar_id"])
    base = {r["card_id"]: r["b"].lower() for r in cards.select("card_id", X.base_name(F.col("name")).alias("b")).collect()}
    for i, name, s, _ in rows:
        order = sorted(rows, key=lambda r: -r[3])
        far = {r[0] for r in [r for r in order if base[i] in r[1].lower() and r[2] != s][:3]}
        near = {r[0] for r in [r for r in order if base[i] not in r[1].lower() and r[2] == s][:3]}
        assert got.get((i, "namesake"), set()) == far and got.get((i, "same_set"), set()) == near


def test_positions_fold_restarts_when_flat(spark):
    ts = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(1, 1, 7, "buy", 2, 10.0, "a", ts(0)), (2, 1, 7, "buy", 1, 13.0, "a", ts(1)), (3, 1, 7, "sell", 3, 20.0, "a", ts(2)), (4, 1, 7, "buy", 2, 30.0, "b", ts(3)), (5, 1, 7, "buy", 1, 33.01, "b", ts(4)), (6, 1, 7, "sell", 1, 9.0, "b", ts(5))]
    df = spark.createDataFrame(rows, "trade_id long, portfolio_id long, card_id long, side string, quantity int, price double, strategy string, executed_at timestamp")
    (p,) = G.positions_from_trades(df).collect()
    assert (p["quantity"], p["avg_entry_price"], p["strategy"], p["entry_date"]) == (2, 31.0, "b", ts(3))


def test_picks_one_card_each_in_order(spark):
    text = "talk\nCore Holdings\n1. **Ember ex** — Dawn — $100 — Premium\n   Strategy: BUY NOW\n2) Ember ex — Dusk — $105.50 — Mid-High\n   Strategy: ACCUMULATE on PULLBACK\n3. Ember ex — $99\n4. Tide — $900\n\nWatchlist\n5. Tide — $10\n"
    cards = spark.createDataFrame([(1, "Ember ex", "Dawn", 100.0), (2, "Ember ex", "Dusk", 104.0), (3, "Ember", "Dawn", 98.0), (4, "Tide", "Dawn", 10.0)], "card_id long, name string, set_name string, current_price double")
    got = {r["block"]: (r["card_id"], r["price_tier"], r["signal"]) for r in P.extract_picks(spark.createDataFrame([(1, text)], "text_id long, text string"), cards).collect()}
    assert got == {1: (1, "premium", "buy"), 2: (2, "mid_high", "watch"), 3: (3, "mid", "hold")}


def test_second_load_finds_null_keys(spark, tmp_path):
    from thinmarket.sources import sinks

    rows = spark.createDataFrame([(1, None, 2.0), (1, "Near Mint", 3.0)], "card_id long, condition string, market_price double")
    for _ in range(3):
        sinks.append_new(rows, f"{tmp_path}/prices", ["card_id", "condition"])
    assert spark.read.parquet(f"{tmp_path}/prices").count() == 2


def test_second_backfill_keeps_what_is_filled_and_closed(spark):
    from thinmarket.operators import predictions as R

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    made = spark.createDataFrame(
        [(1, 1, "buy", day(0), 10.0, None, 8.0), (2, 1, "avoid", day(0), 10.0, 100.0, 1.0), (3, 1, "hold", day(40), 10.0, None, None)],
        "prediction_id long, card_id long, signal string, predicted_at date, entry_price double, target_price double, stop_loss double",
    )
    cards = spark.createDataFrame([(1, 7.0)], "card_id long, current_price double")
    early = spark.createDataFrame([(1, day(7), 11.0), (1, day(30), 12.0)], "card_id long, date date, price double")
    later = spark.createDataFrame([(1, day(7), 99.0), (1, day(30), 5.0), (1, day(60), 13.0), (1, day(70), 10.5)], early.schema)
    first = R.backfill_predictions(made, early, cards, F.lit(day(35)))
    second = R.backfill_predictions(first, later, cards, F.lit(day(75)))
    pick = lambda df: {r["prediction_id"]: (r["price_7d"], r["price_30d"], r["return_pct_30d"], r["price_60d"], r["outcome"]) for r in df.collect()}
    assert pick(first) == {1: (11.0, 12.0, 20.0, None, "correct"), 2: (11.0, 12.0, 20.0, None, "pending"), 3: (None, None, None, None, "pending")}
    assert pick(second) == {1: (11.0, 12.0, 20.0, None, "correct"), 2: (11.0, 12.0, 20.0, 13.0, "pending"), 3: (None, 10.5, 5.0, None, "correct")}
    assert second.columns == first.columns


def test_date_bound_reaches_the_scan(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, d, h), 5.0) for d in (1, 2, 3) for h in (0, 23)]
    spark.createDataFrame(rows, "card_id long, order_date timestamp, purchase_price double").write.parquet(str(tmp_path / "s"))
    recent = spark.read.parquet(str(tmp_path / "s")).filter(A.since(F.lit(dt.date(2024, 1, 4)), 2))
    assert {r["order_date"].day for r in recent.collect()} == {2, 3} and recent.count() == 4
    assert "GreaterThanOrEqual(order_date" in recent._jdf.queryExecution().executedPlan().toString()
