"""Prices looked up by the number of the day: equal to the bracketing look-ups, and without sorting what asks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from thinmarket.operators import catalogue as C
from thinmarket.operators import predictions as R
from thinmarket.operators import series as S


def test_equal_to_bracketing(spark):
    rng, start = random.Random(5), dt.date(2024, 1, 10)
    bars = [(c, start + dt.timedelta(days=n), float(rng.randint(1, 99))) for c in range(4) for n in sorted(rng.sample(range(60), 9))] + [(4, start, None)]
    series = spark.createDataFrame(bars, "card_id long, date date, price double")
    asked = spark.createDataFrame([(k, rng.randrange(6), start + dt.timedelta(days=rng.randint(-9, 70))) for k in range(400)] + [(999, 1, None)], "k long, card_id long, day date")
    near = {r.k: r.p for r in asked.join(S.daily_prices(series, ["card_id"]), "card_id", "left").select("k", S.price_near(F.col("day"), 3).alias("p")).collect()}
    back = {r.k: r.p for r in asked.join(S.daily_prices(series, ["card_id"], carried=True), "card_id", "left").select("k", S.price_carried(F.col("day")).alias("p")).collect()}
    assert near == {r.k: r.near_price for r in S.nearest_price(asked, series, ["card_id"], "day", 3, "k").collect()}
    assert back == {r.k: r.asof_price for r in S.asof_price(asked, series, ["card_id"], "day", "k").collect()}
    assert sum(v is not None for v in near.values()) > 50


def test_back_filling_neither_explodes_nor_sorts_predictions(spark):
    series = spark.createDataFrame([(1, dt.date(2024, 1, 8), 5.0)], "card_id long, date date, price double")
    made = spark.createDataFrame([(7, 1, dt.date(2024, 1, 1), "buy", 4.0, 5.0, 3.0)], "prediction_id long, card_id long, predicted_at date, signal string, entry_price double, target_price double, stop_loss double")
    cards = spark.createDataFrame([(1, 4.5)], "card_id long, current_price double")
    done = R.backfill_predictions(made, series, cards, F.lit(dt.date(2024, 1, 31)))
    row = done.first()
    assert (row.price_7d, row.price_14d, row.price_30d, row.return_pct_7d, row.outcome) == (5.0, None, None, 25.0, "pending")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_last_days_give_the_prices_that_all_days_give(spark):
    rng = random.Random(23)
    days = [None, *[dt.datetime(2024, 1, 1, 5) + dt.timedelta(days=n) for n in range(0, 60, 2)]]
    rows = [(rng.randrange(80), rng.choice(days), rng.choice([None, 1.0, 2.5, 7.0])) for _ in range(600)]
    rows += [(90, None, 4.0), (91, days[-1], 3.0), (91, days[-1], 4.0), (91, days[-1], 8.0), (92, days[3], None), (None, days[4], 6.0)]
    sales = spark.createDataFrame(rows, "item_id long, order_date timestamp, purchase_price double")
    as_of = sales.agg(F.max(F.to_date("order_date"))).scalar()
    every = sales.groupBy("item_id", F.to_date("order_date").alias("date")).agg(F.avg("purchase_price").alias("price"))
    last = S.last_day_prices(sales, as_of, "item_id")

    def asked(prices):
        old = F.col("date") <= dt.date(2024, 1, 1) + dt.timedelta(days=58 - 7)
        found = prices.groupBy("item_id").agg(F.max_by("price", "date").alias("now"), F.max_by("price", F.when(old, F.col("date"))).alias("old"))
        return {r.item_id: (r.now, r.old) for r in found.collect()}

    assert asked(last) == asked(every)
    assert asked(last)[91] == (5.0, None) and asked(last)[90] == (None, None)
    assert last.filter("date IS NOT NULL").count() < 2 * 84 < every.count()
    # Cut in the tasks that read the sales, before any exchange of them.
    plan = last._jdf.queryExecution().sparkPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_similar_cards_keeps_small_tables_and_cards_without_a_name_take_no_place(spark):
    names = ["ember ex", "Ember EX", "ember Ex", "embers V", "tide", "tide GX", "riptide", None]
    sets = ["a", "b", "c", None]
    rows = [(i, names[i % 8], sets[(i // 8) % 4], 1.0 + (i * 37 % 101) + i / 1000) for i in range(160)]
    cards = spark.createDataFrame(rows, "card_id long, name string, set_name string, current_price double")
    prices = spark.createDataFrame([(i, dt.date(2024, 1, n), 10.0 + n) for i in range(160) for n in (1, 2, 9)], "card_id long, date date, price double")
    kept = []

    def keep(df):
        kept.append(df)
        return df

    found = C.similar_cards(cards, prices, F.lit(dt.date(2024, 1, 9)), keep=keep).collect()
    assert sorted(df.count() for df in kept) == [7 * 3, 3 * 5 * 3]  # distinct names in sets; three cards of each lower-case name
    low, base = [(n or "").lower() for n in names], ["ember", "ember", "ember ex", "embers", "tide", "tide", "riptide", None]
    got = {}
    for r in found:
        got.setdefault((r.card_id, r.kind), set()).add(r.similar_id)
        assert r.price_change_7d == (round((r.current_price - 12.0) / 12.0 * 100 + 1e-9, 2) if abs(r.current_price - 12.0) <= 60 else None)
    order = sorted(rows, key=lambda r: -r[3])
    for i, name, s, _ in rows:
        b, named = base[i % 8], [r for r in order if r[1] and r[2] and name and s]
        assert got.get((i, "namesake"), set()) == {r[0] for r in [r for r in named if b in low[r[0] % 8] and r[2] != s][:3]}
        assert got.get((i, "same_set"), set()) == {r[0] for r in [r for r in named if b not in low[r[0] % 8] and r[2] == s][:3]}
