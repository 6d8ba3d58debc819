"""Hand-worked rows: ISO dates, product ids, prices filled from bars, thinned points, newest predictions, flat-buffer trajectories."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thinmarket.operators import indicators as I
from thinmarket.operators import predictions as R
from thinmarket.operators import quality as Q
from thinmarket.operators import series as S
from thinmarket.sources import feeds


def test_dates_fall_back_to_iso(spark):
    want = {
        "2024-02-03": "2024-02-03", " 2/3/2024 ": "2024-02-03", "20240203": "2024-02-03", "2024-02-03T23:59:59.123456-08:00": "2024-02-03",
        "2024-02-03 01:02": "2024-02-03", "2024-02-03T04Z": "2024-02-03", "2024-0203": None, "2024-02-30": None, "2024-02": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", feeds.parse_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == want


def test_product_ids_by_mapping_then_sales_then_search(spark):
    cards = spark.createDataFrame([(i, "Fox", "Base", "4", 70 if i == 1 else None) for i in range(1, 5)], "card_id long, name string, set_name string, number string, product_id long")
    sales = spark.createDataFrame(
        [(1, "2024-01-01", "9"), (2, "2024-01-02", "8"), (2, "2024-01-01", "x"), (2, "2024-01-01", "7"), (2, "2024-01-01", "6"), (3, "2024-01-01", None)],
        "card_id long, order_date string, source_product_id string",
    )
    found = spark.createDataFrame([(3, 1, 31, "Dark Fox", "Other", ""), (3, 2, 32, "Fox holo", "Base", "")], "card_id long, pos int, product_id long, product_name string, product_set string, product_number string")
    got = {r.card_id: (r.product_id, r.via) for r in feeds.resolve_products(cards, sales, found).collect()}
    assert got == {1: (70, "mapped"), 2: (6, "sales"), 3: (32, "search"), 4: (None, None)}
    short = {r.card_id: r.product_id for r in feeds.resolve_products(cards, sales, found, "short").collect()}
    assert short[3] == 31  # the short chain does not ask for the set
    assert feeds.resolve_products(cards.limit(0), sales, found).count() == 0


def test_only_missing_prices_are_filled(spark):
    cards = spark.createDataFrame([(1, None), (2, 0.0), (3, 5.0), (4, 0.0), (5, None)], "card_id long, current_price double")
    bars = spark.createDataFrame(
        [(1, "2024-01-01", "Near Mint", "a", 2.0), (1, "2024-01-02", "Near Mint", "a", None), (2, "2024-01-02", None, "a", 3.0), (2, "2024-01-03", "Lightly Played", "a", 9.0), (3, "2024-01-01", "Near Mint", "a", 8.0)],
        "card_id long, date string, condition string, variant string, market_price double",
    )
    got = {r.card_id: r.current_price for r in S.fill_current_prices(cards, bars).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: 5.0, 4: 0.0, 5: None}


def test_samples_keep_every_second_of_24_points(spark):
    day = dt.date(2024, 3, 1)
    rows = [(1, day + dt.timedelta(i), float(i)) for i in range(25)] + [(2, day, 7.006)]
    out = S.price_samples(spark.createDataFrame(rows, "card_id long, date date, price double"), F.lit(dt.date(2024, 3, 25)))
    got = sorted((r.card_id, r.price) for r in out.collect())
    assert got == [(1, float(i)) for i in range(0, 25, 2)] + [(2, 7.01)]


def test_newest_predictions_keep_open_ones_and_unknown_cards(spark):
    made = "prediction_id long, card_id long, signal string, source string, entry_price double, target_price double, stop_loss double, return_pct_7d double, return_pct_30d double, return_pct_90d double, outcome string, predicted_at date"
    rows = [(i, i % 2, "buy", "s", 1.0, 2.0, 0.5, None, None, None, "pending", dt.date(2024, 1, 1 + i // 2)) for i in range(30)]
    cards = spark.createDataFrame([(1, "Fox", 3.0)], "card_id long, name string, current_price double")
    got = R.newest_predictions(spark.createDataFrame(rows, made), cards).collect()
    assert {r.prediction_id for r in got} == set(range(10, 30)) and {r.name for r in got if r.card_id == 0} == {"Unknown"}


def test_oldest_update_first(spark):
    rows = [(1, 1.0, dt.datetime(2024, 1, 2)), (2, 1.0, None), (3, 1.0, dt.datetime(2024, 1, 1)), (4, None, None)]
    cards = spark.createDataFrame(rows, "card_id long, current_price double, updated_at timestamp")
    assert [r.card_id for r in Q.sync_worklist(cards, cards, 3, "oldest").collect()] == [2, 3, 1]


def test_trajectories_equal_one_series_at_a_time():
    rng = np.random.default_rng(5)
    series = [list(np.exp(rng.normal(3, 0.8, n))) for n in (0, 1, 40, 13, 27, 35, 300, 2) * 40] + [None, []]
    both = I.trajectory_lists(pa.array(series, pa.list_(pa.float64())), clean=True)
    assert len(both) == len(series) and both.flatten()[0].null_count == 0
    for i in (*range(9), 319, 320, 321):
        x = np.array(series[i] or [], dtype=float)
        alone = I.trajectory_matrix(x.reshape(1, -1) if len(x) else np.full((1, 1), np.nan), np.array([len(x)]), True)
        for name, values in both[i].as_py().items():
            assert values == [None if np.isnan(v) else v for v in alone[name][0][: len(x)]], (i, name)
    assert len(I.trajectory_lists(pa.array([], pa.list_(pa.float64())), clean=False)) == 0
