import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import lists as L
from thinmarket.functions import folds as K
from thinmarket.operators import indicators as I


def one(spark, prices, expr):
    df = spark.createDataFrame([(list(map(float, prices)),)], "p array<double>")
    return df.select(expr(F.col("p")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "prices,k,want",
    [([10, 20, 30, 40, 50], 3, 40.0), ([10, 20, 30, 40, 50], 5, 30.0), ([10, 20], 3, None), ([], 3, None), ([42], 1, 42.0), ([10, 20, 30], 3, 20.0)],
)
def test_sma(spark, prices, k, want):
    assert one(spark, prices, lambda p: K.sma(p, k)) == want


def test_ema_between_and_constant_and_short(spark):
    assert 15 < one(spark, range(10, 23), lambda p: K.ema(p, 12)) < 22
    assert one(spark, [100] * 30, lambda p: K.ema(p, 12)) == pytest.approx(100)
    assert one(spark, [1, 2], lambda p: K.ema(p, 12)) is None


def test_rsi_limits(spark):
    assert one(spark, range(1, 20), K.rsi) > 95
    assert one(spark, range(20, 1, -1), K.rsi) < 5
    mixed = [44, 44.3, 44.1, 43.6, 44.3, 44.8, 45.1, 45.4, 45.8, 46.1, 45.9, 46.2, 45.6, 46.3, 46.3]
    assert 30 < one(spark, mixed, K.rsi) < 80
    assert one(spark, [1, 2], K.rsi) is None


def test_macd_sign_identity_and_short(spark):
    up = one(spark, [100 + 0.5 * i for i in range(35)], K.macd)
    down = one(spark, [200 - 0.5 * i for i in range(35)], K.macd)
    assert up["line"] > 0 > down["line"]
    assert up["histogram"] == pytest.approx(up["line"] - up["signal"])
    assert one(spark, range(25), K.macd) is None
    early = one(spark, [float(i % 7) for i in range(30)], K.macd)
    assert early["line"] is not None and early["signal"] is None


def test_bollinger(spark):
    b = one(spark, [100 + i % 5 for i in range(25)], K.bollinger)
    assert b["upper"] > b["middle"] > b["lower"]
    assert b["upper"] - b["middle"] == pytest.approx(b["middle"] - b["lower"])
    flat = one(spark, [50] * 25, K.bollinger)
    assert (flat["upper"], flat["middle"], flat["lower"]) == (50, 50, 50)
    assert one(spark, [1, 100] * 15, K.bollinger)["lower"] >= 0
    assert one(spark, range(15), K.bollinger) is None


def random_series(n_series=30, seed=5):
    rng = random.Random(seed)
    out = []
    for c in range(n_series):
        n, p, xs = rng.choice([1, 5, 14, 15, 26, 27, 28, 29, 34, 35, 36, 60, 120]), 100.0, []
        for _ in range(n):
            p = max(0.5, p * rng.uniform(0.85, 1.18)) if rng.random() > 0.1 else p
            xs.append(p * (rng.choice([0.1, 6.0]) if rng.random() < 0.04 else 1.0))
        out.append((c, xs))
    return out


def test_folds_equal_lists(spark):
    data = random_series()
    df = spark.createDataFrame(data, "card_id long, p array<double>")
    p = F.col("p")
    got = df.select("card_id", K.ema(p, 12).alias("e"), K.rsi(p).alias("r"), K.macd(p).alias("m"), K.adx(p).alias("a")).collect()
    series = dict(data)
    for row in got:
        xs = series[row["card_id"]]
        line, signal = L.macd(xs)
        assert L.close(row["e"], L.ema(xs, 12))
        assert L.close(row["r"], L.rsi(xs))
        assert L.close(row["a"], L.adx(xs))
        assert L.close(row["m"]["line"] if row["m"] else None, line)
        assert L.close(row["m"]["signal"] if row["m"] else None, signal)


def test_every_prefix_of_the_trajectory():
    data = [xs for _, xs in random_series(seed=9)]
    n = np.array([len(x) for x in data])
    p = np.full((len(data), n.max()), np.nan)
    for row, xs in zip(p, data):
        row[: len(xs)] = xs
    raw = I.trajectory_matrix(p, n, clean=False)
    cleaned = I.clean_matrix(p, n)

    def value(m, r, i):
        return None if np.isnan(m[r, i]) else float(m[r, i])

    for r, xs in enumerate(data):
        assert list(cleaned[r, : n[r]]) == pytest.approx(L.clean(xs))
        for i in range(0, n[r], 3):
            head = xs[: i + 1]
            line, signal = L.macd(head)
            assert L.close(value(raw["ema_26"], r, i), L.ema(head, 26))
            assert L.close(value(raw["rsi"], r, i), L.rsi(head))
            assert L.close(value(raw["adx"], r, i), L.adx(head))
            assert L.close(value(raw["line"], r, i), line) and L.close(value(raw["signal"], r, i), signal)
