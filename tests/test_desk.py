"""The desk's rules on rows made to fire them, with the numbers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from thinmarket.operators import desk as D
from thinmarket.operators import history as H

BASE = dict(
    card_id=1, name="Plain", set_id=1, set_name="s", rarity="Rare Holo", current_price=100.0, is_tracked=True, is_vintage=False, n_points=40,
    adx=20.0, regime="accumulation", rsi_14=40.0, sma_7=100.0, sma_30=100.0, bb_upper=110.0, bb_middle=100.0, bb_lower=90.0, high_30=105.0, low_30=95.0,
    high_14=107.0, high_90=130.0, mean_90=120.0, mean_60=100.0, std_60=5.0, change_7=0.03, change_14=0.02, change_30=0.1, p0=100.0, p7=97.0, p14=96.0,
    spread_pct=1.0, sales_30d=30, sales_90d=45, sales_per_day=1.0, velocity_90d=0.5, acceleration=2.0, liquidity_score=60, set_age_months=5, month=6,
    velocity=1.0, mean_velocity=0.4, z_score=3.0, vwap=101.0, vwap_sales=30,
)


def fired(spark, rules=None, **changes):
    row = {**BASE, **changes}
    df = spark.createDataFrame([row])
    hits = D.rule_hits(df) if rules is None else H.rule_hits(df, rules)
    return {r["strategy"]: r for r in hits.collect()}


def test_velocity_accumulation_momentum(spark):
    got = fired(spark)
    assert set(got) == {"velocity_spike", "accumulation_phase", "momentum_breakout"}
    # 0.4 + 0.4 * 3/4 + 0.2 * (1 - 0.03/0.30) = 0.88
    assert got["velocity_spike"]["strength"] == pytest.approx(0.88)
    assert (got["velocity_spike"]["target_price"], got["velocity_spike"]["stop_loss"]) == (125.0, 88.0)
    # (2 - 1) / 3 + 0.15 in an accumulation regime
    assert got["accumulation_phase"]["strength"] == pytest.approx(0.483)
    # rally 5/95, velocity 1/2, pullback 7/107 within 5 to 10 percent
    assert got["momentum_breakout"]["strength"] == pytest.approx(0.3 + 0.3 * (5 / 95 / 0.2) + 0.1 + 0.15, abs=5e-4)


def test_composite_score(spark):
    got = fired(spark)["velocity_spike"]
    # velocity 100, value 37.6, strength 88, sets 50, name 30, liquidity 75, fees 85; then x 1.1
    want = (100 * 0.25 + 37.6 * 0.2 + 88 * 0.15 + 5 + 3 + 7.5 + 8.5) * 1.1
    assert got["composite_score"] == pytest.approx(want, abs=0.06)


def test_rules_stay_quiet(spark):
    assert "velocity_spike" not in fired(spark, change_7=0.31)
    assert "accumulation_phase" not in fired(spark, change_14=0.06)
    assert "momentum_breakout" not in fired(spark, regime="markdown")
    assert fired(spark, current_price=19.0) == {}


def test_vintage_rules(spark):
    old = dict(is_vintage=True, regime="accumulation", rsi_14=25.0, acceleration=1.0, z_score=0.0, sales_per_day=0.1, velocity_90d=0.5)
    got = fired(spark, **old)["vintage_value_buy"]
    drop = 30 / 130
    assert got["strength"] == pytest.approx(min(1, 0.55 + (drop - 0.15) * 2.5 + 0.1), abs=5e-4) and got["target_price"] == 120.0
    past = fired(spark, H.HISTORIC_RULES, **old)["vintage_value_buy"]
    assert past["strength"] == pytest.approx(0.35 + drop / 0.4 * 0.4 + 20 / 45 * 0.25, abs=5e-4) and past["target_price"] == 118.0


def test_popularity_takes_the_best_tier(spark):
    df = spark.createDataFrame([("Dark CHARIZARD",), ("Mewtwo ex",), ("Mew",), ("Snorlax V",), ("nobody",)], "n string")
    assert [r[0] for r in df.select(D.popularity(F.col("n"))).collect()] == [95, 95, 75, 55, 30]


def test_position_size(spark):
    def size(**kw):
        v = dict(value=10000.0, cash=8000.0, price=30.0, score=100.0, velocity=5.0, vintage=False, drawdown=0.0, held=0) | kw
        return spark.range(1).select(D.position_size(*[F.lit(v[k]) for k in ("value", "cash", "price", "score", "velocity", "vintage", "drawdown", "held")])).first()[0]

    assert size() == 3 and size(price=60.0) == 2 and size(price=150.0) == 1
    assert size(drawdown=0.10) == 0 and size(cash=2500.0) == 0
    assert size(price=19.0, score=50.0) == 4 and size(vintage=True, price=60.0) == 1
