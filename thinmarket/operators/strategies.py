"""Point-by-point strategy signals over indicator trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.operators import indicators as I

POINT = ("card_id", "i", "n", "date", "price", "first_price", "start_date")
FIRST_POINT = 31  # indicators exist and signals start at this 1-based observation


def indicator_panel(series: DataFrame, min_points: int = 35) -> DataFrame:
    """Cleaned prices with every indicator the strategies read, at every point of every series.

    One exchange by card: the arrays come back exploded on it and all windows reuse it. The
    previous indicators are null on the first evaluated point, so crossings cannot fire there.
    """
    w = Window.partitionBy("card_id").orderBy("i")

    def back(k: int):
        return w.rowsBetween(-(k - 1), 0)

    price, i = F.col("price"), F.col("i")
    log_p = F.when(price > 0, F.log("price"))
    rows = I.trajectories(series, clean=True, min_points=min_points).withColumnRenamed("line", "macd").withColumnRenamed("signal", "macd_signal")
    mid, dev = F.avg("price").over(back(20)), F.stddev_samp("price").over(back(20))
    rows = (
        rows.withColumn("ln_p", log_p)
        .withColumn("sma_7", F.when(i >= 7, F.avg("price").over(back(7))))
        .withColumn("sma_30", F.when(i >= 30, F.avg("price").over(back(30))))
        .withColumn("middle", F.when(i >= 20, mid))
        .withColumn("upper", F.when(i >= 20, mid + 2 * dev))
        .withColumn("lower", F.when(i >= 20, F.greatest(F.lit(0.0), mid - 2 * dev)))
        .withColumn("high_20", F.when(i >= 20, F.max("price").over(back(20))))
        .withColumn("low_20", F.when(i >= 20, F.min("price").over(back(20))))
        .withColumn("slope_30", F.expr("regr_slope(ln_p, CAST(i AS DOUBLE)) OVER (PARTITION BY card_id ORDER BY i ROWS 29 PRECEDING)"))
        .withColumn("r2_30", F.expr("regr_r2(ln_p, CAST(i AS DOUBLE)) OVER (PARTITION BY card_id ORDER BY i ROWS 29 PRECEDING)"))
        .withColumn("place", F.when(F.col("upper") > F.col("lower"), (price - F.col("lower")) / (F.col("upper") - F.col("lower"))))
    )
    rows = rows.withColumn("first_price", F.first("price").over(w)).withColumn("start_date", F.first("date").over(w))
    for c in ("sma_7", "sma_30", "macd", "macd_signal", "rsi", "ema_12", "ema_26"):
        rows = rows.withColumn(f"prev_{c}", F.when(i > FIRST_POINT, F.lag(c).over(w)))
    return rows.filter(i >= FIRST_POINT)


def _cross(now_a: str, now_b: str) -> tuple[Column, Column]:
    a, b, pa, pb = F.col(now_a), F.col(now_b), F.col(f"prev_{now_a}"), F.col(f"prev_{now_b}")
    return (pa <= pb) & (a > b), (pa >= pb) & (a < b)


def _side(buy: Column, sell: Column) -> Column:
    return F.when(buy, "buy").when(sell, "sell")


def sma_crossover() -> Column:
    return _side(*_cross("sma_7", "sma_30"))


def rsi_mean_reversion() -> Column:
    return _side(F.col("rsi") < 30, F.col("rsi") > 70)


def macd_signal() -> Column:
    return _side(*_cross("macd", "macd_signal"))


def bollinger_bounce() -> Column:
    return _side(F.col("place") < 0.1, F.col("place") > 0.9)


def combined() -> Column:
    rsi, price, place = F.col("rsi"), F.col("price"), F.col("place")
    hist = F.col("macd") - F.col("macd_signal")
    votes = (
        F.when(rsi < 25, 1.0).when(rsi < 35, 0.5).when(rsi > 80, -1.0).when(rsi > 65, -0.5).when(rsi.isNotNull(), (50 - rsi) / 50),
        F.when(hist > 0, 0.5).when(hist.isNotNull(), -0.5),
        F.when(F.col("sma_30") > 0, F.when(price > F.col("sma_30"), 0.5).otherwise(-0.5)),
        F.when(place < 0.2, 0.7).when(place > 0.8, -0.7).when(place.isNotNull(), 0.0),
    )
    total = sum((F.coalesce(v, F.lit(0.0)) for v in votes[1:]), F.coalesce(votes[0], F.lit(0.0)))
    count = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in votes[1:]), F.when(votes[0].isNotNull(), 1).otherwise(0))
    strength = F.when(count > 0, total / count)
    return _side(strength > 0.15, strength < -0.15)


def momentum_breakout() -> Column:
    price, rsi, fast, slow = F.col("price"), F.col("rsi"), F.col("sma_7"), F.col("sma_30")
    width = F.col("high_20") - F.col("low_20")
    usable = fast.isNotNull() & slow.isNotNull() & rsi.isNotNull() & (width > 0)
    buy = ((price - F.col("low_20")) / width > 0.85) & (fast > slow) & (rsi < 65)
    faded = F.coalesce((F.col("prev_rsi") > 70) & (rsi < 65), F.lit(False))
    return F.when(usable, _side(buy, faded | (price < slow * 0.98)))


def mean_reversion_bands() -> Column:
    place, rsi = F.col("place"), F.col("rsi")
    sell = ((place > 0.45) & (place < 0.55) & (rsi > 45)) | (place < -0.2)
    return F.when(rsi.isNotNull(), _side((place < 0.05) & (rsi < 25), sell))


def trend_rider() -> Column:
    s7, e12, e26, s30 = F.col("sma_7"), F.col("ema_12"), F.col("ema_26"), F.col("sma_30")
    was_bearish = F.col("prev_ema_12") < F.col("prev_ema_26")
    bullish = (s7 > e12) & (e12 > e26) & (e12 > s30 * 0.99)
    bearish = (s7 < e12) & (e12 < e26)
    return _side(bullish & was_bearish, bearish & ~was_bearish)


def steady_gainer() -> Column:
    price, rsi, fast, slow = F.col("price"), F.col("rsi"), F.col("sma_7"), F.col("sma_30")
    usable = fast.isNotNull() & slow.isNotNull() & rsi.isNotNull() & F.col("middle").isNotNull()
    buy = (fast > slow) & rsi.between(40, 65) & (price > F.col("middle")) & (F.col("slope_30") > 0.001) & (F.col("r2_30") > 0.3)
    _, death = _cross("sma_7", "sma_30")
    sell = F.coalesce(death, F.lit(False)) | (rsi > 75) | (price < F.col("lower"))
    return F.when(usable, _side(F.coalesce(buy, F.lit(False)), sell))


STRATEGIES = {
    "sma_crossover": sma_crossover,
    "rsi_mean_reversion": rsi_mean_reversion,
    "macd_signal": macd_signal,
    "bollinger_bounce": bollinger_bounce,
    "combined": combined,
    "momentum_breakout": momentum_breakout,
    "mean_reversion_bands": mean_reversion_bands,
    "trend_rider": trend_rider,
    "steady_gainer": steady_gainer,
}


def signals(panel: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """One row per point with a column per strategy: buy, sell or null."""
    return panel.select(*POINT, *[STRATEGIES[s]().alias(s) for s in strategies])


def signal_rows(panel: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """Signals as long rows (card, strategy, point). Stays partitioned by card."""
    wide = signals(panel, strategies)
    pairs = F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("signal")) for s in strategies]))
    return wide.select(*POINT, pairs)
