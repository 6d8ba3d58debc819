"""Technical indicators per card: latest values, the full analysis, whole trajectories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thinmarket.functions import folds as K
from thinmarket.functions.numeric import pct_change
from thinmarket.operators import series as S

# Look-back in days and the tolerated gap of the calendar changes.
CHANGE_HORIZONS = {7: 7, 30: 10, 90: 15, 180: 21, 365: 30}


def prices_of(bars: Column | str) -> Column:
    return F.transform(bars, lambda b: b["price"])


def nearest_in_bars(bars: Column, days: int, gap: int) -> Column:
    """Price of the bar closest to ``days`` before the last one; the earlier bar wins ties."""
    target = F.date_sub(F.element_at(bars, -1)["date"], days)
    near = F.filter(bars, lambda b: F.abs(F.datediff(b["date"], target)) <= gap)
    ranked = F.transform(
        near, lambda b, i: F.struct(F.abs(F.datediff(b["date"], target)).alias("gap"), i.alias("pos"), b["price"].alias("price"))
    )
    return F.array_min(ranked)["price"]


def price_changes(bars: Column) -> dict[str, Column]:
    last = F.element_at(bars, -1)["price"]
    out = {f"change_{d}d": pct_change(last, nearest_in_bars(bars, d, g)) for d, g in CHANGE_HORIZONS.items()}
    out["change_all"] = F.when(F.size(bars) >= 2, pct_change(last, F.get(bars, 0)["price"]))
    return out


def range_stats(bars: Column) -> dict[str, Column]:
    p = prices_of(bars)
    last, high, low = F.element_at(p, -1), F.array_max(p), F.array_min(p)
    return {
        "all_time_high": high,
        "all_time_low": low,
        "pct_from_ath": F.when(high > 0, (last - high) / high * 100),
        "price_percentile": F.when(high > low, (last - low) / (high - low) * 100),
        "n_points": F.size(bars),
        "first_date": F.get(bars, 0)["date"],
        "last_price": last,
    }


def analyze(packed: DataFrame, *carry: str) -> DataFrame:
    """All indicators of the ``bars`` array of each row. One projection, no further shuffle."""
    bars = F.col("bars")
    step1 = packed.withColumn("p", prices_of("bars"))
    p = F.col("p")
    changes, ranges, sr = price_changes(bars), range_stats(bars), K.support_resistance(p)
    step2 = step1.select(
        "card_id", *carry, "p",
        *[K.sma(p, k).alias(f"sma_{k}") for k in (7, 30, 90, 200)],
        *[K.ema(p, k).alias(f"ema_{k}") for k in (12, 26, 50)],
        K.rsi(p).alias("rsi_14"), K.macd(p).alias("m"), K.bollinger(p).alias("b"),
        K.adx(p).alias("adx"), K.half_life(p).alias("half_life"),
        K.momentum(p).alias("momentum"), K.momentum_accel(p).alias("momentum_accel"),
        K.volatility(p).alias("volatility"), K.spread_ratio(bars).alias("spread_ratio"),
        sr.alias("sr"), K.data_confidence(F.size(p)).alias("data_confidence"),
        *[c.alias(n) for n, c in {**changes, **ranges}.items()],
    )
    step3 = step2.withColumn(
        "activity_score",
        K.activity_score(F.col("volatility"), F.col("spread_ratio"), F.col("momentum_accel"), F.col("change_7d"), F.col("n_points")),
    ).withColumn("regime", K.regime(p, F.col("adx")))
    strength = K.signal_strength(
        F.col("last_price"), F.col("rsi_14"), F.col("m.line"), F.col("m.signal"), F.col("m.histogram"),
        F.col("sma_30"), F.col("b.upper"), F.col("b.lower"), F.col("momentum"), F.col("activity_score"),
    )
    return step3.withColumn("signal_strength", strength).select(
        "card_id", *carry,
        *[f"sma_{k}" for k in (7, 30, 90, 200)], *[f"ema_{k}" for k in (12, 26, 50)], "rsi_14",
        F.col("m.line").alias("macd_line"), F.col("m.signal").alias("macd_signal"), F.col("m.histogram").alias("macd_histogram"),
        F.col("b.upper").alias("bollinger_upper"), F.col("b.middle").alias("bollinger_middle"), F.col("b.lower").alias("bollinger_lower"),
        "momentum", "momentum_accel", "volatility", "spread_ratio", "adx", "regime", "half_life", "data_confidence",
        F.col("sr.support").alias("support"), F.col("sr.resistance").alias("resistance"),
        *changes, *ranges, "activity_score", "signal_strength", K.signal_name(F.col("signal_strength")).alias("signal"),
    )


def with_activity(packed: DataFrame) -> DataFrame:
    """The ``bars`` rows with the activity score and what it is made of, a small part of the whole analysis."""
    bars, p = F.col("bars"), F.col("p")
    parts = packed.withColumn("p", prices_of("bars")).select(
        "card_id", "bars", K.volatility(p).alias("volatility"), K.spread_ratio(bars).alias("spread_ratio"), K.momentum_accel(p).alias("momentum_accel"),
        price_changes(bars)["change_7d"].alias("change_7d"), F.size(p).alias("n_points"),
    )
    score = K.activity_score(F.col("volatility"), F.col("spread_ratio"), F.col("momentum_accel"), F.col("change_7d"), F.col("n_points"))
    return parts.withColumn("activity_score", score)


def chosen_bars(bars: DataFrame, cards: DataFrame) -> DataFrame:
    """Selection, dominant variant and spike filter; one row per card with its bars."""
    chosen = S.dominant_variant(S.select_series(bars, cards))
    bar = F.struct(
        "date", "seq", "variant", "condition", F.col("market_price").alias("price"),
        F.col("low_price").alias("low"), F.col("high_price").alias("high"),
    )
    packed = chosen.groupBy("card_id").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    return packed.withColumn("bars", S.drop_spikes(F.col("bars")))


def analyze_cards(bars: DataFrame, cards: DataFrame) -> DataFrame:
    return analyze(chosen_bars(bars, cards))


_COLUMNS = ("clean", "ema_12", "ema_26", "rsi", "line", "signal", "adx")
TRAJECTORY_TYPE = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in _COLUMNS])
_CHUNK = 256


def clean_matrix(p: np.ndarray, n: np.ndarray, reach: int = 7) -> np.ndarray:
    """Replaces prices off the local upper median threefold, left to right and in place.

    Rows are series padded with NaN. Neighbours on the left are already cleaned.
    """
    c = p.copy()
    rows = np.arange(len(c))
    for i in range(c.shape[1]):
        window = np.sort(c[:, max(0, i - reach) : i + reach + 1], axis=1)
        size = np.isfinite(window).sum(axis=1)
        median = window[rows, np.minimum(size // 2, window.shape[1] - 1)]
        with np.errstate(invalid="ignore"):
            off = (median > 0) & ((c[:, i] > median * 3) | (c[:, i] < median * 0.33)) & (i < n)
        c[off, i] = median[off]
    return c


def _ema_rows(p: np.ndarray, k: int) -> np.ndarray:
    out = np.full_like(p, np.nan)
    if p.shape[1] < k:
        return out
    e = p[:, :k].mean(axis=1)
    out[:, k - 1] = e
    for i in range(k, p.shape[1]):
        e = e + (p[:, i] - e) * (2.0 / (k + 1))
        out[:, i] = e
    return out


def _macd_rows(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    line, signal = np.full_like(p, np.nan), np.full_like(p, np.nan)
    width = p.shape[1]
    if width < 27:
        return line, signal
    fast = p[:, :12].mean(axis=1)
    for i in range(13, 27):
        fast = fast + (p[:, i] - fast) * (2.0 / 13)
    slow = p[:, :26].mean(axis=1)
    line[:, 26] = fast - slow
    for i in range(27, width):
        fast = fast + (p[:, i] - fast) * (2.0 / 13)
        slow = slow + (p[:, i] - slow) * (2.0 / 27)
        line[:, i] = fast - slow
    if width >= 35:
        s = line[:, 26:35].mean(axis=1)
        signal[:, 34] = s
        for i in range(35, width):
            s = s + (line[:, i] - s) * 0.2
            signal[:, i] = s
    return line, signal


def _rsi_adx_rows(p: np.ndarray, k: int = 14) -> tuple[np.ndarray, np.ndarray]:
    rsi, adx = np.full_like(p, np.nan), np.full_like(p, np.nan)
    width = p.shape[1]
    if width < k + 1:
        return rsi, adx
    d = np.diff(p, axis=1)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    gain, loss = up[:, :k].mean(axis=1), down[:, :k].mean(axis=1)
    seen, warm = np.zeros(len(p)), np.zeros(len(p))
    trend = np.full(len(p), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi[:, k] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        for i in range(k, d.shape[1]):
            gain = (gain * (k - 1) + up[:, i]) / k
            loss = (loss * (k - 1) + down[:, i]) / k
            rsi[:, i + 1] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
            live = gain + loss > 0
            dx = np.abs(gain - loss) / (gain + loss) * 100
            seen = seen + live
            warm = np.where(live & (seen <= k), warm + dx, warm)
            trend = np.where(live & (seen == k), warm / k, np.where(live & (seen > k), (trend * (k - 1) + dx) / k, trend))
            if i + 2 >= 2 * k + 1:
                adx[:, i + 1] = trend
    return rsi, adx


def trajectory_matrix(p: np.ndarray, n: np.ndarray, clean: bool) -> dict[str, np.ndarray]:
    if clean:
        p = clean_matrix(p, n)
    line, signal = _macd_rows(p)
    rsi, adx = _rsi_adx_rows(p)
    return {
        "clean": p, "ema_12": _ema_rows(p, 12), "ema_26": _ema_rows(p, 26),
        "rsi": rsi, "line": line, "signal": signal, "adx": adx,
    }


def _back(p: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` positions before, NaN where there is none."""
    out = np.full_like(p, np.nan)
    out[:, k:] = p[:, : max(p.shape[1] - k, 0)]
    return out


def _over_last(p: np.ndarray, k: int, step) -> np.ndarray:
    """``step`` folded over the last ``k`` positions up to each one, over all where there are fewer."""
    out = p.copy()
    for j in range(1, min(k, p.shape[1])):
        out[:, j:] = step(out[:, j:], p[:, :-j])
    return out


def _mean_rows(p: np.ndarray, k: int) -> np.ndarray:
    return _over_last(p, k, np.add) / np.minimum(np.arange(p.shape[1]) + 1, k)


def _full(rows: np.ndarray, k: int) -> np.ndarray:
    """NaN until ``k`` positions are there."""
    rows[:, : k - 1] = np.nan
    return rows


def _deviation_rows(p: np.ndarray, k: int, sample: bool) -> np.ndarray:
    """Standard deviation of the last ``k`` positions in two passes; exactly 0 where all are equal."""
    mean, count = _mean_rows(p, k), np.minimum(np.arange(p.shape[1]) + 1, k)
    squares = (p - mean) ** 2
    for j in range(1, min(k, p.shape[1])):
        squares[:, j:] += (p[:, :-j] - mean[:, j:]) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        dev = np.sqrt(squares / (count - (1 if sample else 0)))
    run = np.ones(len(p))
    for i in range(p.shape[1]):
        run = np.where(p[:, i] == p[:, i - 1], run + 1, 1) if i else run
        dev[run >= max(count[i], 2), i] = 0.0
    return dev


def history_matrix(p: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """What was known at each position: recurrences, means and ranges of the last ones, earlier values."""
    line, signal = _macd_rows(p)
    rsi, adx = _rsi_adx_rows(p)
    sma = {k: _full(_mean_rows(p, k), k) for k in (7, 30, 200)}
    old = _back(sma[200], 10)
    return {
        "price": p, "rsi": rsi, "adx": adx, "line": line, "signal": signal, **{f"sma_{k}": v for k, v in sma.items()},
        "prev_sma_7": _back(sma[7], 1), "prev_sma_30": _back(sma[30], 1), "old_sma_200": np.where(np.isnan(old), sma[200], old),
        "mid20": _mean_rows(p, 20), "dev20": _deviation_rows(p, 20, sample=True), "mean_60": _mean_rows(p, 60), "std_60": _deviation_rows(p, 60, sample=False),
        "high_30": _over_last(p, 30, np.maximum), "low_30": _over_last(p, 30, np.minimum), "high_90": _over_last(p, 90, np.maximum),
        **{f"p{k + 1}": _back(p, k) for k in (6, 13, 29)},
    }


HISTORY_COLUMNS = tuple(history_matrix(np.ones((1, 1)), np.ones(1)))
HISTORY_TYPE = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in HISTORY_COLUMNS])


def _lists(prices: pa.Array, columns: tuple[str, ...], matrix) -> pa.Array:
    """Recurrences over a batch of series at once: one loop over positions, vectorised over cards.

    The lists' flat buffer is laid into a padded matrix by its offsets and read back the same way, so no
    value becomes a Python object. A null or empty list gives empty lists; null prices stay null.
    """
    parts = []
    for lo in range(0, len(prices), _CHUNK):
        part = prices.slice(lo, _CHUNK)
        n = np.asarray(pc.fill_null(pc.list_value_length(part), 0), dtype=np.int64)
        p = np.full((len(part), max(int(n.max(initial=0)), 1)), np.nan)
        there = np.arange(p.shape[1]) < n[:, None]
        p[there] = part.flatten().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        made = matrix(p, n)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(made[c][there], pa.float64(), from_pandas=True)) for c in columns]
        parts.append(pa.StructArray.from_arrays(lists, list(columns)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(c, pa.list_(pa.float64())) for c in columns]))


def trajectory_lists(prices: pa.Array, clean: bool) -> pa.Array:
    return _lists(prices, _COLUMNS, lambda p, n: trajectory_matrix(p, n, clean))


def history_lists(prices: pa.Array) -> pa.Array:
    return _lists(prices, HISTORY_COLUMNS, history_matrix)


@F.arrow_udf(TRAJECTORY_TYPE)
def _raw_trajectory(prices: pa.Array) -> pa.Array:
    return trajectory_lists(prices, clean=False)


@F.arrow_udf(TRAJECTORY_TYPE)
def _clean_trajectory(prices: pa.Array) -> pa.Array:
    return trajectory_lists(prices, clean=True)


@F.arrow_udf(HISTORY_TYPE)
def _history(prices: pa.Array) -> pa.Array:
    return history_lists(prices)


def histories(series: DataFrame, min_points: int = 1) -> DataFrame:
    """(card_id, i, n, date, next_date, mid) with ``history_matrix`` at every point; no window and no exchange after the arrays."""
    packed = S.series_arrays(series).filter(F.size("bars") >= min_points)
    t = packed.select("card_id", "bars", _history(prices_of("bars")).alias("t"))
    zipped = F.arrays_zip(
        F.transform("bars", lambda b: b["date"]).alias("date"),
        F.transform("bars", lambda b, i: F.get("bars", i + 1)["date"]).alias("next_date"),
        F.transform("bars", lambda b: b["mid"]).alias("mid"),
        *[F.col(f"t.{c}").alias(c) for c in HISTORY_COLUMNS],
    )
    return t.select("card_id", F.size("bars").alias("n"), F.posexplode(zipped).alias("pos", "r")).select(
        "card_id", (F.col("pos") + 1).alias("i"), "n", *[F.col(f"r.{c}").alias(c) for c in ("date", "next_date", "mid", *HISTORY_COLUMNS)],
    )


def trajectories(series: DataFrame, clean: bool = False, min_points: int = 1) -> DataFrame:
    """Recurrent indicators at every point: (card_id, i, n, date, price, ema, rsi, macd, adx).

    Prices cross to Python once as one array per card and come back exploded; the rows stay
    partitioned by card, so the windows that follow need no further shuffle.
    """
    packed = S.series_arrays(series).filter(F.size("bars") >= min_points)
    udf = _clean_trajectory if clean else _raw_trajectory
    t = packed.select("card_id", "bars", udf(prices_of("bars")).alias("t"))
    zipped = F.arrays_zip(
        F.transform("bars", lambda b: b["date"]).alias("date"),
        F.transform("bars", lambda b: b["mid"]).alias("mid"),
        *[F.col(f"t.{c}").alias(c) for c in _COLUMNS],
    )
    return t.select("card_id", F.size("bars").alias("n"), F.posexplode(zipped).alias("pos", "r")).select(
        "card_id", (F.col("pos") + 1).alias("i"), "n", F.col("r.date").alias("date"), F.col("r.clean").alias("price"), F.col("r.mid").alias("mid"),
        *[F.col(f"r.{c}").alias(c) for c in _COLUMNS[1:]],
    )


def clean_outliers(series: DataFrame) -> DataFrame:
    """Sequential outlier replacement against the 15-point upper median."""
    return trajectories(series, clean=True).select("card_id", "i", "date", "price")
