"""Technical indicators of one series, given as ``array<double>`` ascending by date.

Each function gives the value at the end of the series, null where the series is too short. The
recurrences run as ``aggregate`` folds, so nothing leaves the JVM and nothing is appended.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value bound once, so lambdas inside do not compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def tail(xs: Column, k: int) -> Column:
    """Last ``k`` elements, or all of a shorter array."""
    return F.slice(xs, F.greatest(F.size(xs) - k + 1, F.lit(1)), k)


def back(xs: Column, k: int) -> Column:
    """Element ``k`` from the end (1 is the last); null when out of range."""
    return F.get(xs, F.size(xs) - k)


def rest(xs: Column, start: int) -> Column:
    """Elements from the 1-based position on."""
    return F.slice(xs, start, F.greatest(F.size(xs) - start + 1, F.lit(0)))


def deltas(xs: Column) -> Column:
    later = rest(xs, 2)
    return F.transform(later, lambda x, i: x - F.get(xs, i))


def sma(xs: Column, k: int) -> Column:
    return F.when(F.size(xs) >= k, mean(tail(xs, k)))


def ema(xs: Column, k: int) -> Column:
    a = 2.0 / (k + 1)
    return F.when(
        F.size(xs) >= k,
        F.aggregate(rest(xs, k + 1), mean(F.slice(xs, 1, k)), lambda e, x: e + (x - e) * a),
    )


def wilder(xs: Column, k: int) -> Column:
    """Wilder smoothing: mean of the first ``k``, then (previous * (k - 1) + x) / k."""
    return F.aggregate(rest(xs, k + 1), mean(F.slice(xs, 1, k)), lambda e, x: (e * (k - 1) + x) / k)


def rsi(xs: Column, k: int = 14) -> Column:
    d = deltas(xs)
    gain = wilder(F.transform(d, lambda x: F.greatest(x, F.lit(0.0))), k)
    loss = wilder(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))), k)
    return F.when(F.size(xs) >= k + 1, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def macd(xs: Column) -> Column:
    """Struct of line, signal and histogram.

    The twelve-step average is seeded on p[0..11] and resumes at p[13]; the twenty-six-step one is
    seeded on p[0..25] and resumes at p[27]. The line starts at index 26.
    """
    a12, a26, a9 = 2.0 / 13, 2.0 / 27, 2.0 / 10
    e12 = F.aggregate(F.slice(xs, 14, 13), mean(F.slice(xs, 1, 12)), lambda e, x: e + (x - e) * a12)
    # Element 27 (index 26) still belongs to the short average before the joint recurrence.
    e12 = e12 + (F.get(xs, 26) - e12) * a12
    e26 = mean(F.slice(xs, 1, 26))
    start = F.struct(
        e12.alias("fast"), e26.alias("slow"), (e12 - e26).alias("line"),
        F.lit(1).alias("seen"), (e12 - e26).alias("warm"), F.lit(None).cast("double").alias("signal"),
    )

    def step(s: Column, x: Column) -> Column:
        fast = s["fast"] + (x - s["fast"]) * a12
        slow = s["slow"] + (x - s["slow"]) * a26
        line = fast - slow
        seen = s["seen"] + 1
        warm = F.when(seen <= 9, s["warm"] + line).otherwise(s["warm"])
        signal = F.when(seen == 9, warm / 9).when(seen > 9, s["signal"] + (line - s["signal"]) * a9)
        return F.struct(
            fast.alias("fast"), slow.alias("slow"), line.alias("line"),
            seen.alias("seen"), warm.alias("warm"), signal.alias("signal"),
        )

    end = F.aggregate(
        rest(xs, 28), start, step,
        lambda s: F.struct(s["line"].alias("line"), s["signal"].alias("signal"), (s["line"] - s["signal"]).alias("histogram")),
    )
    return F.when(F.size(xs) >= 27, end)


def spread(xs: Column, sample: bool) -> Column:
    """Standard deviation in two passes, as exact as the list form."""
    squares = let(mean(xs), lambda m: total(F.transform(xs, lambda x: (x - m) * (x - m))))
    return F.sqrt(squares / (F.size(xs) - (1 if sample else 0)))


def bollinger(xs: Column, k: int = 20, width: float = 2.0) -> Column:
    window = tail(xs, k)
    mid, dev = mean(window), spread(window, sample=True)
    bands = F.struct(
        (mid + width * dev).alias("upper"), mid.alias("middle"), F.greatest(F.lit(0.0), mid - width * dev).alias("lower")
    )
    return F.when(F.size(xs) >= k, bands)


def adx(xs: Column, k: int = 14) -> Column:
    """Average directional index from closing prices only."""
    d = deltas(xs)
    head = F.slice(d, 1, k)
    up = mean(F.transform(head, lambda x: F.greatest(x, F.lit(0.0))))
    down = mean(F.transform(head, lambda x: F.greatest(-x, F.lit(0.0))))
    start = F.struct(
        (up + down).alias("range"), up.alias("up"), down.alias("down"),
        F.lit(0).alias("seen"), F.lit(0.0).alias("warm"), F.lit(None).cast("double").alias("adx"),
    )

    def step(s: Column, x: Column) -> Column:
        rng = (s["range"] * (k - 1) + F.abs(x)) / k
        up = (s["up"] * (k - 1) + F.greatest(x, F.lit(0.0))) / k
        down = (s["down"] * (k - 1) + F.greatest(-x, F.lit(0.0))) / k
        live = (rng > 0) & (up + down > 0)
        dx = F.when(live, F.abs(up - down) / (up + down) * 100)
        seen = s["seen"] + F.when(live, 1).otherwise(0)
        warm = F.when(live & (seen <= k), s["warm"] + dx).otherwise(s["warm"])
        smooth = F.when(~live, s["adx"]).when(seen == k, warm / k).when(seen > k, (s["adx"] * (k - 1) + dx) / k)
        return F.struct(
            rng.alias("range"), up.alias("up"), down.alias("down"), seen.alias("seen"), warm.alias("warm"), smooth.alias("adx")
        )

    return F.when(F.size(xs) >= 2 * k + 1, F.aggregate(rest(d, k + 1), start, step, lambda s: s["adx"]))


def regime(xs: Column, adx_value: Column) -> Column:
    last, n = F.element_at(xs, -1), F.size(xs)
    short = sma(xs, 30)
    young = (
        F.when(n < 30, "unknown").when(last > short * 1.05, "markup").when(last < short * 0.95, "markdown")
        .otherwise("accumulation")
    )
    long = sma(xs, 200)
    earlier = F.when(n >= 210, mean(F.slice(xs, n - 209, 200))).otherwise(long)
    slope = F.when(earlier > 0, (long - earlier) / earlier).otherwise(0.0)
    trending = F.coalesce(adx_value > 25, F.lit(False))
    old = (
        F.when(trending, F.when(last > long, "markup").otherwise("markdown"))
        .when(slope > 0.01, "accumulation").when(slope < -0.01, "distribution").otherwise("accumulation")
    )
    return F.when(n < 200, young).otherwise(old)


def half_life(xs: Column) -> Column:
    """Mean-reversion half-life from the regression of the change on the previous value."""
    m = F.size(xs) - 1
    x, y = F.slice(xs, 1, F.greatest(m, F.lit(0))), deltas(xs)

    def moments(means: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(x.alias("x"), y.alias("y")),
            F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")),
            lambda s, p: F.struct(
                (s["xy"] + (p["x"] - means["x"]) * (p["y"] - means["y"])).alias("xy"),
                (s["xx"] + (p["x"] - means["x"]) * (p["x"] - means["x"])).alias("xx"),
            ),
        )

    sums = let(F.struct(mean(x).alias("x"), mean(y).alias("y")), moments)
    lam = F.when(sums["xx"] > 0, sums["xy"] / sums["xx"])
    return F.when((F.size(xs) >= 30) & (lam < 0), F.least(F.log(F.lit(2.0)) / -lam, F.lit(999.0)))


def data_confidence(n: Column) -> Column:
    grown = F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1000.0))
    return F.when(n > 0, F.least(F.lit(1.0), grown)).otherwise(0.0)


def volatility(xs: Column, k: int = 14) -> Column:
    window = tail(xs, k + 1)
    returns = F.filter(
        F.transform(rest(window, 2), lambda x, i: F.when(F.get(window, i) != 0, (x - F.get(window, i)) / F.get(window, i))),
        lambda r: r.isNotNull(),
    )
    return F.when((F.size(xs) >= k + 1) & (F.size(returns) > 0), spread(returns, sample=False) * 100)


def spread_ratio(bars: Column, k: int = 14) -> Column:
    """Mean of (high - low) / price over the last bars that have all three."""
    ratios = F.transform(
        F.filter(tail(bars, k), lambda b: (b["high"] != 0) & (b["low"] != 0) & (b["price"] > 0)),
        lambda b: (b["high"] - b["low"]) / b["price"],
    )
    return mean(ratios) * 100


def lag_change(xs: Column, newer: int, older: int) -> Column:
    """Change in percent between two positions counted from the end."""
    return F.when(back(xs, older) != 0, (back(xs, newer) - back(xs, older)) / back(xs, older) * 100)


def momentum(xs: Column) -> Column:
    return F.when(F.size(xs) >= 10, lag_change(xs, 1, 10))


def momentum_accel(xs: Column) -> Column:
    return F.when(F.size(xs) >= 15, lag_change(xs, 1, 5) - lag_change(xs, 5, 10))


def support_resistance(xs: Column) -> Column:
    window = F.sort_array(tail(xs, 60))
    n = F.size(window)
    support = F.get(window, F.floor(n * 0.10).cast("int"))
    resistance = F.get(window, F.least(n - 1, F.floor(n * 0.90).cast("int")))
    floor = F.round(F.get(window, F.lit(0)) * 0.90 + 1e-9, 2)
    return F.struct(
        F.when(support >= F.element_at(xs, -1), floor).otherwise(support).alias("support"), resistance.alias("resistance")
    )


def activity_score(vol: Column, spread_: Column, accel: Column, change_7d: Column, n: Column) -> Column:
    parts = ((vol, 0.5, 30), (spread_, 0.5, 20), (F.abs(accel), 0.2, 25), (F.abs(change_7d), 0.2, 25))
    score, weight = F.lit(0.0), F.lit(0.0)
    for value, scale, cap in parts:
        score = score + F.coalesce(F.least(F.lit(float(cap)), value * scale), F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), float(cap)).otherwise(0.0)
    return F.when((n >= 5) & (weight > 0), F.round(score / weight * 100 + 1e-9, 1))


def signal_strength(
    price: Column, rsi_: Column, line: Column, signal: Column, histogram: Column, sma30: Column,
    upper: Column, lower: Column, mom: Column, activity: Column,
) -> Column:
    """Weighted vote of the indicators in [-1, 1]."""
    votes = [
        (rsi_.isNotNull(), 3.0,
         F.when(rsi_ > 80, -1.0).when(rsi_ > 70, -0.7).when(rsi_ < 20, 1.0).when(rsi_ < 30, 0.7)
         .otherwise((50 - rsi_) / 50 * 0.3)),
        (histogram.isNotNull(), 2.0,
         F.when(histogram > 0, 0.5).otherwise(-0.5)
         + F.when(line.isNull() | signal.isNull(), 0.0).when(line > signal, 0.2).otherwise(-0.2)),
    ]
    off = (price - sma30) / sma30
    votes.append(
        (sma30.isNotNull() & (sma30 != 0), 2.0,
         F.when(off > 0.10, 0.6).when(off > 0, 0.3).when(off < -0.10, -0.6).otherwise(-0.3))
    )
    width = upper - lower
    place = F.when(width > 0, (price - lower) / width)
    votes.append(
        (place.isNotNull(), 1.5, F.when(place < 0.2, 0.7).when(place > 0.8, -0.7).otherwise((0.5 - place) * 0.4))
    )
    votes.append(
        (mom.isNotNull(), 1.0,
         F.when(mom > 10, 0.5).when(mom > 5, 0.3).when(mom < -10, -0.5).when(mom < -5, -0.3).otherwise(0.0))
    )
    score, weight = F.lit(0.0), F.lit(0.0)
    for there, w, vote in votes:
        score = score + F.when(there, vote * w).otherwise(0.0)
        weight = weight + F.when(there, w).otherwise(0.0)
    loud = F.coalesce(activity > 50, F.lit(False))
    boosted = score + F.when(loud & (score > 0), 0.15).when(loud & (score < 0), -0.15).otherwise(0.0)
    weight = weight + F.when(loud, 0.5).otherwise(0.0)
    return F.when(weight > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), boosted / weight))).otherwise(0.0)


def signal_name(strength: Column) -> Column:
    return (
        F.when(strength > 0.3, "buy").when(strength > 0.08, "accumulate").when(strength < -0.3, "avoid")
        .when(strength < -0.08, "reduce").otherwise("hold")
    )
