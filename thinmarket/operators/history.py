"""Point-in-time panels and the historic forms of the desk's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions.numeric import clamp, rnd
from thinmarket.operators import indicators as I
from thinmarket.operators import series as S
from thinmarket.operators.ranking import banded_rank
from thinmarket.operators.desk import DIP_RULES, MIN_HOLD, MIN_POINTS, VINTAGE_RARITIES, lookup, z_threshold


def trajectory_panel(series: DataFrame) -> DataFrame:
    """Every observation with what was known on its day. Mid prices ride along by position."""
    i, p = F.col("i"), F.col("price")

    def change(then: str) -> Column:
        past = F.when(F.col(then) > 0, F.col(then))
        return (p - past) / past

    rows = (
        I.histories(series, min_points=MIN_POINTS)
        .withColumn("change_7", change("p7")).withColumn("change_14", F.abs(change("p14"))).withColumn("change_30", change("p30"))
    )
    slope = (F.col("sma_200") - F.col("old_sma_200")) / F.col("old_sma_200")
    young = (
        F.when(i < 30, "unknown").when(p > F.col("sma_30") * 1.05, "markup").when(p < F.col("sma_30") * 0.95, "markdown").otherwise("accumulation")
    )
    old = (
        F.when(F.coalesce(F.col("adx") > 25, F.lit(False)), F.when(p > F.col("sma_200"), "markup").otherwise("markdown"))
        .when(slope < -0.01, "distribution").otherwise("accumulation")
    )
    full = i >= 20
    return rows.select(
        "card_id", "i", "date", "next_date", p.alias("current_price"), i.alias("n_points"), F.when(i < 200, young).otherwise(old).alias("regime"),
        F.col("rsi").alias("rsi_14"), "adx", F.col("line").alias("macd_line"), F.col("signal").alias("macd_signal"),
        "sma_7", "sma_30", "prev_sma_7", "prev_sma_30", F.when(full, F.col("mid20") + 2 * F.col("dev20")).alias("bb_upper"), F.when(full, F.col("mid20")).alias("bb_middle"),
        F.when(full, F.greatest(F.lit(0.0), F.col("mid20") - 2 * F.col("dev20"))).alias("bb_lower"),
        "high_30", "low_30", "high_90", "mean_60", "std_60", "p7", "p14", "change_7", "change_14", "change_30",
        F.when(F.col("mid") > 0, F.abs(p - F.col("mid")) / F.col("mid") * 100).alias("spread_pct"),
        (F.col("change_30") / 30.0 * 100).alias("appreciation_slope"),
    )


def monthly_velocity(sales: DataFrame) -> DataFrame:
    """Per card and month: sales of that month and of the two before, in one aggregation."""
    month = F.trunc("order_date", "month")
    counts = sales.groupBy("card_id", month.alias("m")).agg(F.count("*").alias("c"))
    spread = counts.select("card_id", "c", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.add_months("m", k))).alias("k", "month"))
    return spread.groupBy("card_id", "month").agg(*[F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"m{k}") for k in range(3)])


def pit_panel(
    bars: DataFrame, cards: DataFrame, sales: DataFrame, sets: DataFrame, start: Column, end: Column, step_days: int, vintage: Column,
    strict_pit: bool = False,
) -> DataFrame:
    """Every step date and card with only what was known then.

    An observation is in force until the next one, so each emits the step dates of its own span:
    the backward as-of lookup needs no join. Monthly sales count the whole current month unless
    ``strict_pit`` cuts it at the step date.
    """
    live = cards.filter("is_tracked AND current_price > 0").select("card_id", "name", "set_id", "rarity", vintage.alias("is_vintage"))
    chosen = S.dominant_variant(bars.filter(F.col("market_price").isNotNull()).join(live.select("card_id"), "card_id", "left_semi"))
    panel = trajectory_panel(S.dedup_by_date(chosen)).filter(F.col("n_points") >= MIN_POINTS)
    first = F.greatest(F.lit(0), F.ceil(F.datediff("date", start) / step_days)).cast("int")
    last_day = F.coalesce(F.least(F.date_sub("next_date", 1), end), end)
    last = F.floor(F.datediff(last_day, start) / step_days).cast("int")
    steps = panel.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn(
        "k", F.explode(F.sequence("first", "last"))
    ).withColumn("sim_date", F.date_add(start, F.col("k") * step_days))
    if strict_pit:
        day = sales.groupBy("card_id", F.to_date("order_date").alias("d")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("card_id", F.trunc("d", "month")).orderBy("d")
        upto = S.asof_price(
            steps.select("card_id", "sim_date").distinct(),
            day.select("card_id", F.col("d").alias("date"), F.sum("c").over(w).cast("double").alias("price")), ["card_id"], "sim_date",
        )
        in_month = F.trunc("asof_date", "month") == F.trunc("sim_date", "month")
        cut = upto.select("card_id", "sim_date", F.when(in_month, F.col("asof_price")).otherwise(0.0).cast("long").alias("cut"))
        steps = steps.join(cut, ["card_id", "sim_date"], "left")
    velocity = monthly_velocity(sales).withColumnRenamed("month", "sim_month")
    rows = (
        steps.drop("first", "last", "k", "i").withColumn("sim_month", F.trunc("sim_date", "month"))
        .join(velocity, ["card_id", "sim_month"], "left").na.fill(0, ["m0", "m1", "m2"])
        .join(live, "card_id").join(sets.select("set_id", "release_date"), "set_id", "left")
    )
    if strict_pit:
        rows = rows.withColumn("m0", F.coalesce("cut", F.lit(0))).drop("cut")
    v, v90 = (F.col("m0") + F.col("m1")) / 60.0, (F.col("m0") + F.col("m1") + F.col("m2")) / 90.0
    liquidity = E.liquidity_score(F.col("m0") + F.col("m1") + F.col("m2"), F.col("m0"), F.col("current_price"), F.lit(None).cast("double"))
    app = F.when(F.col("appreciation_slope") > 0, F.least(F.lit(100.0), F.col("appreciation_slope") * 200)).otherwise(0.0)
    return (
        rows.withColumn("sales_per_day", v).withColumn("velocity_90d", v90)
        .withColumn("acceleration", F.when(v90 > 0.01, v / v90).otherwise(1.0))
        .withColumn("sales_30d", F.floor(v * 30)).withColumn("liquidity_score", liquidity)
        .withColumn("set_age_months", F.greatest(F.lit(0.0), F.datediff("sim_date", "release_date") / 30.44))
        .withColumn("investment_score", app * 0.6 + F.least(F.lit(100), liquidity) * 0.4)
        .drop("sim_month", "m0", "m1", "m2", "release_date", "next_date", "date")
    )


def _hit(cond: Column, rule: str, strength: Column, target: Column, stop: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(rule).alias("strategy"), rnd(F.least(F.lit(1.0), strength), 3).alias("strength"),
            rnd(target).alias("target_price"), rnd(stop).alias("stop_loss"),
        ),
    )


def _calm(change: str, limit: float, strict: bool) -> Column:
    c = F.col(change)
    return c.isNull() | ((F.abs(c) < limit) if strict else (F.abs(c) <= limit))


def velocity_spike() -> Column:
    price, accel = F.col("current_price"), F.col("acceleration")
    base = F.least(F.lit(1.0), 0.4 + (accel - 1.0) * 2.0 * 0.15) + F.when(F.col("n_points") > 30, 0.1).otherwise(0.0)
    cond = (accel >= 2.0) & _calm("change_7", 0.30, False) & (F.col("sales_per_day") >= 0.3)
    return _hit(cond, "velocity_spike", base, price * 1.30, price * 0.85)


def accumulation_phase() -> Column:
    price, v90 = F.col("current_price"), F.col("velocity_90d")
    ratio = F.when(v90 > 0, F.col("sales_per_day") / v90)
    cond = (v90 > 0.05) & (ratio >= 1.8) & _calm("change_14", 0.05, True) & _calm("change_7", 0.10, True)
    return _hit(cond, "accumulation_phase", 0.4 + (ratio - 1.8) * 0.15, price * 1.25, price * 0.85)


def mean_reversion() -> Column:
    price, v, v90 = F.col("current_price"), F.col("sales_per_day"), F.col("velocity_90d")
    z = F.when(F.col("std_60") > 0, (price - F.col("mean_60")) / F.col("std_60"))
    cond = (
        (F.col("n_points") >= 30) & (v >= 0.1) & (F.col("adx").isNull() | (F.col("adx") < 25)) & (z < z_threshold(v)) & ((v90 <= 0) | (v >= v90 * 0.5))
    )
    return _hit(cond, "mean_reversion_v2", 0.4 + F.abs(z - z_threshold(v)) * 0.2, F.col("mean_60"), price * 0.85)


def vwap_divergence() -> Column:
    price, spread = F.col("current_price"), F.col("spread_pct")
    return _hit((F.col("sales_30d") >= 5) & (spread > 5.0), "vwap_divergence", 0.4 + spread / 100.0 * 3.0, price * 1.20, price * 0.88)


def oop_momentum() -> Column:
    price, age, accel, regime = F.col("current_price"), F.col("set_age_months"), F.col("acceleration"), F.col("regime")
    points = (
        F.when(age >= 36, 40).when(age >= 18, 25).otherwise(15) + F.least(F.lit(30), F.floor((accel - 1.0) * 20 + 1e-9))
        + lookup({"markup": 30, "accumulation": 20, "unknown": 10, "distribution": 0}, regime, 10)
    )
    cond = (age >= 9) & ~F.col("is_vintage") & (F.col("sales_per_day") >= 0.3) & (regime != "markdown") & (accel >= 1.2) & (points >= 35)
    return _hit(cond, "oop_momentum", 0.3 + points / 100.0, price * 1.35, price * 0.85)


def momentum_breakout() -> Column:
    price, v, v90, p7, p14, low = F.col("current_price"), F.col("sales_per_day"), F.col("velocity_90d"), F.col("p7"), F.col("p14"), F.col("low_30")
    rally = F.when(low > 0, (price - low) / low)
    cond = (
        (F.col("n_points") >= 21) & (p14 > 0) & (p7 > p14) & (price > p7) & (rally < 0.30) & (v >= 0.3)
        & F.col("regime").isin("accumulation", "markup") & ((v90 <= 0) | (v >= v90 * 0.5))
    )
    return _hit(cond, "momentum_breakout", 0.4 + ((p7 - p14) / p14 + (price - p7) / p7) * 2.0, price * 1.30, price * 0.88)


def vintage_value() -> Column:
    price, rsi, high = F.col("current_price"), F.col("rsi_14"), F.col("high_90")
    drop = F.when(high > 0, (high - price) / high)
    cond = (
        F.col("is_vintage") & F.col("rarity").isin(*VINTAGE_RARITIES) & (price >= 15) & (F.col("sales_per_day") >= 0.05)
        & (F.col("regime") != "markdown") & (drop >= 0.15) & (rsi.isNull() | (rsi < 45))
    )
    strength = 0.35 + F.least(F.lit(1.0), drop / 0.40) * 0.4 + F.coalesce((45 - F.when(rsi == 0, 30).otherwise(rsi)) / 45, F.lit(0.3)) * 0.25
    return _hit(cond, "vintage_value_buy", strength, price + (high - price) * 0.6, price * 0.80)


def sma_golden_cross() -> Column:
    price, fast, slow = F.col("current_price"), F.col("sma_7"), F.col("sma_30")
    cond = (F.col("prev_sma_7") <= F.col("prev_sma_30")) & (fast > slow) & F.col("regime").isin("accumulation", "markup")
    strength = F.least(F.lit(1.0), 0.5 + (fast - slow) / slow * 5) + F.when(F.col("regime") == "markup", 0.15).otherwise(0.0)
    return _hit(cond, "sma_golden_cross", strength, price * 1.40, price * 0.80)


def rsi_oversold() -> Column:
    price, rsi = F.col("current_price"), F.col("rsi_14")
    width = F.col("bb_upper") - F.col("bb_lower")
    place = F.when(width > 0, (price - F.col("bb_lower")) / width)
    cond = (rsi < 30) & (F.col("liquidity_score") >= 15) & (place <= 0.25)
    return _hit(cond, "rsi_oversold_bounce", 0.4 + (30 - rsi) / 30 * 0.4 + (1 - place / 0.25) * 0.2, F.col("bb_middle"), price * 0.90)


def spread_compression() -> Column:
    price, spread, v = F.col("current_price"), F.col("spread_pct"), F.col("sales_per_day")
    target = F.greatest(E.breakeven(price) / 100 + 0.10, F.lit(0.40))
    strength = 0.3 + F.greatest(F.lit(0.0), (15 - spread) / 15) * 0.4 + F.least(F.lit(1.0), v / 2.0) * 0.3
    return _hit((spread < 15) & (v >= 0.5), "spread_compression", strength, price * (1 + target), price * 0.80)


HISTORIC_RULES = {
    "velocity_spike": velocity_spike,
    "accumulation_phase": accumulation_phase,
    "mean_reversion_v2": mean_reversion,
    "vwap_divergence": vwap_divergence,
    "oop_momentum": oop_momentum,
    "momentum_breakout": momentum_breakout,
    "vintage_value_buy": vintage_value,
}
LEGACY_RULES = {
    "sma_golden_cross": sma_golden_cross,
    "rsi_oversold_bounce": rsi_oversold,
    "spread_compression": spread_compression,
}


def historic_score(strength: Column, target: Column) -> Column:
    spread, price = F.col("spread_pct"), F.col("current_price")
    spread_part = F.when(spread.isNull(), 0.075).otherwise(clamp((30 - spread) / 25, 0.0, 1.0) * 0.15)
    regime = lookup({"markup": 1.0, "accumulation": 0.7, "unknown": 0.4, "distribution": 0.15, "markdown": 0.0}, F.col("regime"), 0.4)
    upside = F.when(target > 0, (target - price) / price * 100).otherwise(0.0)
    hurdle = E.breakeven(price)
    fees = F.when(upside > hurdle * 1.5, 0.10).when(upside > hurdle, 0.05).otherwise(0.0)
    return rnd(F.least(F.lit(1.0), strength * 0.40 + F.col("liquidity_score") / 100 * 0.25 + spread_part + regime * 0.10 + fees), 3)


def rule_hits(panel: DataFrame, rules: dict) -> DataFrame:
    hits = panel.withColumn("h", F.explode(F.array_compact(F.array(*[r() for r in rules.values()]))))
    out = hits.select("*", "h.*").drop("h")
    return out.withColumn("score", historic_score(F.col("strength"), F.col("target_price")))


def pit_signals(panel: DataFrame, min_price: float = 20.0, min_liquidity: int = 25, rules: dict | None = None) -> DataFrame:
    """Signals of every step date, ranked by score within the date."""
    fit = panel.filter(
        (F.col("current_price") >= min_price) & ((F.col("sales_per_day") >= 0.01) | F.col("is_vintage")) & (F.col("liquidity_score") >= min_liquidity)
    )
    hits = rule_hits(fit, rules or HISTORIC_RULES)
    order = [F.desc("score"), F.asc("card_id"), F.asc("strategy")]
    return banded_rank(hits, ["sim_date"], F.floor(F.col("score") * 1000 + 0.5), order).select(
        "sim_date", "card_id", "strategy", "strength", "target_price", "stop_loss", "score", "rank"
    )


def peak_since(positions: DataFrame, series: DataFrame, as_of: Column) -> DataFrame:
    """Highest price of the card from the entry day on, per (card, entry day).

    The running maximum from each day to the end is looked up at the first day not before entry.
    """
    w = Window.partitionBy("card_id").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    tops = series.filter(F.col("date") <= as_of).select("card_id", "date", F.max("price").over(w).alias("price"))
    days = positions.select("card_id", F.to_date("entry_date").alias("entry_day")).distinct()
    return S._bracket(days, tops, ["card_id"], "entry_day").select("card_id", "entry_day", F.col("next.price").alias("peak"))


def held_at_steps(positions: DataFrame, panel: DataFrame, series: DataFrame, start: Column, step: int) -> DataFrame:
    """Every position at each step of the panel from its entry on, with ``peak``, the highest price from entry to step.

    Bars are reduced to the highest price of each card between two steps. The part of the interval
    that follows an entry is looked up by (card, interval); the intervals after it are a slice of the card's
    highest prices by step. A card's steps are one row, bounded by the calendar, and meet its positions once:
    what a position yields a step is neither shuffled nor sorted.
    """
    of_day = lambda day: F.ceil(F.datediff(day, start) / step).cast("int")  # noqa: E731  number of the first step that sees the day
    bars = series.select("card_id", F.col("date").alias("bar_day"), of_day(F.col("date")).alias("k"), F.col("price").alias("bar_price"))
    between = bars.groupBy("card_id", "k").agg(F.max("bar_price").alias("top"))
    by_k = between.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "top"))).alias("by_k"), F.max("k").alias("last_k"))
    tops = by_k.select("card_id", F.transform(F.sequence(F.lit(0), "last_k"), lambda k: F.try_element_at("by_k", k)).alias("tops"))
    at_step = panel.drop("strategy")
    steps = at_step.groupBy("card_id").agg(F.collect_list(F.struct(*[c for c in at_step.columns if c != "card_id"])).alias("steps"))

    entered = positions.withColumn("entry_day", F.to_date("entry_date")).withColumn("first_k", of_day(F.col("entry_day")))
    lots = entered.select("card_id", "entry_day", F.col("first_k").alias("k")).distinct()
    first = lots.join(bars, ["card_id", "k"]).filter("bar_day >= entry_day").groupBy("card_id", "entry_day").agg(F.max("bar_price").alias("first_top"))
    shown = (
        entered.join(first, ["card_id", "entry_day"], "left").join(steps.join(tops, "card_id", "left"), "card_id")
        .select(*entered.columns, "first_top", "tops", F.explode("steps").alias("seen")).filter("seen.sim_date >= entry_day")
    )
    k = F.floor(F.datediff("seen.sim_date", start) / step).cast("int")
    # Intervals first_k + 1 to k; an entry before the panel's start is in none, so all from 0 on count.
    after = F.slice("tops", F.greatest(F.col("first_k") + 2, F.lit(1)), F.greatest(k - F.greatest("first_k", F.lit(-1)), F.lit(0)))
    return shown.select(*[c for c in entered.columns if c != "first_k"], F.greatest("first_top", F.array_max(after)).alias("peak"), "seen.*")


#: What the exit rules ask of a step.
EXIT_COLUMNS = ("sim_date", "current_price", "sma_7", "sma_30", "prev_sma_7", "prev_sma_30", "rsi_14", "bb_upper", "bb_lower", "regime", "sales_per_day")


def historic_exits(positions: DataFrame, panel: DataFrame, series: DataFrame, start: Column, step: int) -> DataFrame:
    """All exit reasons per open position and step from its entry on; before the minimum hold only the stop counts."""
    sim_date = F.col("sim_date")
    rows = (
        held_at_steps(positions, panel.select("card_id", *EXIT_COLUMNS), series, start, step)
        .withColumn("gain", F.when(F.col("entry_price") > 0, (F.col("current_price") - F.col("entry_price")) / F.col("entry_price")).otherwise(0.0))
        .withColumn("days_held", F.datediff(sim_date, F.col("entry_day")))
    )
    price, entry, gain, held, rule = F.col("current_price"), F.col("entry_price"), F.col("gain"), F.col("days_held"), F.col("strategy")
    ripe = held >= lookup(MIN_HOLD, rule, 14)
    peak = F.greatest(price, F.coalesce("peak", price))
    width = F.col("bb_upper") - F.col("bb_lower")
    patient = rule.isin("mean_reversion_v2", "vintage_value_buy")
    old = rule == "vintage_value_buy"
    checks = (
        ("stop_loss", 1.0, price <= F.coalesce("stop_loss", entry * 0.80)),
        ("take_profit", 0.9, ripe & (price >= F.coalesce("take_profit", entry * 1.40))),
        ("trailing_stop", 0.85, ripe & (gain >= 0.20) & (price <= peak * 0.92) & (peak > entry)),
        ("death_cross", 0.7, ripe & ~patient & (F.col("prev_sma_7") >= F.col("prev_sma_30")) & (F.col("sma_7") < F.col("sma_30"))),
        ("overbought", 0.75, ripe & (F.col("rsi_14") > 70) & (width > 0) & ((price - F.col("bb_lower")) / F.when(width > 0, width) > 0.80)),
        ("bearish_regime", 0.6, ripe & ~rule.isin(*DIP_RULES) & F.col("regime").isin("distribution", "markdown")),
        ("liquidity_dry", 0.5, ripe & (F.col("sales_per_day") < 0.05)),
        ("stale", 0.45, ripe & (held > F.when(old, 365).otherwise(180)) & (gain < F.when(old, 0.05).otherwise(0.10))),
        ("seasonal", 0.55, ripe & F.month(sim_date).isin(11, 12) & (gain > 0.05)),
    )
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("strength"), F.lit(n).alias("reason"))) for n, s, c in checks]))
    return rows.withColumn("hits", hits).filter(F.size("hits") > 0).select(
        "sim_date", "portfolio_id", "card_id", "strategy", F.array_join(F.transform("hits", lambda h: h["reason"]), ",").alias("reasons"),
        F.array_max(F.transform("hits", lambda h: h["strength"])).alias("strength"), rnd(gain * 100).alias("pnl_pct"), "days_held",
    )
