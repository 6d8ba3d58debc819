"""The trading desk: technical panel per card, seven entry rules, score, exits, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions import folds as K
from thinmarket.functions.numeric import clamp, rnd, safe_div
from thinmarket.operators import sales as A
from thinmarket.operators import series as S
from thinmarket.operators.indicators import prices_of

MIN_PRICE = 20.0
MIN_LIQUIDITY = 25
MIN_POINTS = 5
VINTAGE_MIN_PRICE = 15.0
# Sets counted as vintage, and the rarities worth holding there.
VINTAGE_SET_IDS = (
    "base1", "base2", "base3", "base4", "base5",
    "basep",
    "jungle", "fossil", "gym1", "gym2",
    "neo1", "neo2", "neo3", "neo4",
    "base6",
    "ecard1", "ecard2", "ecard3",
    "ex1", "ex2", "ex3", "ex4", "ex5", "ex6", "ex7", "ex8",
    "ex9", "ex10", "ex11", "ex12", "ex13", "ex14", "ex15", "ex16",
)
VINTAGE_RARITIES = ("Rare Holo", "Rare Secret", "Rare Holo EX", "Rare Holo Star", "Rare", "Promo")
# Name parts by popularity tier with their score, seasonal points by month.
POPULARITY = {
    95: ("Charizard", "Pikachu", "Mewtwo"),
    75: ("Mew", "Umbreon", "Rayquaza", "Gengar", "Eevee", "Lugia", "Blastoise"),
    55: (
        "Venusaur", "Gyarados", "Dragonite", "Celebi",
        "Gardevoir", "Tyranitar", "Alakazam", "Arcanine",
        "Suicune", "Mimikyu", "Snorlax", "Garchomp",
        "Giratina", "Arceus", "Sylveon", "Espeon",
    ),
}
DEFAULT_POPULARITY = 30
SEASONAL_POINTS = {1: 8, 2: 3, 9: 5, 10: 2, 7: -3, 8: -3, 11: -5, 12: -8}
# Longest and shortest holding per rule, in days.
MAX_HOLD = {
    "velocity_spike": 45,
    "accumulation_phase": 60,
    "mean_reversion_v2": 120,
    "vwap_divergence": 60,
    "oop_momentum": 180,
    "momentum_breakout": 90,
    "vintage_value_buy": 365,
}
MIN_HOLD = {
    "velocity_spike": 14,
    "accumulation_phase": 21,
    "mean_reversion_v2": 30,
    "vwap_divergence": 21,
    "oop_momentum": 30,
    "momentum_breakout": 14,
    "vintage_value_buy": 45,
}
DIP_RULES = ("mean_reversion_v2", "vwap_divergence", "vintage_value_buy")
MOMENTUM_RULES = ("velocity_spike", "accumulation_phase", "momentum_breakout")


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def technical_data(
    bars: DataFrame, cards: DataFrame, metrics: DataFrame, sales: DataFrame, sets: DataFrame, as_of: Column, vintage: Column
) -> DataFrame:
    """One wide row per priced card. ``vintage`` is a condition on the card's columns.

    Changes over 7, 14 and 30 are lags of 6, 13 and 29 observations.
    """
    live = cards.filter("current_price > 0").select(
        "card_id", "name", "set_id", "set_name", "rarity", "current_price", "is_tracked", vintage.alias("is_vintage")
    )
    chosen = S.dominant_variant(bars.filter(F.col("market_price").isNotNull()).join(live.select("card_id"), "card_id", "left_semi"))
    packed = S.series_arrays(S.dedup_by_date(chosen)).filter(F.size("bars") >= MIN_POINTS)
    p, n = F.col("p"), F.size("p")
    w60, w90 = K.tail(p, 60), K.tail(p, 90)
    last = K.back(p, 1)
    lag = {d: F.when(K.back(p, d) > 0, K.back(p, d)) for d in (7, 14, 30)}
    mid = F.element_at("bars", -1)["mid"]
    rows = (
        packed.withColumn("p", prices_of("bars"))
        .withColumn("adx", K.adx(p))
        .select(
            "card_id", n.alias("n_points"), "adx", K.regime(p, F.col("adx")).alias("regime"), K.rsi(p).alias("rsi_14"),
            K.sma(p, 7).alias("sma_7"), K.sma(p, 30).alias("sma_30"), K.bollinger(p).alias("b"),
            F.array_max(K.tail(p, 30)).alias("high_30"), F.array_min(K.tail(p, 30)).alias("low_30"),
            F.array_max(K.tail(p, 14)).alias("high_14"), F.array_max(w90).alias("high_90"), K.mean(w90).alias("mean_90"),
            K.mean(w60).alias("mean_60"), K.spread(w60, sample=True).alias("std_60"),
            F.coalesce((last - lag[7]) / lag[7], F.when(n < 7, safe_div(last - K.back(p, n), K.back(p, n))), F.lit(0.0)).alias("change_7"),
            F.coalesce(F.abs(last - lag[14]) / lag[14], F.lit(0.0)).alias("change_14"),
            F.coalesce((last - lag[30]) / lag[30], F.lit(0.0)).alias("change_30"),
            last.alias("p0"), K.back(p, 7).alias("p7"), K.back(p, 14).alias("p14"),
            F.when((mid > 0) & (last != 0), (last - mid) / mid * 100).alias("spread_pct"),
        )
    )
    v30, v90 = F.col("sales_30d") / 30.0, F.col("sales_90d") / 90.0
    scored = metrics.select("card_id", F.col("liquidity_score").alias("cached_liquidity"), "appreciation_score")
    joined = (
        live.join(rows, "card_id").join(A.sales_counts(sales, as_of), "card_id", "left").join(scored, "card_id", "left")
        .join(sets.select("set_id", "release_date"), "set_id", "left")
        .join(A.velocity_zscore(sales, live, as_of).select("card_id", "velocity", "mean_velocity", "z_score"), "card_id", "left")
        .join(A.vwap(sales, as_of).select("card_id", "vwap", F.col("n_sales").alias("vwap_sales")), "card_id", "left")
        .na.fill(0, ["sales_30d", "sales_90d"])
    )
    fresh = E.liquidity_score(F.col("sales_90d"), F.col("sales_30d"), F.col("current_price"), F.lit(None).cast("double"))
    return joined.select(
        "*", F.col("b.upper").alias("bb_upper"), F.col("b.middle").alias("bb_middle"), F.col("b.lower").alias("bb_lower"),
        v30.alias("sales_per_day"), v90.alias("velocity_90d"), F.when(v90 > 0.01, v30 / v90).otherwise(1.0).alias("acceleration"),
        F.coalesce("cached_liquidity", fresh).alias("liquidity_score"),
        F.floor(F.datediff(as_of, "release_date") / 30).alias("set_age_months"),
        rnd(F.coalesce("appreciation_score", F.lit(0.0)) * 0.6 + F.coalesce("cached_liquidity", F.lit(0)) * 0.4, 1).alias("investment_score"),
        F.month(as_of).alias("month"),
    ).drop("b", "cached_liquidity", "release_date")


def _hit(cond: Column, rule: str, strength: Column, target: Column, stop: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(rule).alias("strategy"), rnd(F.least(F.lit(1.0), strength), 3).alias("strength"),
            rnd(target).alias("target_price"), rnd(stop).alias("stop_loss"), F.lit(MAX_HOLD[rule]).alias("max_hold_days"),
        ),
    )


def velocity_spike() -> Column:
    price, z, move = F.col("current_price"), F.col("z_score"), F.abs("change_7")
    cond = (price >= MIN_PRICE) & (z >= 2.0) & (move <= 0.30) & (F.col("velocity") >= 0.3)
    fresh = F.greatest(F.lit(0.0), 1.0 - move / 0.30)
    return _hit(cond, "velocity_spike", 0.4 + F.least(F.lit(1.0), z / 4.0) * 0.4 + fresh * 0.2, price * 1.25, price * 0.88)


def accumulation_phase() -> Column:
    price, v, base = F.col("current_price"), F.col("sales_per_day"), F.col("velocity_90d")
    ratio = F.when(base > 0, v / base)
    cond = (price >= MIN_PRICE) & (base >= 0.05) & (ratio >= 1.8) & (F.col("change_14") <= 0.05) & (F.abs("change_7") <= 0.10)
    strength = F.least(F.lit(1.0), (ratio - 1.0) / 3.0) + F.when(F.col("regime") == "accumulation", 0.15).otherwise(0.0)
    return _hit(cond, "accumulation_phase", strength, price * 1.30, price * 0.88)


def z_threshold(v: Column) -> Column:
    return F.when(v > 1.0, -1.2).when(v > 0.3, -1.5).otherwise(-2.0)


def mean_reversion() -> Column:
    price, v, base, std = F.col("current_price"), F.col("sales_per_day"), F.col("velocity_90d"), F.col("std_60")
    z = F.when(std > 0, (price - F.col("mean_60")) / std)
    calm = F.col("adx").isNull() | (F.col("adx") <= 25)
    steady = (base <= 0) | (v >= base * 0.5)
    cond = (price >= MIN_PRICE) & (F.col("n_points") >= 30) & (v >= 0.1) & calm & (z < z_threshold(v)) & steady
    strength = 0.3 + F.least(F.lit(1.0), F.abs(z) / 3.0) * 0.5 + F.least(F.lit(1.0), v) * 0.2
    return _hit(cond, "mean_reversion_v2", strength, F.col("mean_60"), F.greatest(price - std, price * 0.80))


def vwap_divergence() -> Column:
    price, vwap = F.col("current_price"), F.col("vwap")
    gap = F.when(vwap > 0, (price - vwap) / vwap)
    cond = (price >= MIN_PRICE) & (F.col("vwap_sales") >= 5) & (gap <= -0.05)
    strength = F.least(F.lit(1.0), 0.4 + F.least(F.lit(1.0), F.abs(gap) / 0.20) * 0.5) + F.when(F.col("sales_per_day") > 0.5, 0.1).otherwise(0.0)
    return _hit(cond, "vwap_divergence", strength, vwap, price * 0.88)


def oop_momentum() -> Column:
    price, age, accel, regime = F.col("current_price"), F.col("set_age_months"), F.col("acceleration"), F.col("regime")
    points = (
        F.when(age >= 18, 40).when(age >= 12, 25).otherwise(10) + F.when(accel >= 2.0, 35).when(accel >= 1.5, 20).otherwise(10)
        + F.when(regime.isin("accumulation", "markup"), 15).otherwise(0)
    )
    cond = (
        (price >= MIN_PRICE) & (age >= 9) & ~F.col("is_vintage") & (F.col("sales_per_day") >= 0.3) & (regime != "markdown")
        & (accel >= 1.2) & (points >= 35)
    )
    strength = 0.3 + F.least(F.lit(1.0), points / 80.0) * 0.4 + F.least(F.lit(1.0), (accel - 1.0) / 2.0) * 0.3
    return _hit(cond, "oop_momentum", strength, price * 1.35, price * 0.85)


def momentum_breakout() -> Column:
    price, v, base, n = F.col("current_price"), F.col("sales_per_day"), F.col("velocity_90d"), F.col("n_points")
    rising = F.when(n >= 21, (F.col("p0") > F.col("p7")) & (F.col("p7") > F.col("p14"))).otherwise((n >= 14) & (F.col("p0") > F.col("p7")))
    rally = F.when(F.col("low_30") > 0, (price - F.col("low_30")) / F.col("low_30")).otherwise(0.0)
    dip = F.when(F.col("high_14") > 0, (F.col("high_14") - price) / F.col("high_14")).otherwise(0.0)
    cond = (
        (price >= MIN_PRICE) & (n >= 14) & (v >= 0.3) & F.col("regime").isin("accumulation", "markup") & rising & (rally <= 0.30)
        & ((base <= 0) | (v >= base * 0.8))
    )
    strength = 0.3 + F.least(F.lit(1.0), rally / 0.20) * 0.3 + F.least(F.lit(1.0), v / 2.0) * 0.2 + F.when(dip.between(0.05, 0.10), 0.15).otherwise(0.0)
    return _hit(cond, "momentum_breakout", strength, price * 1.30, price * 0.85)


def vintage_value() -> Column:
    price, rsi, month = F.col("current_price"), F.col("rsi_14"), F.col("month")
    drop = F.when(F.col("high_90") > 0, (F.col("high_90") - price) / F.col("high_90"))
    cond = (
        F.col("is_vintage") & (F.col("rarity").isNull() | (F.col("rarity") == "") | F.col("rarity").isin(*VINTAGE_RARITIES))
        & (price >= VINTAGE_MIN_PRICE) & (F.col("sales_per_day") >= 0.05) & (F.col("regime") != "markdown") & (F.col("n_points") >= 15)
        & (drop >= 0.15) & (rsi.isNull() | (rsi <= 45))
    )
    season = F.when(month.isin(1, 2), 0.15).when(month.isin(8, 9), 0.10).otherwise(0.0)
    strength = 0.55 + F.least(F.lit(0.35), (drop - 0.15) * 2.5) + season + F.when(rsi < 30, 0.1).otherwise(0.0)
    return _hit(cond, "vintage_value_buy", strength, F.col("mean_90"), price * 0.80)


BUY_RULES = {
    "velocity_spike": velocity_spike,
    "accumulation_phase": accumulation_phase,
    "mean_reversion_v2": mean_reversion,
    "vwap_divergence": vwap_divergence,
    "oop_momentum": oop_momentum,
    "momentum_breakout": momentum_breakout,
    "vintage_value_buy": vintage_value,
}


def popularity(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(DEFAULT_POPULARITY)
    for score in sorted(POPULARITY):
        words = F.array(*[F.lit(w.lower()) for w in POPULARITY[score]])
        out = F.when(F.exists(words, lambda w: low.contains(w)), score).otherwise(out)
    return out


def composite_buy_score(strength: Column) -> Column:
    """0 to 100 out of the panel's columns and the rule's strength."""
    accel, spread, age, price, n = F.col("acceleration"), F.col("spread_pct"), F.col("set_age_months"), F.col("current_price"), F.col("n_points")
    sold = (F.col("sales_per_day") != 0) | (F.col("sales_90d") != 0)
    velocity = F.when(sold, clamp(50 + (accel - 1.0) * 50, 0.0, 100.0)).otherwise(0.0)
    value = F.when(spread.isNull(), 30.0).otherwise(clamp(40 - spread * 2.4, 0.0, 100.0))
    sets = F.when(F.col("is_vintage"), 75).when(age >= 18, 90).when(age >= 12, 70).when(age < 3, 20).otherwise(50)
    fees = F.when(price >= 200, 100).when(price >= 100, 85).when(price >= 50, 65).when(price >= 30, 40).when(price >= 20, 20).otherwise(0)
    score = (
        velocity * 0.25 + value * 0.20 + strength * 100 * 0.15 + sets * 0.10 + popularity(F.col("name")) * 0.10
        + F.least(F.lit(100.0), F.col("liquidity_score") * 1.25) * 0.10 + fees * 0.10 + lookup(SEASONAL_POINTS, F.col("month"), 0)
    )
    score = score * F.when(n < 10, 0.7).when(n < 20, 0.85).when(n < 30, 0.95).otherwise(1.0)
    score = score * lookup({"markdown": 0.5, "distribution": 0.7, "accumulation": 1.1}, F.col("regime"), 1.0)
    return rnd(clamp(score, 0.0, 100.0), 1)


def rule_hits(panel: DataFrame, rules: tuple[str, ...] = tuple(BUY_RULES)) -> DataFrame:
    """One row per card and rule that fires, with the composite score."""
    hits = panel.withColumn("h", F.explode(F.array_compact(F.array(*[BUY_RULES[r]() for r in rules]))))
    return hits.select("*", "h.*").drop("h").withColumn("composite_score", composite_buy_score(F.col("strength")))


def scan_signals(panel: DataFrame) -> DataFrame:
    """All rules over the tracked, liquid cards that are dear enough (vintage from a lower floor)."""
    price, old = F.col("current_price"), F.col("is_vintage")
    eligible = panel.filter(
        F.col("is_tracked") & ((price >= MIN_PRICE) | (old & (price >= VINTAGE_MIN_PRICE))) & ((F.col("liquidity_score") >= MIN_LIQUIDITY) | old)
    )
    return rule_hits(eligible).select(
        "card_id", "name", "set_id", "set_name", "strategy", "strength", F.col("current_price").alias("entry_price"), "target_price", "stop_loss",
        "max_hold_days", "composite_score", "liquidity_score", "sales_per_day", "regime", "acceleration", "is_vintage",
    )


def signal_summary(scan: DataFrame, metrics: DataFrame) -> DataFrame:
    """Counts by rule and by regime as (section, key, value).

    The scan is run once: its total is the sum of the counts by rule, of which there are a handful.
    """
    def line(section: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))

    per_rule = scan.groupBy("strategy").agg(F.count("*").alias("value"))
    lines = per_rule.agg(
        F.collect_list(line("strategy", F.col("strategy"), F.col("value"))).alias("rules"), F.coalesce(F.sum("value"), F.lit(0)).alias("all")
    )
    counted = lines.select(F.inline(F.concat("rules", F.array(line("total", F.lit("signals"), F.col("all"))))))
    regimes = metrics.filter("regime IS NOT NULL").groupBy(F.col("regime").alias("key")).agg(F.count("*").alias("value"))
    return counted.unionByName(regimes.select(F.lit("regime").alias("section"), "key", "value"))


def top_signals(scan: DataFrame, limit: int = 20) -> DataFrame:
    """The signals with the highest composite score, then by card and rule. A top-k, nothing is ranked as a whole."""
    return scan.orderBy(F.desc(rnd(F.col("composite_score"), 6)), "card_id", "strategy").limit(limit)


def exit_signals(positions: DataFrame, panel: DataFrame, as_of: Column) -> DataFrame:
    """First exit rule that holds for each open position.

    ``positions`` has portfolio_id, card_id, entry_price, entry_date, strategy and, where known,
    stop_loss and take_profit.
    """
    rows = positions.filter("entry_price > 0").join(panel.drop("strategy"), "card_id")
    price, entry, rule, old = F.col("current_price"), F.col("entry_price"), F.col("strategy"), F.col("is_vintage")
    rows = rows.withColumn("gain", (price - entry) / entry).withColumn("days_held", F.datediff(as_of, F.to_date("entry_date")))
    gain, held, v = F.col("gain"), F.col("days_held"), F.col("sales_per_day")
    accel = F.when(F.col("velocity_90d") < 0.01, 1.0).otherwise(v / F.col("velocity_90d"))
    young = held < lookup(MIN_HOLD, rule, 14)
    stop_pct = F.when(old, 0.25).otherwise(0.20)
    stopped = F.coalesce(price <= F.col("stop_loss"), F.lit(False)) | (price <= entry * (1 - stop_pct))
    target = F.coalesce((F.col("take_profit") - entry) / entry, F.when(old, 0.50).otherwise(0.40))
    longest = F.when(old & (rule != "vintage_value_buy"), 365).otherwise(lookup(MAX_HOLD, rule, 180))
    stale_gain = F.when(old, 0.08).otherwise(0.10)
    rules = (
        ("catastrophic_stop", 1.0, price <= entry * (1 - F.when(old, 0.35).otherwise(0.30))),
        ("liquidity_death", 0.95, (v < F.when(old, 0.03).otherwise(0.05)) & (held > F.when(old, 60).otherwise(30))),
        ("stop_loss", 0.85, young & stopped),
        (None, 0.0, young),
        ("take_profit", 0.85, (gain >= target) & (accel <= 1.5)),
        ("trailing_stop", 0.9, (gain > 0.20) & (price < F.col("high_30") * 0.92)),
        ("stop_loss", 0.85, stopped),
        ("regime_breakdown", 0.75, ~rule.isin(*DIP_RULES) & F.col("regime").isin("distribution", "markdown") & (gain > 0)),
        ("velocity_fade", 0.8, rule.isin(*MOMENTUM_RULES) & (accel < 0.5) & (held > 14)),
        ("stale_position", 0.6, (held > longest) & (gain < stale_gain)),
        ("seasonal_sell", 0.6, F.month(as_of).isin(11, 12) & (gain > 0.15) & (held > 30) & (~old | (gain > 0.30))),
    )
    chain = None
    for name, strength, cond in rules:
        hit = F.struct(F.lit(name).alias("exit_rule"), F.lit(strength).alias("strength"))
        chain = F.when(cond, hit) if chain is None else chain.when(cond, hit)
    return rows.withColumn("x", chain).filter("x.exit_rule IS NOT NULL").select(
        "portfolio_id", "card_id", "strategy", "x.exit_rule", "x.strength", rnd(gain * 100).alias("pnl_pct"), "days_held"
    )


def buy_candidates(
    scan: DataFrame, universe: DataFrame, positions: DataFrame, trades: DataFrame, as_of: Column, min_score: float = 55.0
) -> DataFrame:
    """Signals worth buying per portfolio: not held, not cooling down, not a repeated loser.

    ``universe`` lists the (portfolio_id, card_id) pairs a portfolio may trade.
    """
    keys = ["portfolio_id", "card_id"]
    sells = trades.filter("side = 'sell'")
    lost = sells.filter("realized_pnl < 0")
    day = F.to_date("executed_at")
    recent_loss = lost.filter(day >= F.date_sub(as_of, 60)).select(*keys)
    recent_sell = sells.filter(day >= F.date_sub(as_of, 14)).select(*keys)
    losers = lost.groupBy(*keys).agg(F.count("*").alias("c")).filter("c >= 2").select(*keys)
    asked = universe.select(*keys).distinct()
    for blocked in (positions.select(*keys), recent_loss, recent_sell, losers):
        asked = asked.join(blocked, keys, "left_anti")
    return asked.join(scan.filter(F.col("composite_score") >= min_score), "card_id")


def position_size(value: Column, cash: Column, price: Column, score: Column, velocity: Column, vintage: Column, drawdown: Column, held: Column) -> Column:
    """Copies to buy: dampened Kelly share under liquidity, position, cash and drawdown limits."""
    win, gain, loss, dampener = 0.55, 0.15, 0.12, 0.33
    edge = (win * gain - (1 - win) * loss) / gain * dampener
    conviction = F.greatest(F.lit(0.0), score - 50) / 50
    share = clamp(edge * (0.3 + conviction * 0.7), 0.02, 0.10) * F.when(held > 10, 0.5).when(held > 7, 0.7).otherwise(1.0)
    liquid = F.least(F.lit(0.10), 0.02 + F.log(velocity + 1) * 0.05)
    hard = F.when(vintage, 0.15).otherwise(0.08)
    spare = F.greatest(F.lit(0.0), cash - value * 0.25)
    dollars = F.least(value * share, value * liquid, value * hard, spare) * F.when(drawdown >= 0.07, 0.5).otherwise(1.0)
    cap = F.when(vintage & (price > 50), 1).when(price > 100, 1).when(price > 50, 2).when(price > 20, 3).otherwise(4)
    copies = F.least(F.floor(dollars / price), cap.cast("long"))
    usable = (price > 0) & (value > 0) & (cash > 0) & (drawdown < 0.10) & (dollars >= price)
    return F.when(usable, copies).otherwise(0).cast("int")
