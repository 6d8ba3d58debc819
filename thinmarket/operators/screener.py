"""Appreciation metrics and the investment screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions import folds as K
from thinmarket.functions.numeric import clamp, rnd
from thinmarket.operators import series as S
from thinmarket.operators.panel import with_sales
from thinmarket.sources.sinks import read_or_empty

# Collectibility by rarity, 0 to 100.
RARITY_SCORES = {
    "Special Illustration Rare": 95,
    "Hyper Rare": 90,
    "Illustration Rare": 80,
    "Secret Rare": 75,
    "Double Rare": 65,
    "Ultra Rare": 60,
    "Rare Holo VMAX": 58,
    "Rare Holo VSTAR": 56,
    "Rare Holo V": 50,
    "Rare BREAK": 45,
    "Rare Holo GX": 48,
    "Rare Holo EX": 48,
    "Rare Ultra": 55,
    "Rare Holo": 35,
    "Rare": 20,
    "ACE SPEC Rare": 70,
    "Amazing Rare": 65,
    "Shiny Rare": 70,
    "Shiny Ultra Rare": 80,
    "Rare Shiny": 60,
    "Rare Shiny GX": 70,
    "Rare Rainbow": 75,
    "Trainer Gallery Rare Holo": 55,
    "LEGEND": 85,
    "Radiant Rare": 60,
}
DEFAULT_RARITY_SCORE = 10
# Name words with universal, strong and niche demand, and their bonus.
DEMAND_WORDS = {
    20: ("Charizard", "Pikachu", "Mewtwo", "Mew"),
    12: (
        "Umbreon", "Rayquaza", "Lugia", "Gengar", "Eevee", "Blastoise",
        "Venusaur", "Dragonite", "Espeon", "Sylveon",
    ),
    6: (
        "Gyarados", "Alakazam", "Gardevoir", "Arceus", "Giratina", "Palkia",
        "Dialga", "Ho-Oh", "Suicune", "Celebi", "Articuno", "Zapdos",
        "Moltres", "Garchomp", "Tyranitar", "Snorlax", "Jolteon", "Flareon",
        "Vaporeon", "Salamence",
    ),
}
SORTABLE = (
    "liquidity_score", "appreciation_score", "appreciation_slope", "appreciation_consistency", "current_price", "name",
)


def steady_appreciation(series: DataFrame, min_points: int = 30) -> DataFrame:
    """Trend of ln price on days: daily slope in percent, fit, share of rising steps, score."""
    w = Window.partitionBy("card_id").orderBy("date")
    first = F.min(F.when(F.col("price") > 0, F.col("date"))).over(Window.partitionBy("card_id"))
    rows = (
        series.withColumn("prev", F.lag("price").over(w))
        .withColumn("x", F.datediff("date", first).cast("double"))
        .withColumn("y", F.when(F.col("price") > 0, F.log("price")))
    )
    step = (F.col("price") > 0) & (F.col("prev") > 0)
    fitted = rows.groupBy("card_id").agg(
        F.count("y").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_r2("y", "x").alias("r2"),
        F.count_if(step).alias("steps"),
        F.count_if(step & (F.col("price") > F.col("prev"))).alias("wins"),
    )
    usable = (F.col("n") >= min_points) & F.col("slope").isNotNull()
    slope = F.when(usable, (F.exp("slope") - 1) * 100)
    r2 = F.when(usable, clamp(F.coalesce("r2", F.lit(0.0)), 0.0, 1.0))
    win = F.when(usable, F.when(F.col("steps") > 0, F.col("wins") / F.col("steps") * 100).otherwise(0.0))
    return fitted.select("card_id", slope.alias("s"), r2.alias("r"), win.alias("w")).select(
        "card_id", rnd(F.col("s"), 4).alias("appreciation_slope"), rnd(F.col("r"), 4).alias("appreciation_consistency"),
        rnd(F.col("w"), 1).alias("appreciation_win_rate"),
        F.when(F.col("s").isNotNull(), E.appreciation_score(F.col("r"), F.col("s"), F.col("w"))).alias("appreciation_score"),
    )


def metric_series(bars: DataFrame, cards: DataFrame) -> DataFrame:
    """Bars of the card's variant, all conditions, last record per date."""
    kept = (
        bars.join(cards.select("card_id", "price_variant"), "card_id")
        .filter(F.col("price_variant").isNull() | (F.col("variant") == F.col("price_variant")))
    )
    return S.dedup_by_date(kept)


def _live(cards: DataFrame) -> DataFrame:
    return cards.filter("is_tracked AND current_price >= 2.0").select("card_id", "current_price", "price_variant")


def batch_scores(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """One row per tracked, priced card: liquidity and appreciation."""
    live = _live(cards)
    rows = with_sales(live, sales, as_of).join(steady_appreciation(metric_series(bars, live)), "card_id", "left")
    price, median = F.col("current_price"), F.col("median_sold")
    spread = F.when(median > 0, F.abs(price - median) / median * 100)
    return rows.withColumn("spread_pct", spread).select(
        "card_id", "sales_30d", "sales_90d", "median_sold", "spread_pct",
        E.liquidity_score(F.col("sales_90d"), F.col("sales_30d"), price, F.col("spread_pct")).alias("liquidity_score"),
        "appreciation_slope", "appreciation_consistency", "appreciation_win_rate", "appreciation_score",
    )


def batch_metrics(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """``batch_scores`` with regime and trend strength, which take a fold of every card's series.

    The rows threshold of the regime counts bars, not dates.
    """
    live = _live(cards)
    packed = S.series_arrays(metric_series(bars, live)).select("card_id", F.transform("bars", lambda b: b["price"]).alias("p"))
    n_rows = (
        bars.join(live, "card_id").filter(F.col("price_variant").isNull() | (F.col("variant") == F.col("price_variant")))
        .groupBy("card_id").agg(F.count("*").alias("n_rows"))
    )
    p = F.col("p")
    trend = packed.join(n_rows, "card_id").filter("n_rows >= 30").withColumn("adx", K.adx(p)).select(
        "card_id", "adx", K.regime(p, F.col("adx")).alias("regime")
    )
    return batch_scores(bars, cards, sales, as_of).join(trend, "card_id", "left")


def liquidity_history_rows(metrics: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append: at most one per card and day."""
    today = metrics.select(
        "card_id", as_of.alias("date"), "liquidity_score", "sales_30d", "sales_90d", rnd(F.col("spread_pct")).alias("spread_pct")
    )
    return today.join(history.select("card_id", "date"), ["card_id", "date"], "left_anti")


def record_liquidity(metrics: DataFrame, path: str, as_of: Column) -> None:
    """Adds the day's liquidity to the history at ``path``, partitioned by day; cards that have a row of the day keep it.

    So a second run on a day adds nothing. Only the day's partition is read.
    """
    today = metrics.select("card_id", as_of.alias("date"), "liquidity_score", "sales_30d", "sales_90d", rnd(F.col("spread_pct")).alias("spread_pct"))
    stored = read_or_empty(metrics.sparkSession, path, today).filter(F.col("date") == as_of)
    liquidity_history_rows(metrics, stored, as_of).write.mode("append").partitionBy("date").parquet(path)


def demand_bonus(name: Column) -> Column:
    words = F.split(name, r"\s+")
    out = F.lit(0)
    for bonus in sorted(DEMAND_WORDS):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, DEMAND_WORDS[bonus]))), bonus).otherwise(out)
    return out


def rarity_points(rarity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RARITY_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rarity), F.lit(DEFAULT_RARITY_SCORE))


def candidates(cards: DataFrame, metrics: DataFrame) -> DataFrame:
    """All screener columns for every tracked card."""
    price, slope = F.col("current_price"), F.col("appreciation_slope")
    rows = (
        cards.filter("is_tracked AND current_price > 0").join(metrics, "card_id", "left")
        .na.fill(0, ["sales_30d", "sales_90d"])
        .withColumn("breakeven_pct", E.breakeven(price))
        .withColumn("bonus", demand_bonus(F.col("name")))
        .withColumn("rarity_score", F.least(F.lit(100), rarity_points(F.col("rarity")) + F.col("bonus")))
    )
    hurdle = F.log(1 + F.col("breakeven_pct") / 100)
    daily = F.log(1 + slope / 100)
    liquidity, app = F.coalesce("liquidity_score", F.lit(0)), F.col("appreciation_score")
    gate = 1.0 / (1.0 + F.exp(-0.1 * (liquidity - 30)))
    score = F.least(F.lit(100.0), app * gate + F.col("rarity_score") * 0.15)
    rough = F.coalesce(app, F.lit(0.0)) * (
        F.when(liquidity < 10, 0.1).when(liquidity < 30, 0.1 + (liquidity - 10) * 0.02)
        .when(liquidity < 60, 0.5 + (liquidity - 30) * 0.015).otherwise(1.0)
    )
    median = rnd(F.col("median_sold"))
    return rows.select(
        "card_id", "name", "set_name", "rarity", "current_price", "price_variant", "liquidity_score",
        rnd(F.col("sales_30d") / 30.0).alias("sales_per_day"),
        E.time_to_sell(price, F.col("sales_90d"), F.col("sales_30d"))["estimated_days"].alias("days_to_sell"),
        median.alias("median_sold"), "appreciation_slope", "appreciation_consistency", "appreciation_win_rate", "appreciation_score",
        rnd(slope - hurdle / 365 * 100, 4).alias("breakeven_adjusted_slope"),
        F.when(slope > 0, F.round(hurdle / daily)).cast("long").alias("days_to_breakeven"),
        "rarity_score", (F.col("bonus") > 0).alias("is_blue_chip"), "regime", "adx",
        rnd(score, 1).alias("investment_score"), "breakeven_pct",
        rnd(median - price * E.SCREENER_COST_FACTOR).alias("est_profit"), rough.alias("sort_score"),
    )


def screener(
    cards: DataFrame, metrics: DataFrame, *, min_liquidity: int = 0, min_appreciation_score: float = 0.0,
    regime: str | None = None, exclude_regime: str | None = None, min_price: float = 10.0, max_price: float | None = None,
    min_velocity: float = 0.0, min_profit: float | None = None, q: str | None = None,
    sort_by: str = "investment_score", sort_dir: str = "desc", page: int = 1, page_size: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """One page of candidates and the total count, as (page, total)."""
    rows = candidates(cards, metrics).filter(F.col("current_price") >= min_price)
    if min_liquidity > 0:
        rows = rows.filter(F.col("liquidity_score") >= min_liquidity)
    if min_appreciation_score > 0:
        rows = rows.filter(F.col("appreciation_score") >= min_appreciation_score)
    if regime:
        rows = rows.filter(F.col("regime") == regime)
    if exclude_regime:
        rows = rows.filter(F.col("regime").isNull() | (F.col("regime") != exclude_regime))
    if max_price is not None:
        rows = rows.filter(F.col("current_price") <= max_price)
    if q:
        rows = rows.filter(F.col("name").ilike(f"%{q}%") | F.col("set_name").ilike(f"%{q}%"))
    if min_velocity > 0:
        rows = rows.filter(F.col("sales_per_day") >= min_velocity)
    if min_profit is not None:
        rows = rows.filter(F.col("est_profit") >= min_profit)
    total = rows.agg(F.count("*").alias("total"))
    down = sort_dir == "desc"
    if sort_by == "est_profit":
        order = F.desc_nulls_last(sort_by) if sort_dir != "asc" else F.asc_nulls_last(sort_by)
    else:
        key = rnd(F.col("sort_score"), 6) if sort_by == "investment_score" else F.col(sort_by if sort_by in SORTABLE else "appreciation_score")
        order = key.desc_nulls_last() if down else key.asc_nulls_first()
    ordered = rows.orderBy(order, "card_id").offset((page - 1) * page_size).limit(page_size)
    return ordered.drop("sort_score"), total


def screener_stats(metrics: DataFrame, cards: DataFrame, as_of: Column) -> DataFrame:
    """Coverage and averages per regime with the grand total (regime null)."""
    rows = cards.filter("is_tracked AND current_price IS NOT NULL").select("card_id").join(metrics, "card_id", "left")
    return rows.rollup("regime").agg(
        F.grouping("regime").cast("int").alias("is_total"), F.count("*").alias("cards"), F.count("liquidity_score").alias("with_liquidity"),
        F.count("appreciation_score").alias("with_appreciation"), rnd(F.avg("liquidity_score"), 1).alias("avg_liquidity"),
        rnd(F.avg("appreciation_score"), 1).alias("avg_appreciation"),
    ).withColumn("last_computed", as_of)


def liquidity_trend(history: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return history.filter(F.col("date") >= F.date_sub(as_of, days)).orderBy("card_id", "date")


def flip_rows(rows: DataFrame) -> DataFrame:
    """Flip profit, return and badge; falling cards are dropped."""
    parts = E.flip_metrics(F.col("current_price"), F.col("median_sold"))
    score = F.coalesce("investment_score", F.lit(0.0))
    return rows.filter(F.col("regime").isNull() | (F.col("regime") != "markdown")).select(
        "card_id", "name", "current_price", "median_sold", "sales_per_day",
        *[rnd(c, 4).alias(n) for n, c in parts.items()],
        E.flip_badge(score, F.col("breakeven_adjusted_slope")).alias("badge"),
        rnd(F.when(F.col("median_sold") > 0, (F.col("current_price") - F.col("median_sold")) / F.col("median_sold") * 100), 4).alias("spread_pct"),
    )


def flip_summary(flips: DataFrame) -> DataFrame:
    good = flips.filter("flip_profit > 0")
    return good.agg(
        F.count("*").alias("profitable"), rnd(F.avg("flip_roi"), 4).alias("avg_roi"), rnd(F.avg("sales_per_day"), 4).alias("avg_velocity"),
        F.max_by("name", F.struct("flip_profit", (-F.col("card_id")).alias("k"))).alias("best_name"), F.max("flip_profit").alias("best_profit"),
    )
