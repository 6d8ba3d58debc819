"""Analysis joined with liquidity and economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.operators import indicators as I
from thinmarket.operators import sales as A


def with_sales(df: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Adds 30 and 90 day counts (zero when absent), the median and the mean sale."""
    return df.join(A.sales_profile(sales, as_of), "card_id", "left").na.fill(0, ["sales_30d", "sales_90d"])


def analysis_with_liquidity(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Analysis of every card; the liquidity spread here is against the mean sale."""
    full = with_sales(I.analyze_cards(bars, cards).join(cards.select("card_id", "current_price"), "card_id"), sales, as_of)
    spread = F.when(F.col("avg_sale") > 0, (F.col("current_price") - F.col("avg_sale")) / F.col("avg_sale") * 100)
    score = E.liquidity_score(
        F.col("sales_90d"), F.col("sales_30d"), F.coalesce("current_price", F.lit(0.0)), spread
    )
    return full.withColumn("liquidity_score", score).drop("current_price", "median_sold", "n_positive", "avg_sale")


def panel_flags(price: Column) -> Column:
    ratio = price / F.col("sma_7")
    return F.array_join(
        F.array_compact(
            F.array(
                F.when((ratio > 3) | (ratio < 0.33), "EXTREME_MA_DIVERGENCE"),
                F.when(F.col("n_points") < 30, "LOW_DATA"),
                F.when(F.col("data_confidence") < 0.5, "LOW_CONFIDENCE"),
                F.when(price <= F.col("support"), "AT_OR_BELOW_SUPPORT"),
            )
        ),
        ",",
    )


def analysis_panel(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """One line per priced card, strongest signal first: signal, band position, flags, fees, liquidity, holding results.

    ``hold_net_return_pct`` takes the first price of the analysed series as the purchase. The hold economics
    take the 90-point average, held for as many days as there are points, 90 at most; null without one.
    """
    packed = I.chosen_bars(bars, cards).withColumn("opening", F.get("bars", 0)["price"])
    full = I.analyze(packed, "opening").join(
        cards.filter("current_price > 0").select("card_id", "name", "set_name", "current_price"), "card_id"
    )
    full = with_sales(full, sales, as_of)
    price, last = F.col("current_price"), F.col("last_price")
    width = F.col("bollinger_upper") - F.col("bollinger_lower")
    spread = F.when(F.col("median_sold") > 0, F.abs(price - F.col("median_sold")) / F.col("median_sold") * 100)
    s90, s30 = F.col("sales_90d"), F.col("sales_30d")
    hold = E.hold_economics(F.col("sma_90"), price, F.least(F.col("n_points"), F.lit(90)))
    known = F.col("sma_90") > 0
    return full.select(
        "card_id", "name", "set_name", "current_price", E.price_tier(price).alias("price_tier"),
        "signal_strength", "signal", "regime",
        F.when(width > 0, (last - F.col("bollinger_lower")) / width).alias("bb_position"),
        panel_flags(last).alias("flags"), E.breakeven(price).alias("breakeven_pct"), E.viable_trade(price).alias("viable"),
        "sales_30d", "sales_90d", E.liquidity_score(s90, s30, price, spread).alias("liquidity_score"),
        E.time_to_sell(price, s90, s30)["estimated_days"].alias("days_to_sell"),
        E.roundtrip_pnl(F.col("opening"), price)["net_return_pct"].alias("hold_net_return_pct"),
        *[F.when(known, hold[c]).alias(f"hold_{c}") for c in ("annualized_gross_pct", "annualized_net_pct", "clears_hurdle")],
        F.when(known, hold["hold_period"]).alias("recommended_hold"),
    ).orderBy(F.desc_nulls_last(F.abs("signal_strength")), "card_id")


def compare_cards(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column, ids: DataFrame) -> DataFrame:
    """A few chosen cards side by side; the ids filter every input before any analysis."""
    few = cards.join(ids, "card_id", "left_semi")
    full = I.analyze_cards(bars.join(ids, "card_id", "left_semi"), few).join(few.select("card_id", "current_price"), "card_id")
    counts = A.sales_counts(sales.join(ids, "card_id", "left_semi"), as_of)
    return full.join(counts, "card_id", "left").select(
        "card_id", "current_price", F.coalesce("sales_90d", F.lit(0)).alias("sales_90d"), "rsi_14", "regime",
        "signal_strength", "sma_30",
    )
