"""Price alerts and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions.numeric import pct_change
from thinmarket.functions.text import money
from thinmarket.operators import indicators as I
from thinmarket.operators import sales as A
from thinmarket.operators.ranking import ordered_rank


# Closing sentences of the card summary.
GUIDANCE = {
    "cheap": "This looks like a good buying opportunity — listed below recent sale prices with steady demand.",
    "dear": "Currently listed well above recent sales — consider waiting for a price drop or shopping around.",
    "slow": "This card sells infrequently, so it may take a while to find a buyer if you sell.",
    "fair": "The listing price is close to recent sale values — fairly priced right now.",
}


def fire_alerts(alerts: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """First rule that holds of every active alert not fired in the last day."""
    spread = A.spread_vs_median(cards.filter("current_price > 0"), sales, as_of).select("card_id", "spread_pct")
    quiet = F.col("last_triggered_at").isNull() | (F.col("last_triggered_at") <= as_of.cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    rows = (
        alerts.filter(F.col("is_active") & quiet)
        .join(cards.filter("current_price > 0").select("card_id", "name", "current_price"), "card_id")
        .join(spread, "card_id", "left")
    )
    price = F.col("current_price")
    above = (F.col("threshold_above") != 0) & (price >= F.col("threshold_above"))
    below = (F.col("threshold_below") != 0) & (price <= F.col("threshold_below"))
    close = F.col("spread_pct") <= F.col("spread_threshold")
    fired = F.when(above, "above").when(below, "below").when(close, "spread_below")
    value = F.when(above, F.col("threshold_above")).when(below, F.col("threshold_below")).when(close, F.col("spread_threshold"))
    return rows.withColumn("fired", fired).withColumn("threshold", value).filter("fired IS NOT NULL").select(
        "alert_id", "card_id", "email", "name", "current_price", "fired", "threshold"
    )


def upsert_alerts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rules; of each (card, address) only the newest stays active."""
    newest = new.groupBy("card_id", "email").agg(F.max("alert_id").alias("newest"))
    rows = existing.unionByName(new, allowMissingColumns=True).join(newest, ["card_id", "email"], "left")
    replaced = F.col("newest").isNotNull() & (F.col("alert_id") != F.col("newest"))
    return rows.withColumn("is_active", F.col("is_active") & ~replaced).drop("newest")


def dedup_insights(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New findings as updates of an open one of the last day, else as inserts."""
    open_ = (
        existing.filter(~F.col("acknowledged") & (F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")))
        .groupBy("card_id", "type").agg(F.min("insight_id").alias("open_id"))
    )
    return new.join(open_, ["card_id", "type"], "left").withColumn(
        "action", F.when(F.col("open_id").isNotNull(), "update").otherwise("insert")
    )


def set_rank(cards: DataFrame) -> DataFrame:
    """Rank by price within the set and the number of ranked cards."""
    live = cards.filter("is_tracked AND current_price > 0 AND set_name IS NOT NULL")
    ranked = ordered_rank(live, ["set_name"], "current_price", "card_id", "set_rank")
    return ranked.select("card_id", "set_name", "set_rank", F.col("group_size").alias("set_total"))


def big_movers(cards: DataFrame, series: DataFrame, as_of: Column, threshold: float = 20.0) -> DataFrame:
    """How many cards moved more than the threshold against the price a week ago. All cards count."""
    week_ago = F.date_sub(as_of, 7)
    old = series.filter(F.col("date") <= week_ago).groupBy("card_id").agg(F.max_by("price", "date").alias("old"))
    live = cards.filter("is_tracked AND current_price > 0").join(old.filter("old > 0"), "card_id")
    change = F.abs(pct_change(F.col("current_price"), F.col("old")))
    return live.agg(F.count_if(change > threshold).alias("big_movers"), F.count("*").alias("checked"))


def card_insights(bars: DataFrame, cards: DataFrame, sales: DataFrame, series: DataFrame, as_of: Column) -> DataFrame:
    """Up to five findings per priced card in the order of the rules; one that says so for a card without a price."""
    movers = big_movers(cards, series, as_of).select("big_movers").scalar()
    sold = A.sales_profile(sales, as_of).select("card_id", "sales_30d", "avg_sale")
    rows = (
        cards.filter("current_price > 0").select("card_id", "set_name", "current_price")
        .join(I.analyze_cards(bars, cards), "card_id", "left").join(sold, "card_id", "left")
        .join(set_rank(cards).drop("set_name"), "card_id", "left")
        .withColumn("movers", movers)
        .withColumn("s30", F.coalesce("sales_30d", F.lit(0)))
        .withColumn("off90", F.when(F.col("sma_90") > 0, (F.col("current_price") - F.col("sma_90")) / F.col("sma_90") * 100))
        .withColumn("off_sale", F.when(F.col("avg_sale") > 0, (F.col("current_price") - F.col("avg_sale")) / F.col("avg_sale") * 100))
    )
    c7, s30, off, rank = F.col("change_7d"), F.col("s30"), F.col("off90"), F.col("set_rank")
    ath, rsi, gap = F.col("pct_from_ath"), F.col("rsi_14"), F.col("off_sale")

    def note(title: str, kind: str, fmt: str, *args: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), F.lit(kind).alias("type"), F.format_string(fmt, *args).alias("text"))

    def whole(col: Column) -> Column:
        return F.round(F.abs(col) + 1e-9, 0)

    ranked = F.col("set_total") > 1
    rules = [
        F.when(c7 > 20, note("Surging", "bullish", "Up %+.1f%% in a week; %d cards moved this much", F.round(c7 + 1e-9, 1), F.col("movers")))
        .when(c7 > 10, note("Climbing", "bullish", "Up %+.1f%% this week", F.round(c7 + 1e-9, 1)))
        .when(c7 < -15, note("Dip Alert", "bearish", "Down %+.1f%% this week", F.round(c7 + 1e-9, 1)))
        .when(c7 < -5, note("Cooling Off", "bearish", "Down %+.1f%% this week", F.round(c7 + 1e-9, 1))),
        F.when(s30 > 20, note("Hot Seller", "bullish", "%d sales in 30 days", s30))
        .when(s30 > 5, note("Active Market", "neutral", "%d sales in 30 days", s30))
        .when(s30 > 0, note("Slow Mover", "bearish", "%d sales in 30 days", s30)),
        F.when(off < -15, note("Below Average", "bullish", "%.0f%% below the 90-point average", whole(off)))
        .when(off > 15, note("Premium", "bearish", "%.0f%% above the 90-point average", whole(off))),
        F.when(ranked & (rank <= 3), note("Set Rank", "info", "#%d in %s of %d", rank, F.col("set_name"), F.col("set_total")))
        .when(ranked & (rank <= 10), note("Set Rank", "info", "#%d in %s of %d", rank, F.col("set_name"), F.col("set_total")))
        .when(ranked & rank.isNotNull(), note("Set Rank", "neutral", "#%d in %s of %d", rank, F.col("set_name"), F.col("set_total"))),
        F.when(gap < -10, note("Flip Opportunity", "bullish", "%.0f%% below the mean sale", whole(gap)))
        .when(gap > 50, note("Overpriced", "bearish", "%.0f%% above the mean sale", whole(gap))),
        F.when(ath < -40, note("Well Below Peak", "neutral", "%.0f%% below the peak", whole(ath)))
        .when(F.abs(ath) < 5, note("Near All-Time High", "bullish", "%.0f%% below the peak", whole(ath))),
        F.when(rsi > 70, note("Overbought", "bearish", "RSI at %.0f", whole(rsi)))
        .when(rsi < 30, note("Oversold", "bullish", "RSI at %.0f", whole(rsi))),
    ]
    found = F.slice(F.array_compact(F.array(*rules)), 1, 5)
    unpriced = cards.filter("current_price IS NULL OR current_price <= 0").select(
        "card_id", F.lit(0).alias("pos"), F.lit("No Price Data").alias("title"), F.lit("info").alias("type"), F.lit("No price yet; prices are refreshed periodically").alias("text")
    )
    return rows.select("card_id", F.posexplode(found).alias("pos", "n")).select("card_id", "pos", "n.*").unionByName(unpriced)


def card_summary_text(bars: DataFrame, cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Plain sentences on price, recent sales, trend and spread."""
    profile = A.sales_profile(sales, as_of).select("card_id", "sales_30d", "median_sold")
    totals = sales.groupBy("card_id").agg(F.count("*").alias("n_sales"))
    rows = (
        cards.select("card_id", "current_price")
        .join(I.analyze_cards(bars, cards).select("card_id", "sma_30", "sma_90"), "card_id", "left")
        .join(profile, "card_id", "left").join(totals, "card_id", "left").na.fill(0, ["sales_30d", "n_sales"])
        .withColumn("price", F.coalesce("median_sold", "current_price"))
    )
    price, n, s30 = F.col("price"), F.col("n_sales"), F.col("sales_30d")
    trend = (F.col("sma_30") - F.col("sma_90")) / F.col("sma_90") * 100
    spread = (F.col("current_price") - price) / price * 100
    pace = s30 / 30.0
    text = F.concat_ws(
        " ",
        F.when(F.col("median_sold").isNotNull(), F.concat(F.lit("This card is worth ~"), money(price), F.lit(" based on recent sales.")))
        .otherwise(F.concat(F.lit("This card is listed at "), money(price), F.lit("."))),
        F.when(n == 0, F.lit("No recent sales have been recorded yet."))
        .when(s30 > 0, F.format_string("It sold %d time%s in the last 30 days.", s30, F.when(s30 != 1, "s").otherwise("")))
        .otherwise(F.format_string("%d sale%s on record, but none in the last 30 days.", n, F.when(n != 1, "s").otherwise(""))),
        F.when(trend >= 5, "Prices have been trending up.").when(trend <= -5, "Prices have been trending down."),
        F.when((spread < -10) & (pace >= 0.5), GUIDANCE["cheap"]).when(spread > 50, GUIDANCE["dear"])
        .when(pace < 0.2, GUIDANCE["slow"]).when(spread.between(-10, 20), GUIDANCE["fair"]),
    )
    return rows.select("card_id", F.when(price.isNull(), "Price data is not yet available for this card.").otherwise(text).alias("summary"))
