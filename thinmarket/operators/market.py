"""Aggregates over the whole market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import indicators as I
from thinmarket.operators import sales as A

LIVE = "is_tracked AND current_price > 0"


def own_variant(bars: DataFrame, cards: DataFrame, *carry: str) -> DataFrame:
    """Bars of the variant the card names, with card columns."""
    return bars.filter(F.col("market_price").isNotNull()).join(
        cards.select("card_id", "price_variant", *carry), "card_id"
    ).filter(F.col("variant") == F.col("price_variant"))


def mover_changes(bars: DataFrame, cards: DataFrame, end: Column, days: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean price of the window up to ``end`` against the window before, in one conditional pass."""
    day = F.col("date")
    recent = (day >= F.date_sub(end, days)) & (day <= end)
    before = (day >= F.date_sub(end, 2 * days)) & (day < F.date_sub(end, days))
    live = cards.filter("is_tracked AND current_price >= 2.0")
    return (
        own_variant(bars, live, "name", "set_name").filter(recent | before)
        .groupBy(*by, "card_id", "name", "set_name", "variant")
        .agg(F.avg(F.when(recent, F.col("market_price"))).alias("now"), F.avg(F.when(before, F.col("market_price"))).alias("prev"))
        .withColumn("change_pct", F.when(F.col("prev") >= 1.0, (F.col("now") - F.col("prev")) / F.col("prev") * 100))
        .filter(F.abs("change_pct") <= 500)
        .select(
            *by, "card_id", "name", "set_name", "variant", rnd(F.col("now")).alias("current_price"),
            rnd(F.col("prev")).alias("previous_price"), rnd(F.col("change_pct")).alias("change_pct"),
        )
    )


def top_movers(bars: DataFrame, cards: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """Largest gains and losses. Each side is a top-k, so nothing is ranked as a whole."""
    moved = mover_changes(bars, cards, as_of, days)
    up = moved.filter("change_pct > 0").orderBy(F.desc("change_pct"), "card_id").limit(limit)
    down = moved.filter("change_pct < 0").orderBy("change_pct", "card_id").limit(limit)
    return up.withColumn("side", F.lit("gainer")).unionByName(down.withColumn("side", F.lit("loser")))


def set_relative_strength(bars: DataFrame, cards: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mean return per set over the mean of all sets. Only one row per set reaches the last step."""
    live = cards.filter("is_tracked AND current_price >= 2.0 AND set_id IS NOT NULL").select("card_id", "set_id", "current_price")
    recent = bars.filter((F.col("date") >= F.date_sub(as_of, days)) & (F.col("market_price") > 0))
    gain = (F.col("current_price") - F.col("market_price")) / F.col("market_price")
    per_set = recent.join(live, "card_id").groupBy("set_id").agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_return"))
    market = per_set.agg(F.avg("avg_return")).scalar()
    return per_set.select(
        "set_id", F.when(market == 0, 1.0).otherwise(rnd(F.col("avg_return") / market)).alias("strength")
    )


def hot_cards(bars: DataFrame, cards: DataFrame, limit: int = 12) -> DataFrame:
    """Most active cards of all that have ten bars and a price.

    All cards are ranked by their activity alone; only those of the list are analysed in full.
    """
    live = cards.filter("is_tracked AND current_price >= 2.0")
    stats = own_variant(bars, live).groupBy("card_id").agg(F.count("*").alias("n"), F.avg("market_price").alias("avg_price"))
    fit_ids = stats.filter("n >= 10 AND avg_price >= 2.0").select("card_id")
    packed = I.chosen_bars(bars.join(fit_ids, "card_id", "left_semi"), cards.join(fit_ids, "card_id", "left_semi"))
    odd = F.coalesce(F.col("volatility") > 500, F.lit(False)) | F.coalesce(F.abs("change_7d") > 500, F.lit(False))
    ranked = I.with_activity(packed).withColumn("fit", F.col("activity_score").isNotNull() & ~odd)
    # Filtered above the limit: pushed below it, the filter would repeat the folds.
    found = I.analyze(ranked.orderBy(F.desc("fit"), F.desc("activity_score"), "card_id").limit(limit).filter("fit").select("card_id", "bars"))
    # A group per card (there is one row of each): a filter on what the folds yield stays above it. Pushed into them it repeats them hundreds of times.
    read = ("activity_score", "volatility", "spread_ratio", "momentum", "change_7d", "signal", "signal_strength")
    top = found.groupBy("card_id").agg(F.first(F.struct(*read)).alias("r")).select("card_id", "r.*")
    everything = Window.partitionBy(F.lit(1))  # at most limit rows
    low, high = F.min("activity_score").over(everything), F.max("activity_score").over(everything)
    scaled = F.when(high > low, rnd((F.col("activity_score") - low) / (high - low) * 100, 1)).otherwise(F.col("activity_score"))
    return top.select(
        "card_id", scaled.alias("activity_score"), rnd(F.col("volatility")).alias("volatility"),
        rnd(F.col("spread_ratio")).alias("spread_ratio"), rnd(F.col("momentum")).alias("momentum"),
        rnd(F.col("change_7d")).alias("change_7d"), "signal", rnd(F.col("signal_strength")).alias("signal_strength"),
    ).join(cards.select("card_id", "name", "set_name", "rarity", "current_price"), "card_id")


def market_index(cards: DataFrame, bars: DataFrame) -> DataFrame:
    totals = cards.filter(LIVE).agg(
        rnd(F.avg("current_price")).alias("avg_price"), F.count("*").alias("total_cards"),
        rnd(F.sum("current_price")).alias("total_market_cap"),
    )
    return totals.withColumn("last_sync_at", bars.agg(F.max("date")).scalar())


def recap_calendar(bars: DataFrame, as_of: Column, weeks: int = 12) -> DataFrame:
    """Seven-day periods back from ``as_of``; the last one is cut at the earliest date."""
    first = bars.agg(F.min("date").alias("first"), as_of.alias("last"))
    week = F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))
    rows = first.withColumn("week", week).withColumn("end", F.expr("date_sub(last, 7 * week)"))
    return rows.filter("end > first").select(
        "week", F.greatest(F.date_sub("end", 7), F.col("first")).alias("start"), "end"
    )


def recap_index(bars: DataFrame, weeks: DataFrame) -> DataFrame:
    """Average price per week with its change, falling back on the period mean at the end.

    Bars are reduced to one row per day first, so the join with the weeks sees only days.
    """
    daily = bars.filter("market_price > 0").groupBy("date").agg(F.sum("market_price").alias("s"), F.count("*").alias("c"))
    joined = weeks.join(F.broadcast(daily), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")), "left")

    def mean(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("c")))

    agg = joined.groupBy("week", "start", "end").agg(
        F.coalesce(mean(F.col("date") == F.col("end")), mean(F.lit(True))).alias("avg_end"),
        mean(F.col("date") == F.col("start")).alias("avg_start"),
    )
    return agg.select(
        "week", "start", "end", F.coalesce(rnd(F.col("avg_end")), F.lit(0.0)).alias("avg_price"),
        F.when(F.col("avg_start") > 0, rnd((F.col("avg_end") - F.col("avg_start")) / F.col("avg_start") * 100)).alias("change_pct"),
    )


def weekly_recap(bars: DataFrame, cards: DataFrame, weeks: DataFrame, limit: int = 5) -> DataFrame:
    """Index, gainers and losers of every week of the calendar, in one pass over the bars.

    Every bar joins at most the two weeks it counts in: its own and the one after.
    """
    spread = weeks.select("week", "end", F.explode(F.sequence(F.date_sub("end", 14), F.col("end"))).alias("date"))
    dated = bars.join(F.broadcast(spread), "date")  # at most 12 weeks x 15 days
    moved = mover_changes(dated, cards, F.col("end"), 7, by=("week", "end"))
    side = F.when(F.col("change_pct") > 0, "gainer").when(F.col("change_pct") < 0, "loser")
    w = Window.partitionBy("week", "side").orderBy(F.desc(F.abs("change_pct")), "card_id")
    top = moved.withColumn("side", side).filter("side IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    index = recap_index(bars, weeks)
    lines = top.select("week", "side", "rank", "card_id", "change_pct")
    base = index.select("week", F.lit("index").alias("side"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("card_id"), "change_pct")
    return lines.unionByName(base)


def current_recap(bars: DataFrame, cards: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """The running week: movers, hottest cards and the totals of current prices.

    The index changes against the mean of the bars of exactly seven days ago; without any it is null.
    """
    old = bars.filter((F.col("date") == F.date_sub(as_of, 7)) & (F.col("market_price") > 0)).agg(F.avg("market_price")).scalar()
    avg = F.col("avg_price")
    index = market_index(cards, bars).select(
        F.lit("index").alias("side"), F.lit(0).alias("rank"), avg.alias("price"), F.when(old > 0, rnd((avg - old) / old * 100)).alias("change_pct"),
        "total_cards", "total_market_cap",
    )
    moved = top_movers(bars, cards, as_of, 7, limit).withColumn("by", F.abs("change_pct"))
    hot = hot_cards(bars, cards, limit).withColumn("side", F.lit("hottest")).withColumn("change_pct", F.col("change_7d")).withColumn("by", F.col("activity_score"))
    cols = ["side", "card_id", "name", F.col("current_price").alias("price"), "change_pct", "by"]
    listed = moved.select(*cols).unionByName(hot.select(*cols))
    w = Window.partitionBy("side").orderBy(F.desc("by"), "card_id")  # at most limit rows a side
    return index.unionByName(listed.withColumn("rank", F.row_number().over(w)).drop("by"), allowMissingColumns=True)


def set_analytics(cards: DataFrame, metrics: DataFrame, min_cards: int = 5) -> DataFrame:
    return (
        cards.filter(LIVE).join(metrics, "card_id", "left").groupBy("set_name")
        .agg(
            F.count("*").alias("card_count"), F.avg("current_price").alias("avg_price"), F.sum("current_price").alias("total_value"),
            F.avg("liquidity_score").alias("avg_liquidity_score"), F.avg("appreciation_score").alias("avg_appreciation_score"),
            (F.avg("appreciation_slope") * 7).alias("avg_7d_change"),
        )
        .filter(F.col("card_count") >= min_cards)
    )


def market_overview(cards: DataFrame, bars: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    """One ``market`` row of totals and tiers, then the top movers as ``gainer`` and ``loser`` rows.

    Totals are those of tracked cards; tiers count viable cards (``is_viable``), tracked or not.
    """
    price = F.col("current_price")
    live, viable = F.col("is_tracked"), F.coalesce("is_viable", F.lit(False))
    own = F.when(live, price)
    totals = cards.filter("current_price > 0").agg(
        F.count_if(live).alias("total_cards"), rnd(F.avg(own)).alias("avg_price"), rnd(F.sum(own)).alias("total_value"),
        F.min(own).alias("min_price"), F.max(own).alias("max_price"),
        F.count_if(viable & (price >= 100)).alias("premium"), F.count_if(viable & (price >= 50) & (price < 100)).alias("mid_high"),
        F.count_if(viable & (price >= 20) & (price < 50)).alias("mid"),
    ).withColumn("section", F.lit("market"))
    moved = top_movers(bars, cards, as_of, 7, limit).select(F.col("side").alias("section"), "card_id", "name", "set_name", "current_price", "change_pct")
    return totals.unionByName(moved, allowMissingColumns=True)


def set_concentration(cards: DataFrame, limit: int = 10) -> DataFrame:
    """Sets by market value, with each set's share of the priced cards and the risk flag."""
    per_set = cards.filter(LIVE).groupBy("set_id", "set_name").agg(
        F.count("*").alias("cards"), rnd(F.sum("current_price")).alias("market_cap"), rnd(F.avg("current_price")).alias("avg_price"),
        F.min("current_price").alias("min_price"), F.max("current_price").alias("max_price"),
    )
    total, most = per_set.agg(F.sum("cards")).scalar(), per_set.agg(F.max("cards")).scalar()
    return (
        per_set.withColumn("share_pct", rnd(F.col("cards") / total * 100))
        .withColumn("warning", F.when(most >= total * 0.3, "HIGH").otherwise("LOW"))
        .filter("cards >= 2").orderBy(F.desc("market_cap"), "set_id").limit(limit)
    )


def sales_liquidity_panel(sales: DataFrame, cards: DataFrame, as_of: Column) -> DataFrame:
    recent = sales.filter(A.since(as_of, 90))
    stats = A.grouped_medians(recent, ["card_id"], "purchase_price", {"a": A.since(as_of, 30), "b": F.lit(True)})
    conditions = recent.groupBy("card_id").agg(F.array_join(F.sort_array(F.collect_set("condition")), ",").alias("conditions"))
    price, median = F.col("current_price"), F.col("b_upper")
    return stats.join(conditions, "card_id").join(cards.select("card_id", "name", "current_price"), "card_id").select(
        "card_id", "name", F.col("b_count").alias("sales_90d"), F.col("a_count").alias("sales_30d"),
        rnd(F.col("b_mean")).alias("avg_sale"), rnd(median).alias("median_sale"),
        F.when((price > 0) & (median > 0), rnd((price - median) / median * 100, 1)).alias("spread_pct"), "conditions",
    )


def sales_totals(sales: DataFrame, as_of: Column) -> DataFrame:
    """The totals above the panel: all sales, cards that have any, sales of the last 30 days. Counts a card first."""
    per_card = sales.groupBy("card_id").agg(F.count("*").alias("n"), F.count_if(A.since(as_of, 30)).alias("r"))
    return per_card.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_sales"), F.count("card_id").alias("cards_with_sales"), F.coalesce(F.sum("r"), F.lit(0)).alias("sales_last_30d"),
    )


def sales_stats(sales: DataFrame) -> DataFrame:
    """Exact distinct count by pre-grouping, so one hot card costs one row."""
    per_card = sales.groupBy("card_id").agg(F.count("*").alias("c"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    return per_card.agg(
        F.sum("c").alias("total_sales"), F.count("*").alias("cards_with_sales"),
        F.min("lo").alias("first_sale"), F.max("hi").alias("last_sale"),
    )


def price_anomalies(bars: DataFrame, cards: DataFrame, as_of: Column, days: int = 7, limit: int = 20) -> DataFrame:
    live = cards.filter("is_tracked AND current_price >= 10")
    near_mint = F.col("condition").isNull() | (F.col("condition") == "Near Mint")
    recent = bars.filter((F.col("date") >= F.date_sub(as_of, days)) & near_mint & (F.col("market_price") > 5))
    change = F.col("change_pct")
    return (
        own_variant(recent, live, "name", "current_price").groupBy("card_id", "name", "current_price")
        .agg(F.count("*").alias("n"), F.avg("market_price").alias("avg_price"))
        .withColumn("change_pct", (F.col("current_price") - F.col("avg_price")) / F.col("avg_price") * 100)
        .filter((F.col("n") >= 2) & ((change > 15) | (change < -25)))
        .select(
            "card_id", "name", "current_price", rnd(F.col("avg_price")).alias("avg_price"), rnd(change).alias("change_pct"),
            F.when(change > 0, "opportunity").otherwise("warning").alias("type"),
            F.when((change > 30) | (change < -40), "urgent").otherwise("notable").alias("severity"),
        )
        .orderBy(F.desc(F.abs("change_pct")), "card_id").limit(limit)
    )


def tracked_stats(cards: DataFrame, sets: DataFrame, curated: DataFrame, as_of: Column, recent_days: int = 1825) -> DataFrame:
    """Counts of the tracked universe as (section, key, value) rows."""
    marked = cards.join(curated.withColumn("curated", F.lit(True)), "card_id", "left")

    def line(section: str, key: Column, rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(key.alias("key")).agg(value.alias("value")).select(F.lit(section).alias("section"), "key", "value")

    tracked = marked.filter("is_tracked")
    recent = sets.filter(F.col("release_date") >= F.date_sub(as_of, recent_days))
    per_set = recent.join(tracked.select("set_id", "card_id"), "set_id", "left")
    return (
        line("tracked", F.when(F.col("is_tracked"), "tracked").otherwise("untracked"), marked, F.count("*"))
        .unionByName(line("curated", F.lit("curated"), tracked, F.count("curated")))
        .unionByName(line("rarity", F.col("rarity"), tracked, F.count("*")))
        .unionByName(line("recent_set", F.col("set_name"), per_set, F.count("card_id")))
    )
