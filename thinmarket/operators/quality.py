"""The tracked universe and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import sales as A

# Rarities worth tracking. The case of the words is as given.
TRACKABLE_RARITIES = (
    "Ultra Rare",
    "Secret Rare",
    "Special illustration rare",
    "Illustration rare",
    "Hyper Rare",
    "Double Rare",
    "ACE SPEC Rare",
    "Amazing Rare",
    "Shiny Rare",
    "Shiny Ultra Rare",
    "LEGEND",
    "Rare Holo EX",
    "Rare Holo GX",
    "Rare Holo V",
    "Rare VMAX",
    "Rare VSTAR",
    "Rare Holo VMAX",
    "Rare Holo VSTAR",
    "Rare Ultra",
    "Rare Rainbow",
    "Rare Secret",
    "Rare Shiny",
    "Rare Shiny GX",
    "Rare Prism Star",
    "Radiant Rare",
    "Rare Holo",
    "Trainer Gallery Rare Holo",
    "Classic Collection",
)
COMMON_RARITIES = ("Common", "Uncommon")
FOIL_VARIANTS = ("holofoil", "reverseHolofoil")


def rebuild_tracked(cards: DataFrame, sets: DataFrame, curated: DataFrame, as_of: Column, recent_days: int = 1825) -> DataFrame:
    """Every card with the first reason to track it, null where there is none."""
    recent = sets.filter(F.col("release_date") >= F.date_sub(as_of, recent_days)).select("set_id", F.lit(True).alias("recent"))
    rows = (
        cards.drop("is_tracked").join(curated.select("card_id", F.lit(True).alias("curated")), "card_id", "left")
        .join(recent, "set_id", "left")
    )
    price = F.col("current_price")
    reason = (
        F.when(F.col("curated"), "curated")
        .when(F.col("recent") & F.col("rarity").isin(*TRACKABLE_RARITIES), "rarity")
        .when(F.col("recent") & (price > 2.0), "recent_price")
        .when(price >= 10.0, "price_threshold")
    )
    return rows.withColumn("reason", reason).withColumn("is_tracked", F.col("reason").isNotNull()).drop("curated", "recent")


def enforce_quality(cards: DataFrame, bars: DataFrame, as_of: Column, min_points: int = 30, max_stale: int = 7) -> DataFrame:
    """Tracked cards with the reason to untrack them, if any. New cards have a month's grace."""
    seen = bars.groupBy("card_id").agg(F.count("*").alias("n_bars"), F.max("date").alias("latest"))
    created = F.col("created_at") if "created_at" in cards.columns else F.lit(None).cast("timestamp")
    reason = (
        F.when(created > F.date_sub(as_of, 30), F.lit(None))
        .when(F.coalesce("n_bars", F.lit(0)) < min_points, "thin")
        .when(F.col("latest").isNull() | (F.col("latest") < F.date_sub(as_of, max_stale)), "stale")
    )
    return cards.filter("is_tracked").join(seen, "card_id", "left").withColumn("removed", reason)


def stale_cards(cards: DataFrame, bars: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    latest = bars.groupBy("card_id").agg(F.max("date").alias("latest"))
    return cards.filter("is_tracked").join(latest, "card_id").filter(F.col("latest") < F.date_sub(as_of, days))


def audit_top_cards(
    cards: DataFrame, bars: DataFrame, sales: DataFrame, sets: DataFrame, as_of: Column,
    limit: int | None = 100, modern_from: str = "2020-01-01",
) -> DataFrame:
    """Six checks on the dearest cards, or on all priced cards if ``limit`` is None, one row per finding.

    With a limit the cards are cut first; bars and sales are then filtered by them before any aggregation.
    """
    top = cards.filter("current_price > 0")
    variant = F.coalesce("price_variant", F.lit("normal"))
    few = lambda df: df
    if limit is not None:
        top = top.orderBy(F.desc("current_price"), "card_id").limit(limit)
        few = F.broadcast  # at most `limit` rows
        sales = sales.join(few(top.select("card_id")), "card_id", "left_semi")
    sold = A.median_sold(sales, as_of, 90)
    own = bars.join(few(top.select("card_id", variant.alias("want"))), "card_id")
    same = F.col("variant") == F.col("want")
    place = F.struct("date", "seq", "condition")

    def latest(cond: Column) -> Column:
        return F.max_by(F.when(cond, F.col("market_price")), F.when(cond, place))

    prices = own.groupBy("card_id").agg(
        F.max("date").alias("latest_date"),
        latest(same & (F.col("condition") == "Near Mint")).alias("nm"),
        latest(same & (F.col("condition") == "Lightly Played")).alias("lp"),
        latest(same).alias("now"),
        latest(same & (F.col("date") <= F.date_sub(as_of, 7))).alias("old"),
    )
    rows = (
        top.join(prices, "card_id", "left").join(sold, "card_id", "left")
        .join(sets.select("set_id", "release_date"), "set_id", "left")
        .withColumn("n_sales", F.coalesce("n_sales", F.lit(0)))
        .withColumn("median_sold", rnd(F.col("median_sold")))
        .withColumn("change_7d", F.when(F.col("old") != 0, rnd((F.col("now") - F.col("old")) / F.col("old") * 100)))
        .withColumn("days_stale", F.datediff(as_of, F.col("latest_date")))
    )
    price = F.col("current_price")

    def finding(name: str, cond: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("category"), value.cast("double").alias("value")))

    checks = F.array(
        finding("price_median_mismatch", (F.col("median_sold") > 0) & (F.col("n_sales") > 5) & (price > 10 * F.col("median_sold")), rnd(price / F.col("median_sold"), 1)),
        finding(
            "likely_wrong_variant",
            F.col("rarity").isin(*COMMON_RARITIES) & F.col("price_variant").isin(*FOIL_VARIANTS) & (F.col("release_date") >= F.lit(modern_from).cast("date")),
            F.lit(0),
        ),
        finding("stale_data", F.col("days_stale") > 14, F.col("days_stale")),
        finding("zero_sales_expensive", (price > 20) & (F.col("n_sales") == 0), price),
        finding("condition_inversions", (F.col("nm") > 0) & (F.col("lp") > F.col("nm") * 1.2), F.round((F.col("lp") / F.col("nm") - 1) * 100 + 1e-9)),
        finding("extreme_changes", (F.col("change_7d") > 500) | (F.col("change_7d") < -90), F.col("change_7d")),
    )
    return rows.select("card_id", "name", "set_name", "current_price", F.inline(F.array_compact(checks)))


def variant_mismatch_candidates(
    cards: DataFrame, sets: DataFrame, variant_prices: DataFrame, modern_from: str = "2020-01-01"
) -> DataFrame:
    """Cheap modern cards priced by a foil variant, with the variant that should be used."""
    modern = sets.filter(F.col("release_date") >= F.lit(modern_from).cast("date")).select("set_id")
    odd = cards.join(modern, "set_id", "left_semi").filter(
        F.col("rarity").isin(*COMMON_RARITIES) & F.col("price_variant").isin(*FOIL_VARIANTS) & (F.col("current_price") > 5)
    )
    offers = variant_prices.filter("market > 0").groupBy("card_id").agg(
        F.max(F.when(F.col("variant") == "normal", F.col("market"))).alias("preferred"),
        F.min(F.struct("market", "variant")).alias("cheapest"),
    )
    use_normal = F.col("preferred").isNotNull()
    return (
        odd.join(offers, "card_id")
        .withColumn("new_variant", F.when(use_normal, "normal").otherwise(F.col("cheapest.variant")))
        .withColumn("new_price", F.coalesce("preferred", "cheapest.market"))
        .filter(use_normal | (F.col("new_variant") != F.col("price_variant")))
        .select("card_id", "name", "rarity", F.col("price_variant").alias("old_variant"), F.col("current_price").alias("old_price"), "new_variant", "new_price")
    )


def bad_price_rows(bars: DataFrame, as_of: Column, same_variant: bool = False) -> DataFrame:
    """Bars of ``as_of`` off the previous day's price threefold; any variant of that day counts.

    Rows of the previous day are reduced to their lowest and highest price, which decide whether
    any of them is off.
    """
    by = ["card_id", "variant", "condition"] if same_variant else ["card_id"]
    daily = bars.filter((F.col("date") < as_of) & (F.col("market_price") > 0)).groupBy(*by, "date").agg(
        F.min("market_price").alias("lo"), F.max("market_price").alias("hi")
    )
    before = daily.groupBy(*by).agg(F.max_by(F.struct("lo", "hi"), "date").alias("p"))
    off = (F.col("market_price") < F.col("p.hi") * 0.33) | (F.col("market_price") > F.col("p.lo") * 3.0)
    return bars.filter(F.col("date") == as_of).join(before, by).filter(off).drop("p")


def without_bad_prices(bars: DataFrame, as_of: Column) -> DataFrame:
    keys = ["card_id", "date", "variant", "condition"]
    return bars.join(bad_price_rows(bars, as_of).select(*keys), keys, "left_anti")


def mark_viable(cards: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Sticky: once at the threshold, viable for good."""
    was = F.coalesce("is_viable", F.lit(False)) if "is_viable" in cards.columns else F.lit(False)
    return cards.withColumn("is_viable", was | F.coalesce(F.col("current_price") >= threshold, F.lit(False)))


def sync_worklist(cards: DataFrame, bars: DataFrame, limit: int = 50, by: str = "history") -> DataFrame:
    """Cards to refresh next: longest history, oldest ``updated_at`` (never updated ones first), viable by price, or dearest."""
    if by == "history":
        counts = bars.groupBy("card_id").agg(F.count("*").alias("n_bars"))
        rows = cards.filter("is_tracked").join(counts, "card_id", "left").withColumn("rank_by", F.coalesce("n_bars", F.lit(0)).cast("double"))
    elif by == "oldest":
        rows = cards.filter("current_price IS NOT NULL").withColumn("rank_by", -F.unix_seconds("updated_at").cast("double"))
    elif by == "viable":
        rows = mark_viable(cards).filter("is_viable").withColumn("rank_by", F.col("current_price"))
    else:
        rows = cards.filter("current_price > 0").withColumn("rank_by", F.col("current_price"))
    return rows.orderBy(F.desc_nulls_first("rank_by"), "card_id").limit(limit).select("card_id", "rank_by")
