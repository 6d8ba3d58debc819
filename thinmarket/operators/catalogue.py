"""Lists, filters, paging and look-ups over the catalogue and the ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions import text as X
from thinmarket.functions.numeric import pct_change, rnd
from thinmarket.operators import sales as A
from thinmarket.operators.containment import containing

LISTABLE = ("name", "set_name", "rarity", "current_price", "card_id")


def list_cards(
    cards: DataFrame, *, q: str | None = None, set_name: str | None = None, rarity: str | None = None, supertype: str | None = None,
    has_price: bool = False, sort_by: str = "name", sort_dir: str = "asc", page: int = 1, page_size: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A page of tracked cards and (total, total_pages)."""
    rows = cards.filter("is_tracked")
    if q:
        rows = rows.filter(F.col("name").ilike(f"%{q}%"))
    if set_name:
        rows = rows.filter(F.col("set_name") == set_name)
    if rarity:
        rows = rows.filter(F.col("rarity") == rarity)
    if supertype:
        rows = rows.filter(F.col("supertype") == supertype)
    if has_price:
        rows = rows.filter("current_price IS NOT NULL")
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / page_size))
    key = F.col(sort_by if sort_by in LISTABLE else "name")
    order = key.desc_nulls_last() if sort_dir == "desc" else key.asc_nulls_first()
    return rows.orderBy(order, "card_id").offset((page - 1) * page_size).limit(page_size), total


def filter_values(cards: DataFrame, set_name: str | None = None) -> DataFrame:
    rows = cards.filter(F.col("set_name") == set_name) if set_name else cards

    def values(col: str) -> DataFrame:
        return rows.filter(F.col(col).isNotNull()).select(F.lit(col).alias("field"), F.col(col).alias("value")).distinct()

    return values("set_name").unionByName(values("rarity")).orderBy("field", "value")


def card_with_set(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Left join of the set's card count. The set table is fixed and small, but left to the optimizer."""
    return cards.join(sets, "set_id", "left")


def similar_cards(
    cards: DataFrame, prices: DataFrame, as_of: Column, key: str = "card_id", k: int = 3, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Up to three dearest namesakes in other sets and three dearest others in the same set.

    Work is done per (base name, set), not per card, on names reduced to their dearest ``k``
    cards, so neither a crowded set nor a common name yields pairs of cards. Of ``prices`` only each
    key's last day up to a week before ``as_of`` counts. ``keep`` may store the two tables that are read
    many times; both have at most one row per card.
    """
    # A card without a name or a set is like no other, and must not take a place among the dearest.
    live = cards.filter("current_price > 0 AND name IS NOT NULL AND set_name IS NOT NULL").select(key, "name", "set_name", "current_price")
    low, base = F.lower("name").alias("low"), F.lower(X.base_name(F.col("name"))).alias("base")
    dear = [F.desc("current_price"), F.asc(key)]
    per_name = keep(
        live.withColumn("low", low).withColumn("rn", F.row_number().over(Window.partitionBy("set_name", "low").orderBy(*dear)))
        .filter(F.col("rn") <= k).drop("rn")
    )
    titles = keep(live.select("name", "set_name").distinct().select("name", "set_name", low, base))
    pairs = containing(titles, titles)

    # Namesakes: k per (base, set); of those the 2k dearest survive the removal of any one set.
    namesakes = pairs.join(per_name, "low")
    per_set = namesakes.withColumn(
        "rn", F.row_number().over(Window.partitionBy("base", "set_name").orderBy(*dear))
    ).filter(F.col("rn") <= k)
    per_base = per_set.withColumn("rn", F.row_number().over(Window.partitionBy("base").orderBy(*dear))).filter(F.col("rn") <= 2 * k)
    asked = titles.select("base", F.col("set_name").alias("own_set")).distinct()
    hit = [F.col(key).alias("similar_id"), "name", "set_name", "current_price"]
    by_pair = Window.partitionBy("base", "own_set").orderBy(*dear)
    elsewhere = (
        asked.join(per_base.select("base", key, "name", "set_name", "current_price"), "base").filter("set_name <> own_set")
        .withColumn("rn", F.row_number().over(by_pair)).filter(F.col("rn") <= k)
        .select("base", "own_set", F.lit("namesake").alias("kind"), *hit)
    )

    # Others in the set: names ranked by their best price; the j-th name that does not match sits
    # at rank j plus the number of matching names before it.
    best = per_name.groupBy("set_name", "low").agg(F.min(F.struct((-F.col("current_price")).alias("p"), F.col(key).alias("id"))).alias("top"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("set_name").orderBy("top"))).select("set_name", "low", "rank")
    taken = (
        asked.join(pairs, "base").join(ranked.withColumnRenamed("set_name", "own_set"), ["own_set", "low"])
        .withColumn("k", F.row_number().over(Window.partitionBy("base", "own_set").orderBy("rank")))
        .groupBy("base", "own_set").agg(*[F.count_if(F.col("rank") - F.col("k") < j).alias(f"s{j}") for j in range(1, k + 1)])
    )
    free = asked.join(taken, ["base", "own_set"], "left").select(
        "base", "own_set",
        F.explode(F.array(*[(F.coalesce(f"s{j}", F.lit(0)) + j).cast("int") for j in range(1, k + 1)])).alias("rank"),
    )
    beside = (
        free.join(ranked.withColumnRenamed("set_name", "own_set"), ["own_set", "rank"])
        .join(per_name.withColumn("own_set", F.col("set_name")), ["own_set", "low"])
        .withColumn("rn", F.row_number().over(by_pair)).filter(F.col("rn") <= k)
        .select("base", "own_set", F.lit("same_set").alias("kind"), *hit)
    )
    week_ago = F.date_sub(as_of, 7)
    old = prices.filter(F.col("date") <= week_ago).groupBy(key).agg(F.max_by("price", "date").alias("old"))
    change = pct_change(F.col("current_price"), F.col("old"))
    found = elsewhere.unionByName(beside).join(old.withColumnRenamed(key, "similar_id"), "similar_id", "left").withColumn(
        "price_change_7d", F.when(F.abs(change) <= 500, rnd(change))
    )
    # Base names are cut from distinct names, so a card finds its rows by its name.
    own = [F.col("name").alias("own_name"), F.col("set_name").alias("own_set")]
    by_title = titles.select("base", *own).join(found, ["base", "own_set"])
    return live.select(key, *own).join(by_title, ["own_name", "own_set"]).select(
        key, "kind", "similar_id", "name", "set_name", "current_price", "price_change_7d"
    )


def market_ticker(cards: DataFrame, limit: int = 20) -> DataFrame:
    return cards.filter("is_tracked AND current_price > 0").orderBy(F.desc("current_price"), "card_id").limit(limit)


def search_by_tier(
    cards: DataFrame, tier: str | None = None, min_price: float | None = None, max_price: float | None = None,
    set_name: str | None = None, limit: int = 20,
) -> DataFrame:
    rows = cards.filter("is_viable AND current_price > 0").withColumn("tier", E.price_tier(F.col("current_price")))
    if tier:
        rows = rows.filter(F.col("tier") == tier)
    if min_price is not None:
        rows = rows.filter(F.col("current_price") >= min_price)
    if max_price is not None:
        rows = rows.filter(F.col("current_price") <= max_price)
    if set_name:
        rows = rows.filter(F.col("set_name").ilike(f"%{set_name}%"))
    return rows.orderBy(F.desc("current_price"), "card_id").limit(limit)


def trade_blotter(trades: DataFrame, cards: DataFrame, side: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest fills with card names; the page is cut before the join."""
    rows = trades.filter(F.col("side") == side) if side else trades
    page = rows.orderBy(F.desc("executed_at"), F.desc("trade_id")).offset(offset).limit(limit)
    return page.join(cards.select("card_id", "name", "set_name"), "card_id", "left")


def list_predictions(predictions: DataFrame, cards: DataFrame, outcome: str | None = None, limit: int = 50) -> DataFrame:
    rows = predictions.filter(F.col("outcome") == outcome) if outcome else predictions
    page = rows.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(limit)
    return page.join(cards.select("card_id", "name", "current_price"), "card_id", "left")


def list_insights(
    insights: DataFrame, type_: str | None = None, severity: str | None = None, acknowledged: bool | None = None, limit: int = 50
) -> DataFrame:
    rows = insights
    for col, value in (("type", type_), ("severity", severity), ("acknowledged", acknowledged)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    page = rows.orderBy(F.desc("created_at"), F.desc("insight_id")).limit(limit)
    return page.withColumn("metadata", F.from_json("metadata_json", "map<string,string>"))


def alerts_for_user(alerts: DataFrame, cards: DataFrame, email: str | None = None) -> DataFrame:
    """Active rules and fired ones with the card; of one address, or of every address."""
    rows = alerts.filter(F.col("email") == email) if email else alerts
    shown = rows.filter("is_active OR last_triggered_at IS NOT NULL")
    status = F.when(F.col("is_active"), "active").otherwise("history")
    return shown.join(cards.select("card_id", "name", "current_price"), "card_id", "left").withColumn("status", status)


def recent_picks(predictions: DataFrame, cards: DataFrame, limit: int = 20) -> DataFrame:
    page = predictions.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(limit)
    return page.join(cards.select("card_id", "name", "current_price"), "card_id").withColumn(
        "return_pct", rnd(pct_change(F.col("current_price"), F.col("entry_price")), 1)
    )


def position_list(positions: DataFrame, cards: DataFrame, as_of: Column) -> DataFrame:
    price = F.coalesce("current_price", "avg_entry_price")
    value, cost = price * F.col("quantity"), F.col("avg_entry_price") * F.col("quantity")
    return (
        positions.filter("quantity > 0").join(cards.select("card_id", "name", "current_price"), "card_id", "left")
        .select(
            "portfolio_id", "card_id", "name", "quantity", "avg_entry_price", rnd(price).alias("price"),
            rnd(value).alias("market_value"), rnd(value - cost).alias("unrealized_pnl"),
            F.when(cost > 0, rnd((value - cost) / cost * 100)).alias("unrealized_pnl_pct"),
            F.datediff(as_of, F.to_date("entry_date")).alias("days_held"),
        )
    )


def sales_list(sales: DataFrame, limit: int = 20) -> DataFrame:
    """Newest sales per card with the upper median of the listed rows."""
    rows = A.newest_sales(sales, limit)
    prices = F.collect_list("purchase_price").over(Window.partitionBy("card_id"))  # at most `limit` values
    upper = F.get(F.sort_array(prices), F.floor(F.size(prices) / 2).cast("int"))
    return rows.withColumn("median_price", upper)


def analysis_history(analyses: DataFrame) -> DataFrame:
    return analyses.withColumn("n_picks", F.coalesce(F.json_array_length("picks_json"), F.lit(0))).drop("picks_json")
