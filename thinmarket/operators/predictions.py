"""Predictions: back-filled prices, outcomes and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions.numeric import pct_change, rnd
from thinmarket.operators import series as S

HORIZONS = (7, 14, 30, 60, 90)
RETURN_HORIZONS = (7, 30, 90)


def backfill_predictions(predictions: DataFrame, series: DataFrame, cards: DataFrame, as_of: Column) -> DataFrame:
    """All predictions, the pending ones with prices at elapsed horizons, returns and outcome.

    Takes first and later runs alike: columns that are not there yet count as empty, a filled horizon
    keeps its price and return, and a row with an outcome other than pending stays as it is.
    """
    made = {**{f"price_{h}d": "double" for h in HORIZONS}, **{f"return_pct_{h}d": "double" for h in RETURN_HORIZONS}, "outcome": "string"}
    old = predictions.withColumns({c: F.lit(None).cast(kind) for c, kind in made.items() if c not in predictions.columns})
    is_open = F.coalesce("outcome", F.lit("pending")) == "pending"
    daily = S.daily_prices(series, ["card_id"])

    def raw(h: int) -> Column:
        day = F.date_add("predicted_at", h)
        return F.when(is_open & F.col(f"price_{h}d").isNull() & (day <= as_of), S.price_near(day, 3)).alias(f"raw_{h}")

    wide = old.join(daily, "card_id", "left").select(*old.columns, *[raw(h) for h in HORIZONS])
    rows = wide.join(cards.select("card_id", F.col("current_price").alias("price_now")), "card_id", "left")
    filled = {f"price_{h}d": F.coalesce(f"price_{h}d", rnd(F.col(f"raw_{h}"))) for h in HORIZONS}
    filled |= {f"return_pct_{h}d": F.coalesce(f"return_pct_{h}d", rnd(pct_change(F.col(f"raw_{h}"), F.col("entry_price")))) for h in RETURN_HORIZONS}
    ret30 = F.col("return_pct_30d")
    rising = F.col("signal").isin("buy", "accumulate")
    at_30 = (
        F.when(rising, F.when(ret30 > 0, "correct").otherwise("incorrect"))
        .when(F.col("signal") == "hold", F.when(F.abs(ret30) < 10, "correct").otherwise("incorrect"))
        .when(F.col("signal") == "watch", "expired")
    )
    hit = (
        F.when(F.col("price_now") <= F.col("stop_loss"), "incorrect")
        .when(F.col("price_now") >= F.col("target_price"), "correct").otherwise("pending")
    )
    outcome = F.when(~is_open, F.col("outcome")).otherwise(F.coalesce(F.when(F.col("price_30d").isNotNull(), at_30), hit))
    return rows.withColumns(filled).withColumn("outcome", outcome).select(*predictions.columns, *[c for c in made if c not in predictions.columns])


def accuracy_report(done: DataFrame) -> DataFrame:
    """Hit rates overall, by source and by signal in one grouping-sets pass.

    Predictions are first counted by source, signal and return, which keeps the first id of each; only these
    counts are repeated for the grouping sets and sorted for the best and the worst.
    """
    resolved = done.filter(F.col("outcome").isin("correct", "incorrect"))
    counted = resolved.groupBy("source", "signal", "return_pct_30d").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "correct").alias("right"), F.min("prediction_id").alias("first_id")
    )
    by = counted.groupingSets([[], ["source"], ["signal"]], "source", "signal")
    best = F.struct("return_pct_30d", (-F.col("first_id")).alias("k"))
    worst = F.struct("return_pct_30d", "first_id")
    known = F.col("return_pct_30d").isNotNull()
    return by.agg(
        F.sum("n").alias("resolved"),
        F.sum("right").alias("correct"),
        rnd(F.sum("right") / F.sum("n") * 100, 1).alias("hit_rate"),
        F.max_by(F.when(known, F.col("first_id")), F.when(known, best)).alias("best_id"),
        F.min_by(F.when(known, F.col("first_id")), F.when(known, worst)).alias("worst_id"),
    )


def newest_predictions(done: DataFrame, cards: DataFrame, limit: int = 20) -> DataFrame:
    """The report's list of the newest predictions, open ones as well, with their cards' names and prices.

    The cut is made before the cards are read; a prediction without a card keeps null names.
    """
    newest = done.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).limit(limit)
    return newest.join(cards.select("card_id", "name", "current_price"), "card_id", "left").select(
        "prediction_id", "card_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "signal", "source", "entry_price", "current_price", "target_price", "stop_loss",
        *[f"return_pct_{h}d" for h in RETURN_HORIZONS], "outcome", "predicted_at",
    )


def auto_predictions(hot: DataFrame, predictions: DataFrame, as_of: Column) -> DataFrame:
    """New rows from the most active cards that signal something and have no pending row."""
    pending = predictions.filter("outcome = 'pending'").select("card_id")
    return hot.filter("signal <> 'hold'").join(pending, "card_id", "left_anti").select(
        "card_id", "signal", F.lit("signal_engine").alias("source"), F.col("current_price").alias("entry_price"), as_of.alias("predicted_at")
    )


def target_stop_hits(predictions: DataFrame, cards: DataFrame) -> DataFrame:
    price = F.col("current_price")
    target = F.coalesce(price >= F.col("target_price"), F.lit(False))
    stop = F.coalesce(price <= F.col("stop_loss"), F.lit(False))
    return (
        predictions.filter("outcome = 'pending'").join(cards.filter("current_price > 0").select("card_id", "name", "current_price"), "card_id")
        .filter(target | stop)
        .select(
            "prediction_id", "card_id", "name", F.when(target, "milestone").otherwise("warning").alias("type"),
            F.when(target, "notable").otherwise("urgent").alias("severity"),
        )
    )


def prediction_status(done: DataFrame, insights: DataFrame) -> DataFrame:
    counts = done.agg(
        F.count_if(F.col("outcome") == "pending").alias("pending"), F.count("*").alias("total"),
        F.count_if(F.col("outcome").isin("correct", "incorrect")).alias("resolved"),
        rnd(F.count_if(F.col("outcome") == "correct") / F.nullif(F.count_if(F.col("outcome").isin("correct", "incorrect")), F.lit(0)) * 100, 1).alias("hit_rate"),
    )
    return counts.withColumn("unread", insights.filter("NOT acknowledged").agg(F.count("*")).scalar())
