"""Economics over tables: the expressions of ``functions.economics`` applied to whole inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.operators import sales as A
from thinmarket.operators.panel import with_sales

# Graded estimates as multiples of the ungraded median, by price band.
GRADES = (10, 9, 8)
GRADE_MULTIPLIERS = {"over_100": (5.0, 2.5, 1.5), "from_20": (4.0, 2.0, 1.3), "below": (3.0, 1.5, 1.2)}
GRADING_COST = 35.0


def card_economics(cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Priced cards with sales counts, the true median and the spread to it."""
    rows = with_sales(cards.filter("current_price > 0").select("card_id", "name", "current_price"), sales, as_of)
    spread = F.abs(F.col("current_price") - F.col("median_sold")) / F.col("median_sold") * 100
    return rows.withColumn("spread_pct", F.when(F.col("median_sold") > 0, spread))


def first_last(series: DataFrame) -> DataFrame:
    """First and last price of each card and the days between them."""
    return series.groupBy("card_id").agg(
        F.min_by("price", "date").alias("buy"), F.max_by("price", "date").alias("sell"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
    )


def fee_schedule(prices: DataFrame, platforms: tuple[str, ...] = tuple(E.PLATFORMS)) -> DataFrame:
    """Every price on every platform. Platforms are a fixed pair, so each is one projection."""
    def one(platform: str) -> DataFrame:
        price = F.col("price")
        parts = {**E.sell_proceeds(price, platform), "breakeven_pct": E.breakeven(price, platform)}
        return prices.select("card_id", F.lit(platform).alias("platform"), "price", *[c.alias(n) for n, c in parts.items()])

    return reduce(DataFrame.unionByName, [one(p) for p in platforms])


def graded_value(sales: DataFrame) -> DataFrame:
    """Estimated value and return of grading, from the Near Mint median."""
    nm = A.grouped_medians(sales.filter(F.col("condition") == "Near Mint"), ["card_id"], "purchase_price", {"nm": F.lit(True)})
    median = F.col("nm_median")

    def table(band: str) -> Column:
        return F.array(*[F.struct(F.lit(g).alias("grade"), F.lit(m).alias("mult")) for g, m in zip(GRADES, GRADE_MULTIPLIERS[band])])

    grades = F.when(median > 100, table("over_100")).when(median >= 20, table("from_20")).otherwise(table("below"))
    rows = nm.filter(median > 0).select("card_id", median.alias("nm_median"), F.inline(grades))
    value = F.col("nm_median") * F.col("mult")
    return rows.select(
        "card_id", "grade", "nm_median", "mult", value.alias("est_value"),
        ((value - F.col("nm_median") - GRADING_COST) / (F.col("nm_median") + GRADING_COST) * 100).alias("grade_roi"),
    )
