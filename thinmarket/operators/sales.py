"""Aggregates over sales, the largest table. Nothing here gathers one card's sales in a task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd, safe_div


#: Bands of a price range: so many to a factor of e. A band is about a thousandth of the price wide.
BANDS_PER_E = 1024


def value_band(value: Column) -> Column:
    """A whole number that never falls as the value rises; equal values share it.

    The logarithm never falls either, so bands are exact in order whatever its last digit is. The offset
    is beyond every logarithm of a double; NaN is the largest.
    """
    far = 2_000_000
    log = lambda v: F.floor(F.least(F.ln(v) * BANDS_PER_E, F.lit(float(far)))).cast("int")
    return F.when(F.isnan(value), 3 * far).when(value > 0, far + log(value)).when(value < 0, -(far + log(-value))).otherwise(0)


def value_counts(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """Rows per (group, band, value), a count for each filter."""
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("__band", value_band(F.col(value)))
        .groupBy(*keys, "__band", value)
        .agg(*[F.count_if(cond).alias(f"{m}__c") for m, cond in measures.items()])
    )


def grouped_medians(
    df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]
) -> DataFrame:
    """Exact count, mean, min, max, true median and upper median per group for several filters.

    Rows are first counted per (group, value), which spreads a hot group over all tasks and
    shrinks it to its distinct prices. These are counted by band of value; a running sum over a
    group's bands, some thousand at most, tells which band holds each middle rank, and only the
    values of those bands are sorted, by (group, band). So no task sorts a group, even if one
    group holds most rows and all its prices differ.
    """
    return medians_of_counts(value_counts(df, keys, value, measures), keys, value, list(measures))


def medians_of_counts(counted: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """The second half of ``grouped_medians``, over rows of ``value_counts``."""
    v = F.col(value)
    per_band = [
        a
        for m in measures
        for a in (
            F.sum(f"{m}__c").alias(f"{m}__c"), F.sum(v * F.col(f"{m}__c")).alias(f"{m}__s"),
            F.min(F.when(F.col(f"{m}__c") > 0, v)).alias(f"{m}_min"), F.max(F.when(F.col(f"{m}__c") > 0, v)).alias(f"{m}_max"),
        )
    ]
    bands = counted.groupBy(*keys, "__band").agg(*per_band)
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("__band").rowsBetween(Window.unboundedPreceding, 0)
    for m in measures:
        bands = bands.withColumn(f"{m}__cum", F.sum(f"{m}__c").over(ordered)).withColumn(f"{m}__n", F.sum(f"{m}__c").over(whole))
    told, marks = [], []
    for m in measures:
        c, cum, n = F.col(f"{m}__c"), F.col(f"{m}__cum"), F.col(f"{m}__n")
        told += [F.max(n).alias(f"{m}_count"), safe_div(F.sum(f"{m}__s"), F.max(n)).alias(f"{m}_mean"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
        for which, rank in (("low", F.floor((n + 1) / 2)), ("high", F.floor(n / 2) + 1)):
            # The rank counted from the band's first value, where the band holds it.
            marks.append(F.when((cum >= rank) & (cum - c < rank), rank - (cum - c)).alias(f"{m}__{which}"))
    groups = bands.groupBy(*keys).agg(*told)
    names = [f"{m}__{which}" for m in measures for which in ("low", "high")]
    middle = bands.select(*keys, "__band", *marks).filter(F.coalesce(*[F.col(x) for x in names]).isNotNull())

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    near = counted.alias("l").join(middle.alias("r"), reduce(and_, [*same, F.col("l.__band") == F.col("r.__band")])).select("l.*", *[F.col(f"r.{x}") for x in names])
    inside = Window.partitionBy(*keys, "__band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    for m in measures:
        near = near.withColumn(f"{m}__cum", F.sum(f"{m}__c").over(inside))
    at = lambda m, which: F.min(F.when((F.col(f"{m}__c") > 0) & (F.col(f"{m}__cum") >= F.col(f"{m}__{which}")), v))
    picked = near.groupBy(*keys).agg(*[at(m, which).alias(f"{m}__{which}") for m in measures for which in ("low", "high")])
    out = groups.alias("l").join(picked.alias("r"), reduce(and_, same), "left")
    columns = [
        c
        for m in measures
        for c in (
            *[F.col(f"l.{m}_{x}") for x in ("count", "mean", "min", "max")], ((F.col(f"r.{m}__low") + F.col(f"r.{m}__high")) / 2).alias(f"{m}_median"), F.col(f"r.{m}__high").alias(f"{m}_upper"),
        )
    ]
    return out.select(*[F.col(f"l.{k}") for k in keys], *columns)


def since(as_of: Column, days: int, col: str = "order_date") -> Column:
    """Whether a time lies within so many days before ``as_of``; the bare column is compared, so that the scan can skip the rest."""
    return F.col(col) >= F.date_sub(as_of, days).cast("timestamp")


def sales_window_stats(sales: DataFrame, as_of: Column) -> DataFrame:
    """Counts, means, medians and range for 7, 30 and 90 days with the sales trend."""
    stats = grouped_medians(
        sales.filter(since(as_of, 90)), ["card_id"], "purchase_price",
        {f"d{d}": since(as_of, d) for d in (7, 30, 90)},
    )
    per_month = F.col("d90_count") / 3
    ratio = safe_div(F.col("d30_count"), per_month)
    trend = (
        F.when(ratio >= 1.5, "accelerating").when(ratio >= 0.8, "stable")
        .when(ratio >= 0.5, "decelerating").otherwise("drying_up")
    )
    return stats.withColumn("trend", trend)


def median_sold(sales: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """True median and count of positive prices of the last ``days`` days."""
    recent = sales.filter(since(as_of, days) & (F.col("purchase_price") > 0))
    out = grouped_medians(recent, ["card_id"], "purchase_price", {"s": F.lit(True)})
    return out.select("card_id", F.col("s_median").alias("median_sold"), F.col("s_count").alias("n_sales"))


def sales_counts(sales: DataFrame, as_of: Column) -> DataFrame:
    return sales.filter(since(as_of, 90)).groupBy("card_id").agg(
        F.count_if(since(as_of, 30)).alias("sales_30d"), F.count("*").alias("sales_90d")
    )


def sales_profile(sales: DataFrame, as_of: Column) -> DataFrame:
    """30 and 90 day counts with the true 90-day median of positive prices, in one pass."""
    positive = F.col("purchase_price") > 0
    out = grouped_medians(
        sales.filter(since(as_of, 90)), ["card_id"], "purchase_price",
        {"a": since(as_of, 30), "b": F.lit(True), "p": positive},
    )
    return out.select(
        "card_id", F.col("a_count").alias("sales_30d"), F.col("b_count").alias("sales_90d"),
        F.col("p_median").alias("median_sold"), F.col("p_count").alias("n_positive"),
        F.col("b_mean").alias("avg_sale"),
    )


def vwap(sales: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    price, qty = F.col("purchase_price"), F.col("quantity")
    return (
        sales.filter(since(as_of, days) & (price > 0)).groupBy("card_id")
        .agg(safe_div(F.sum(price * qty), F.sum(qty)).alias("vwap"), F.count("*").alias("n_sales"))
    )


def velocity_zscore(sales: DataFrame, cards: DataFrame, as_of: Column, buckets: int = 13) -> DataFrame:
    """Sales per day of the newest week against the twelve weeks before.

    Counts are pivoted into a fixed set of columns, so empty weeks count as zero.
    """
    back = F.datediff(as_of, F.to_date("order_date"))
    # Bucket b holds the days [7b, 7b+7) counted back from the end of as_of.
    bucket = F.floor(back / 7)
    counts = (
        sales.filter((back >= 0) & (back < 7 * buckets)).groupBy("card_id")
        .agg(*[F.count_if(bucket == b).alias(f"b{b}") for b in range(buckets)])
    )
    all_cards = cards.select("card_id").join(counts, "card_id", "left").na.fill(0)
    rates = [F.col(f"b{b}") / 7.0 for b in range(1, buckets)]
    mean = sum(rates[1:], rates[0]) / len(rates)
    squares = [(r - mean) * (r - mean) for r in rates]
    std = F.greatest(F.sqrt(sum(squares[1:], squares[0]) / (len(rates) - 1)), F.lit(0.01))
    now = F.col("b0") / 7.0
    return all_cards.select(
        "card_id", now.alias("velocity"), mean.alias("mean_velocity"), std.alias("std_velocity"),
        ((now - mean) / std).alias("z_score"),
    )


def liquidity_data(sales: DataFrame, cards: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Units sold per day and the true median sold, falling back on the current price.

    One pass: units are summed per price together with the counts that give the median.
    """
    recent = sales.filter(since(as_of, days))
    per_price = recent.groupBy("card_id", "purchase_price").agg(
        F.sum("quantity").alias("units"), F.count_if(F.col("purchase_price") != 0).alias("c")
    )
    w = Window.partitionBy("card_id")
    cum = F.sum("c").over(w.orderBy("purchase_price").rowsBetween(Window.unboundedPreceding, 0))
    ranked = per_price.withColumn("cum", cum).withColumn("n", F.sum("c").over(w))
    low = F.min(F.when(F.col("cum") >= F.floor((F.col("n") + 1) / 2), F.col("purchase_price")))
    high = F.min(F.when(F.col("cum") >= F.floor(F.col("n") / 2) + 1, F.col("purchase_price")))
    stats = ranked.groupBy("card_id").agg(F.sum("units").alias("units"), ((low + high) / 2).alias("median"))
    return cards.select("card_id", "current_price").join(stats, "card_id", "left").select(
        "card_id",
        rnd(F.coalesce("units", F.lit(0)) / float(days), 3).alias("sales_per_day"),
        rnd(F.coalesce("median", "current_price")).alias("median_sold"),
    )


def spread_vs_median(cards: DataFrame, sales: DataFrame, as_of: Column) -> DataFrame:
    """Distance of the current price from the true 90-day median, in percent."""
    recent = sales.filter(since(as_of, 90))
    med = grouped_medians(recent, ["card_id"], "purchase_price", {"s": F.lit(True)})
    spread = F.abs(F.col("current_price") - F.col("s_median")) / F.col("s_median") * 100
    return cards.join(med.select("card_id", "s_median"), "card_id").select(
        "card_id", "current_price", F.col("s_median").alias("median_sold"),
        F.when(F.col("s_median") > 0, spread).alias("spread_pct"),
    )


def condition_pricing(sales: DataFrame) -> DataFrame:
    """True median per condition after dropping lower-condition sales that look like errors.

    Sales are counted by value before they meet their card's median, so the counting is spread over
    (card, condition, value) and no task holds the values of its cards next to their bands.
    """
    cond = F.coalesce("condition", F.lit("Unknown"))
    rows = sales.select("card_id", cond.alias("condition"), "purchase_price")
    counted = value_counts(rows, ["card_id", "condition"], "purchase_price", {"c": F.lit(True)})
    mint = counted.filter(F.col("condition") == "Near Mint")
    nm = medians_of_counts(mint, ["card_id"], "purchase_price", ["c"]).select("card_id", F.col("c_median").alias("nm_median"))
    joined = counted.join(nm, "card_id", "left")
    odd = (
        (F.coalesce("nm_median", F.lit(0.0)) >= 10) & F.col("condition").isin(*LOWER_CONDITIONS)
        & (F.col("purchase_price") < F.col("nm_median") * 0.2)
    )
    stats = medians_of_counts(joined.filter(~odd), ["card_id", "condition", "nm_median"], "purchase_price", ["c"])
    order = F.create_map(*[F.lit(x) for kv in CONDITION_ORDER.items() for x in kv])
    weak = (
        (F.col("nm_median") >= 10) & (F.col("condition") != "Near Mint")
        & (F.col("c_median") < F.col("nm_median") * 0.3) & (F.col("c_count") < 5)
    )
    return stats.select(
        "card_id", "condition", F.col("c_median").alias("median_price"), F.col("c_count").alias("n_sales"),
        F.coalesce(weak, F.lit(False)).alias("is_outlier"),
        F.coalesce(F.try_element_at(order, F.col("condition")), F.lit(99)).alias("position"),
    )


def sale_gap_stats(sales: DataFrame, as_of: Column) -> DataFrame:
    """Mean days between consecutive sales: the span divided by the gaps, so no sort is needed."""
    span = (F.unix_micros(F.max("order_date")) - F.unix_micros(F.min("order_date"))) / 86400e6
    return sales.groupBy("card_id").agg(
        F.when(F.count("*") >= 2, span / (F.count("*") - 1)).alias("avg_gap_days"),
        F.count_if(since(as_of, 30)).alias("sales_30d"), F.count_if(since(as_of, 90)).alias("sales_90d"),
    )


def daily_upper_median(sales: DataFrame) -> DataFrame:
    rows = sales.select("card_id", F.to_date("order_date").alias("date"), "purchase_price")
    out = grouped_medians(rows, ["card_id", "date"], "purchase_price", {"m": F.lit(True)})
    return out.select("card_id", "date", F.col("m_upper").alias("daily_median"))


def newest_sales(sales: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` sales per card.

    The rank filter becomes a group limit before the shuffle, so a hot card sends at most
    ``limit`` rows per map task.
    """
    w = Window.partitionBy("card_id").orderBy(
        F.desc("order_date"), F.desc("seq"), F.desc("item_id"), F.desc("purchase_price")
    )
    return sales.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


# Display order of conditions.
CONDITION_ORDER = {
    "Near Mint": 0,
    "Lightly Played": 1,
    "Moderately Played": 2,
    "Heavily Played": 3,
    "Damaged": 4,
}
LOWER_CONDITIONS = ("Lightly Played", "Moderately Played", "Heavily Played", "Damaged")
