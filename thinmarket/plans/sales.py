"""Sales, liquidity and trading economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions.numeric import rnd
from thinmarket.operators import economics as O
from thinmarket.operators import sales as A
from thinmarket.plans.indicators import breakeven_sql, liquidity_sql, r4, time_to_sell_sql
from thinmarket.plans.registry import query, view

view("sday", "SELECT s.*, CAST(order_date AS DATE) AS od, d FROM sales s, as_of")


def _window_sql(days: int) -> str:
    f = f"FILTER (WHERE od >= d - {days})"
    return f"""count(*) {f} AS d{days}_count, R4(avg(purchase_price) {f}) AS d{days}_mean, R4(min(purchase_price) {f}) AS d{days}_min,
      R4(max(purchase_price) {f}) AS d{days}_max, R4(quantile_cont(purchase_price, 0.5) {f}) AS d{days}_median,
      R4((list_sort(list(purchase_price) {f}))[CAST(floor(count(*) {f} / 2) AS INT) + 1]) AS d{days}_upper"""


@query("sales_window_stats", f"""
  SELECT *, CASE WHEN d30_count * 3 >= d90_count * 1.5 THEN 'accelerating' WHEN d30_count * 3 >= d90_count * 0.8 THEN 'stable'
      WHEN d30_count * 3 >= d90_count * 0.5 THEN 'decelerating' ELSE 'drying_up' END AS trend
  FROM (SELECT card_id, {_window_sql(7)}, {_window_sql(30)}, {_window_sql(90)} FROM sday WHERE od >= d - 90 GROUP BY 1)""")
def sales_window_stats(t):
    return r4(A.sales_window_stats(t.sales, t.as_of))


@query("median_sold", """SELECT card_id, R4(quantile_cont(purchase_price, 0.5)) AS median_sold, count(*) AS n_sales
  FROM sday WHERE od >= d - 90 AND purchase_price > 0 GROUP BY 1""")
def median_sold(t):
    return r4(A.median_sold(t.sales, t.as_of))


@query("vwap", """SELECT card_id, R4(sum(purchase_price * quantity) / sum(quantity)) AS vwap, count(*) AS n_sales
  FROM sday WHERE od >= d - 30 AND purchase_price > 0 GROUP BY 1""")
def vwap(t):
    return r4(A.vwap(t.sales, t.as_of))


view("velz", """
  SELECT card_id, max(v) FILTER (WHERE b = 0) AS velocity, avg(v) FILTER (WHERE b > 0) AS mean_velocity,
         greatest(stddev_samp(v) FILTER (WHERE b > 0), 0.01) AS std_velocity
  FROM (SELECT c.card_id, g.b, count(s.od) / 7e0 AS v FROM catalogue c CROSS JOIN (SELECT unnest(range(13)) AS b) g
        LEFT JOIN sday s ON s.card_id = c.card_id AND (s.d - s.od) // 7 = g.b GROUP BY 1, 2) GROUP BY 1""")


@query("velocity_zscore", """SELECT card_id, R4(velocity) AS velocity, R4(mean_velocity) AS mean_velocity, R4(std_velocity) AS std_velocity,
  R4((velocity - mean_velocity) / std_velocity) AS z_score FROM velz""")
def velocity_zscore(t):
    return r4(A.velocity_zscore(t.sales, t.catalogue, t.as_of))


view("liqd", """
  SELECT c.card_id, R3(coalesce(units, 0) / 30e0) AS sales_per_day, R2(coalesce(med, current_price)) AS median_sold
  FROM cards c LEFT JOIN (SELECT card_id, sum(quantity) AS units, quantile_cont(purchase_price, 0.5) FILTER (WHERE purchase_price <> 0) AS med
    FROM sday WHERE od >= d - 30 GROUP BY 1) s ON s.card_id = c.card_id""")


@query("liquidity_data", "SELECT * FROM liqd")
def liquidity_data(t):
    return A.liquidity_data(t.sales, t.cards, t.as_of)


view("econ", """SELECT card_id, name, current_price, coalesce(s30, 0) AS s30, coalesce(s90, 0) AS s90, med,
    abs(current_price - med) / med * 100 AS spread_pct FROM cards LEFT JOIN prof USING (card_id) WHERE current_price > 0""")


def econ(t):
    return O.card_economics(t.cards, t.sales, t.as_of)


@query("liquidity_score", f"SELECT card_id, s90 AS sales_90d, s30 AS sales_30d, {liquidity_sql('s90', 's30', 'current_price', 'spread_pct')} AS liquidity_score FROM econ")
def liquidity_score(t):
    score = E.liquidity_score(F.col("sales_90d"), F.col("sales_30d"), F.col("current_price"), F.col("spread_pct"))
    return econ(t).select("card_id", "sales_90d", "sales_30d", score.alias("liquidity_score"))


@query("time_to_sell", f"""SELECT card_id, {time_to_sell_sql('current_price', 's90', 's30')} AS estimated_days,
  CASE WHEN s90 >= 10 THEN 'high' WHEN s90 >= 3 THEN 'medium' WHEN s90 > 0 THEN 'low' ELSE 'none' END AS confidence,
  CASE WHEN current_price < 5 THEN 'bulk' WHEN current_price < 20 THEN 'low' WHEN current_price < 100 THEN 'mid' WHEN current_price < 500 THEN 'high' ELSE 'premium' END AS price_tier
  FROM econ""")
def time_to_sell(t):
    parts = E.time_to_sell(F.col("current_price"), F.col("sales_90d"), F.col("sales_30d"))
    return econ(t).select("card_id", *[c.alias(n) for n, c in parts.items()])


def proceeds_sql(p: str, rate1: float, rate2: float) -> str:
    fees = f"({p} * {rate1}e0 + {p} * {rate2}e0 + 0.3e0 + 4.5e0)"
    return f"""R2({p} * {rate1}e0) AS commission, R2({p} * {rate2}e0 + 0.3e0) AS processing, 4.5e0 AS shipping,
      R2({p} - {fees}) AS net_proceeds, R2({fees}) AS total_fees, R1(CASE WHEN {p} > 0 THEN {fees} / {p} * 100 ELSE 100 END) AS total_fee_pct"""


@query("sell_proceeds", f"SELECT l_orderkey * 8 + l_linenumber AS seq, l_partkey AS item_id, R4(p) AS price, {proceeds_sql('p', 0.13, 0.029)} FROM (SELECT *, l_extendedprice / 100 AS p FROM lineitem)")
def sell_proceeds(t):
    p = F.col("purchase_price")
    return t.sales.select("seq", "item_id", rnd(p, 4).alias("price"), *[c.alias(n) for n, c in E.sell_proceeds(p, "ebay").items()])


view("firstlast", "SELECT card_id, arg_min(price, date) AS buy, arg_max(price, date) AS sell, CAST(max(date) - min(date) AS INT) AS days FROM series GROUP BY 1")
_NET = "R2(sell - (sell * 0.1075e0 + sell * 0.025e0 + 0.3e0 + 4.5e0))"


@query("roundtrip_pnl", f"""SELECT card_id, R2(buy) AS acquisition_cost, R2(sell - buy) AS gross_pnl, R2({_NET} - R2(buy)) AS net_pnl,
  R2(sell * 0.1075e0 + sell * 0.025e0 + 0.3e0 + 4.5e0) AS total_fees, R1(({_NET} - R2(buy)) / R2(buy) * 100) AS net_return_pct FROM firstlast""")
def roundtrip_pnl(t):
    ends = O.first_last(t.series)
    return ends.select("card_id", *[c.alias(n) for n, c in E.roundtrip_pnl(F.col("buy"), F.col("sell")).items()])


@query("breakeven", f"SELECT card_id, date::VARCHAR AS date, {breakeven_sql('price')} AS breakeven_pct FROM series")
def breakeven(t):
    return t.series.select("card_id", "date", E.breakeven(F.col("price")).alias("breakeven_pct"))


@query("fee_schedule", f"""
  SELECT card_id, 'tcgplayer' AS platform, R2(current_price) AS price, {proceeds_sql('current_price', 0.1075, 0.025)}, {breakeven_sql('current_price')} AS breakeven_pct FROM cards WHERE current_price > 0
  UNION ALL SELECT card_id, 'ebay', R2(current_price), {proceeds_sql('current_price', 0.13, 0.029)}, R1(((current_price + 4.8e0) / 0.841e0 - current_price) / current_price * 100) FROM cards WHERE current_price > 0""")
def fee_schedule(t):
    return O.fee_schedule(t.cards.filter("current_price > 0").select("card_id", F.col("current_price").alias("price")))


@query("hold_economics", f"""
  WITH x AS (SELECT *, R2({_NET} - R2(buy)) AS npnl, R1(({_NET} - R2(buy)) / R2(buy) * 100) AS net_return_pct FROM firstlast)
  SELECT card_id, CASE WHEN days < 30 THEN 'short' WHEN days <= 180 THEN 'medium' ELSE 'long' END AS hold_period,
    R1((sell - buy) / buy * 100) AS gross_appreciation_pct, net_return_pct,
    R1(CASE WHEN days > 0 THEN CASE WHEN sell / buy > 0 THEN ((sell / buy) ** (365e0 / days) - 1) * 100 ELSE -100 END ELSE 0 END) AS annualized_gross_pct,
    R1(CASE WHEN days > 0 THEN CASE WHEN npnl / buy > -1 THEN ((1 + npnl / buy) ** (365e0 / days) - 1) * 100 ELSE -100 END ELSE 0 END) AS annualized_net_pct,
    {breakeven_sql('buy')} AS breakeven_pct, (sell - buy) / buy * 100 > {breakeven_sql('buy')} AS clears_hurdle FROM x""")
def hold_economics(t):
    parts = E.hold_economics(F.col("buy"), F.col("sell"), F.col("days"))
    return O.first_last(t.series).select("card_id", *[c.alias(n) for n, c in parts.items()])


@query("viable_trade", "SELECT item_id, count(*) FILTER (WHERE purchase_price >= 20) AS viable, count(*) AS n_sales FROM sales GROUP BY 1")
def viable_trade(t):
    return t.sales.groupBy("item_id").agg(F.count_if(E.viable_trade(F.col("purchase_price"))).alias("viable"), F.count("*").alias("n_sales"))


def slippage_sql(p: str, v: str) -> str:
    return f"""CASE WHEN {p} <= 0 THEN 8e0 WHEN {v} < 0.1 THEN 8 - {v} / 0.1e0 * 3 WHEN {v} < 0.3 THEN 5 - ({v} - 0.1e0) / 0.2e0 * 2
      WHEN {v} < 1 THEN 3 - ({v} - 0.3e0) / 0.7e0 * 1.5e0 WHEN {v} < 3 THEN 1.5e0 - ({v} - 1) / 2 ELSE 0.5e0 END"""


@query("slippage", f"SELECT c.card_id, sales_per_day, R4({slippage_sql('current_price', 'sales_per_day')}) AS slippage_pct FROM cards c JOIN liqd USING (card_id)")
def slippage(t):
    rows = A.liquidity_data(t.sales, t.cards, t.as_of).join(t.cards.select("card_id", "current_price"), "card_id")
    return rows.select("card_id", "sales_per_day", rnd(E.slippage_pct(F.col("current_price"), F.col("sales_per_day")), 4).alias("slippage_pct"))


@query("spread_vs_median", """SELECT card_id, current_price, R4(m) AS median_sold, R4(abs(current_price - m) / m * 100) AS spread_pct
  FROM cards JOIN (SELECT card_id, quantile_cont(purchase_price, 0.5) AS m FROM sday WHERE od >= d - 90 GROUP BY 1) USING (card_id)""")
def spread_vs_median(t):
    return r4(A.spread_vs_median(t.cards, t.sales, t.as_of), "card_id", "median_sold", "spread_pct").join(
        t.cards.select("card_id", "current_price"), "card_id"
    )


view("condp", """
  SELECT card_id, condition, quantile_cont(purchase_price, 0.5) AS med, count(*) AS k, any_value(nm) AS nm FROM (
    SELECT s.*, nm FROM sales s LEFT JOIN (SELECT card_id AS nid, quantile_cont(purchase_price, 0.5) AS nm FROM sales WHERE condition = 'Near Mint' GROUP BY 1) ON nid = s.card_id)
  WHERE NOT (coalesce(nm, 0) >= 10 AND condition <> 'Near Mint' AND purchase_price < 0.2 * nm) GROUP BY 1, 2""")


@query("condition_pricing", """SELECT card_id, condition, R4(med) AS median_price, k AS n_sales,
  coalesce(nm >= 10 AND condition <> 'Near Mint' AND med < 0.3 * nm AND k < 5, FALSE) AS is_outlier,
  CASE condition WHEN 'Near Mint' THEN 0 WHEN 'Lightly Played' THEN 1 ELSE 99 END AS position FROM condp""")
def condition_pricing(t):
    return r4(A.condition_pricing(t.sales))


@query("sale_gap_stats", """SELECT card_id, R4(CASE WHEN count(*) >= 2 THEN avg(gap) END) AS avg_gap_days, count(*) FILTER (WHERE od >= d - 30) AS sales_30d,
  count(*) FILTER (WHERE od >= d - 90) AS sales_90d
  FROM (SELECT *, (epoch_us(order_date) - lag(epoch_us(order_date)) OVER (PARTITION BY card_id ORDER BY order_date)) / 86400e6 AS gap FROM sday) GROUP BY 1""")
def sale_gap_stats(t):
    return r4(A.sale_gap_stats(t.sales, t.as_of))


@query("graded_value", """
  SELECT card_id, grade, R4(med) AS nm_median, mult, R4(med * mult) AS est_value, R4((med * mult - med - 35) / (med + 35) * 100) AS grade_roi FROM (
    SELECT card_id, med, unnest([10, 9, 8])::INT AS grade,
      unnest(CASE WHEN med > 100 THEN [5e0, 2.5e0, 1.5e0] WHEN med >= 20 THEN [4e0, 2e0, 1.3e0] ELSE [3e0, 1.5e0, 1.2e0] END) AS mult
    FROM condp WHERE condition = 'Near Mint' AND med > 0)""")
def graded_value(t):
    return r4(O.graded_value(t.sales))


@query("price_zone", """SELECT card_id, CASE WHEN med * 0.8745e0 > current_price THEN 'BUY ZONE' WHEN (current_price / med - 1) * 100 > 50 THEN 'OVERPRICED'
    WHEN (current_price / med - 1) * 100 > 20 THEN 'FAIR VALUE' ELSE 'TIGHT SPREAD' END AS zone, s30 / 30e0 < 0.5 AS low_liquidity
  FROM econ WHERE med > 0""")
def price_zone(t):
    return econ(t).filter("median_sold > 0").select(
        "card_id", E.price_zone(F.col("current_price"), F.col("median_sold")).alias("zone"),
        (F.col("sales_30d") / 30.0 < 0.5).alias("low_liquidity"),
    )
