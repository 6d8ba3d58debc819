"""Appreciation, cached metrics, screener and flips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import screener as G
from thinmarket.plans.indicators import breakeven_sql, liquidity_sql, r4, time_to_sell_sql, trajectory_sql
from thinmarket.plans.registry import query, view
from thinmarket.session import checkpoint_root

APP_SCORE = """R1(least(100, greatest(0, CASE WHEN r >= 0.5 THEN r * 40 WHEN r >= 0.3 THEN (r - 0.3e0) / 0.2e0 * 20 ELSE 0 END
   + CASE WHEN s > 0 THEN least(35, s * 175) ELSE 0 END + CASE WHEN w >= 55 THEN least(25, (w - 50) * 2.5e0) WHEN w >= 45 THEN 5 ELSE 0 END)))"""


def appreciation_sql(src: str) -> str:
    return f"""
  SELECT card_id, R4(s) AS appreciation_slope, R4(r) AS appreciation_consistency, R1(w) AS appreciation_win_rate, CASE WHEN s IS NOT NULL THEN {APP_SCORE} END AS appreciation_score
  FROM (SELECT card_id, CASE WHEN n >= 30 THEN (exp(sl) - 1) * 100 END AS s, CASE WHEN n >= 30 THEN greatest(0, least(1, r2)) END AS r, CASE WHEN n >= 30 THEN wins * 100e0 / steps END AS w
    FROM (SELECT card_id, count(*) AS n, regr_slope(ln(price), x) AS sl, regr_r2(ln(price), x) AS r2, count(pp) AS steps, count(*) FILTER (WHERE price > pp) AS wins
      FROM (SELECT *, date - min(date) OVER (PARTITION BY card_id) AS x, lag(price) OVER (PARTITION BY card_id ORDER BY date) AS pp FROM {src}) GROUP BY 1))"""


view("own", """SELECT p.* FROM price_history p JOIN cards c ON c.card_id = p.card_id AND (c.price_variant IS NULL OR c.price_variant = p.variant)
  WHERE is_tracked AND current_price >= 2""")
view("own_ser", """
  SELECT card_id, date, price, row_number() OVER (PARTITION BY card_id ORDER BY date) AS i, count(*) OVER (PARTITION BY card_id) AS n FROM (
    SELECT card_id, date, market_price AS price FROM own QUALIFY row_number() OVER (PARTITION BY card_id, date ORDER BY seq DESC, variant DESC, condition DESC) = 1)""")
view("own_traj", trajectory_sql("own_ser"))
view("app_own", appreciation_sql("own_ser"))
view("metrics", f"""
  SELECT c.card_id, coalesce(s30, 0) AS sales_30d, coalesce(s90, 0) AS sales_90d, med AS median_sold, abs(current_price - med) / med * 100 AS spread_pct,
    {liquidity_sql("coalesce(s90, 0)", "coalesce(s30, 0)", "current_price", "(abs(current_price - med) / med * 100)")} AS liquidity_score,
    appreciation_slope, appreciation_consistency, appreciation_win_rate, appreciation_score, CASE WHEN nr >= 30 THEN adx END AS adx,
    CASE WHEN nr >= 30 THEN CASE WHEN n < 30 THEN 'unknown' WHEN n < 200 THEN CASE WHEN price > m30 * 1.05 THEN 'markup' WHEN price < m30 * 0.95 THEN 'markdown' ELSE 'accumulation' END
      WHEN coalesce(adx, 0) > 25 THEN CASE WHEN price > m200 THEN 'markup' ELSE 'markdown' END
      WHEN n >= 210 AND m200 / p200 - 1 < -0.01 THEN 'distribution' ELSE 'accumulation' END END AS regime
  FROM cards c LEFT JOIN prof p ON p.card_id = c.card_id LEFT JOIN app_own a ON a.card_id = c.card_id
  LEFT JOIN (SELECT card_id, count(*) AS nr FROM own GROUP BY 1) o ON o.card_id = c.card_id
  LEFT JOIN (SELECT * FROM (SELECT card_id, i, n, price, avg(price) OVER (w ROWS 29 PRECEDING) AS m30, avg(price) OVER (w ROWS 199 PRECEDING) AS m200,
       avg(price) OVER (w ROWS BETWEEN 209 PRECEDING AND 10 PRECEDING) AS p200 FROM own_ser WINDOW w AS (PARTITION BY card_id ORDER BY i)) WHERE i = n) z ON z.card_id = c.card_id
  LEFT JOIN (SELECT card_id, i, adx FROM own_traj) t ON t.card_id = c.card_id AND t.i = z.n
  WHERE is_tracked AND current_price >= 2""")
view("cand", f"""
  SELECT *, least(100, CASE rarity WHEN 'Illustration Rare' THEN 80 WHEN 'Ultra Rare' THEN 60 WHEN 'Rare Holo' THEN 35 ELSE 10 END)::INT AS rarity_score,
    R4(appreciation_slope - ln(1 + breakeven_pct / 100) / 365 * 100) AS breakeven_adjusted_slope, R2(sales_30d / 30e0) AS sales_per_day,
    R2(med0 - current_price * 1.1255e0) AS est_profit,
    coalesce(appreciation_score, 0) * CASE WHEN liq < 10 THEN 0.1e0 WHEN liq < 30 THEN 0.1e0 + (liq - 10) * 0.02e0 WHEN liq < 60 THEN 0.5e0 + (liq - 30) * 0.015e0 ELSE 1 END AS sort_score
  FROM (SELECT c.card_id, c.name, c.set_name, c.rarity, c.current_price, c.price_variant, m.* EXCLUDE (card_id, sales_30d, sales_90d), coalesce(sales_30d, 0) AS sales_30d,
          coalesce(sales_90d, 0) AS sales_90d, R2(median_sold) AS med0, coalesce(liquidity_score, 0) AS liq, {breakeven_sql("c.current_price")} AS breakeven_pct
        FROM cards c LEFT JOIN metrics m ON m.card_id = c.card_id WHERE is_tracked AND current_price > 0)""")


def metrics(t):
    return G.batch_metrics(t.price_history, t.cards, t.sales, t.as_of)


@query("steady_appreciation", appreciation_sql("series"))
def steady_appreciation(t):
    return G.steady_appreciation(t.series)


@query("batch_metrics", """SELECT card_id, sales_30d, sales_90d, R4(median_sold) AS median_sold, R4(spread_pct) AS spread_pct, liquidity_score, appreciation_slope,
  appreciation_consistency, appreciation_win_rate, appreciation_score, R4(adx) AS adx, regime FROM metrics""")
def batch_metrics(t):
    return r4(metrics(t))


_PAGE = f"""card_id, name, set_name, rarity, current_price, price_variant, liquidity_score, sales_per_day, {time_to_sell_sql("current_price", "sales_90d", "sales_30d")} AS days_to_sell,
  med0 AS median_sold, appreciation_slope, appreciation_consistency, appreciation_win_rate, appreciation_score, breakeven_adjusted_slope,
  CASE WHEN appreciation_slope > 0 THEN CAST(round(ln(1 + breakeven_pct / 100) / ln(1 + appreciation_slope / 100)) AS BIGINT) END AS days_to_breakeven,
  rarity_score, FALSE AS is_blue_chip, regime, R4(adx) AS adx, R1(least(100, appreciation_score / (1 + exp(-0.1e0 * (liq - 30))) + rarity_score * 0.15e0)) AS investment_score,
  breakeven_pct, est_profit"""


@query("screener", f"""SELECT {_PAGE} FROM cand WHERE current_price >= 10 AND (regime IS NULL OR regime <> 'markdown') ORDER BY R6(sort_score) DESC NULLS LAST, card_id LIMIT 50""")
def screener(t):
    page, _ = G.screener(t.cards, metrics(t), exclude_regime="markdown")
    return page.withColumn("adx", rnd(F.col("adx"), 4))


@query("screener_by_profit", f"""SELECT {_PAGE} FROM cand WHERE current_price >= 10 AND est_profit >= -400 AND sales_per_day >= 0.1 ORDER BY est_profit DESC NULLS LAST, card_id LIMIT 20 OFFSET 20""")
def screener_by_profit(t):
    page, _ = G.screener(t.cards, metrics(t), sort_by="est_profit", min_profit=-400, min_velocity=0.1, page=2, page_size=20)
    return page.withColumn("adx", rnd(F.col("adx"), 4))


@query("screener_total", "SELECT count(*) AS total FROM cand WHERE current_price >= 10 AND liquidity_score >= 30 AND appreciation_score >= 5")
def screener_total(t):
    return G.screener(t.cards, metrics(t), min_liquidity=30, min_appreciation_score=5)[1]


@query("screener_stats", """
  SELECT regime, grouping(regime)::INT AS is_total, count(*) AS cards, count(liquidity_score) AS with_liquidity, count(appreciation_score) AS with_appreciation,
    R1(avg(liquidity_score)) AS avg_liquidity, R1(avg(appreciation_score)) AS avg_appreciation, (SELECT d::VARCHAR FROM as_of) AS last_computed
  FROM cards LEFT JOIN metrics USING (card_id) WHERE is_tracked AND current_price IS NOT NULL GROUP BY ROLLUP (regime)""")
def screener_stats(t):
    return G.screener_stats(metrics(t), t.cards, t.as_of)


@query("liquidity_trend", """
  SELECT card_id, date::VARCHAR AS date, n_sales FROM (SELECT card_id, CAST(date_trunc('week', order_date) AS DATE) AS date, count(*) AS n_sales FROM sales GROUP BY 1, 2), as_of WHERE date >= d - 90""")
def liquidity_trend(t):
    weekly = t.sales.groupBy("card_id", F.to_date(F.date_trunc("week", "order_date")).alias("date")).agg(F.count("*").alias("n_sales"))
    return G.liquidity_trend(weekly, t.as_of)


@query("liquidity_history", """
  SELECT card_id, (d - 30)::DATE::VARCHAR AS date, liquidity_score, sales_30d, sales_90d, R2(spread_pct) AS spread_pct FROM metrics, as_of WHERE card_id % 2 = 0
  UNION ALL SELECT card_id, d::VARCHAR, CASE WHEN card_id % 5 = 1 THEN 1 ELSE liquidity_score END, sales_30d, sales_90d, R2(spread_pct) FROM metrics, as_of""")
def liquidity_history(t):
    """The trend of 90 days read from a history that was appended to by day.

    The store holds some cards of 200 and 30 days ago and a first row of today; two runs of today then add the rest once.
    """
    path = f"{checkpoint_root(t.spark)}/liquidity-{uuid.uuid4().hex}"
    rows = metrics(t)
    for days, some in ((200, rows), (30, rows.filter("card_id % 2 = 0")), (0, rows.filter("card_id % 5 = 1").withColumn("liquidity_score", F.lit(1)))):
        G.record_liquidity(some, path, F.date_sub(t.as_of, days))
    for _ in range(2):
        G.record_liquidity(rows, path, t.as_of)
    return G.liquidity_trend(t.spark.read.parquet(path), t.as_of).select("card_id", "date", "liquidity_score", "sales_30d", "sales_90d", "spread_pct")


_FLIP = """SELECT card_id, name, current_price, med0 AS median_sold, sales_per_day, R4(med0 - current_price * 1.1255e0) AS flip_profit, R4((med0 - current_price * 1.1255e0) / current_price * 100) AS flip_roi,
  CASE WHEN sc >= 70 AND breakeven_adjusted_slope > 0 THEN 'Good Value' WHEN sc < 30 OR breakeven_adjusted_slope < -0.1 THEN 'Overpriced' ELSE 'Fair' END AS badge,
  R4((current_price - med0) / med0 * 100) AS spread_pct
  FROM (SELECT *, coalesce(R1(least(100, appreciation_score / (1 + exp(-0.1e0 * (liq - 30))) + rarity_score * 0.15e0)), 0) AS sc FROM cand) WHERE regime IS NULL OR regime <> 'markdown'"""


@query("flip_metrics", _FLIP)
def flip_metrics(t):
    return G.flip_rows(G.candidates(t.cards, metrics(t)))


@query("flip_summary", f"""SELECT count(*) AS profitable, R4(avg(flip_roi)) AS avg_roi, R4(avg(sales_per_day)) AS avg_velocity, arg_max(name, (flip_profit, -card_id)) AS best_name,
  max(flip_profit) AS best_profit FROM ({_FLIP}) WHERE flip_profit > 0""")
def flip_summary(t):
    return G.flip_summary(G.flip_rows(G.candidates(t.cards, metrics(t))))
