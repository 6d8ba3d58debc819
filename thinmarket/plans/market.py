"""Market-level aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import market as M
from thinmarket.operators import quality as Q
from thinmarket.operators import screener as G
from thinmarket.plans.registry import query, view

view("moved", """
  SELECT card_id, name, set_name, variant, R2(a) AS current_price, R2(b) AS previous_price, R2((a - b) / b * 100) AS change_pct FROM (
    SELECT c.card_id, c.name, c.set_name, p.variant, avg(market_price) FILTER (WHERE date BETWEEN d - 7 AND d) AS a,
           avg(market_price) FILTER (WHERE date >= d - 14 AND date < d - 7) AS b
    FROM price_history p JOIN cards c ON p.card_id = c.card_id AND p.variant = c.price_variant, as_of WHERE is_tracked AND current_price >= 2 GROUP BY ALL)
  WHERE b >= 1 AND abs((a - b) / b * 100) <= 500""")


@query("top_movers", """
  (SELECT *, 'gainer' AS side FROM moved WHERE change_pct > 0 ORDER BY change_pct DESC, card_id LIMIT 10)
  UNION ALL (SELECT *, 'loser' FROM moved WHERE change_pct < 0 ORDER BY change_pct, card_id LIMIT 10)""")
def top_movers(t):
    return M.top_movers(t.price_history, t.cards, t.as_of)


@query("set_relative_strength", """
  WITH r AS (SELECT set_id, avg((current_price - market_price) / market_price) AS v FROM price_history JOIN cards USING (card_id), as_of
             WHERE date >= d - 30 AND is_tracked AND current_price >= 2 GROUP BY 1)
  SELECT set_id, CASE WHEN m = 0 THEN 1 ELSE R2(v / m) END AS strength FROM r, (SELECT avg(v) AS m FROM r)""")
def set_relative_strength(t):
    return M.set_relative_strength(t.price_history, t.cards, t.as_of)


def hot_sql(limit: int) -> str:
    return f"""
  SELECT h.card_id, CASE WHEN hi > lo THEN R1((act - lo) / (hi - lo) * 100) ELSE act END AS activity_score, R2(vol) AS volatility, R2(sr) AS spread_ratio,
    R2(mom) AS momentum, R2(c7) AS change_7d, signal_name AS signal, R2(strength) AS signal_strength, name, set_name, rarity, current_price
  FROM (SELECT *, min(act) OVER () AS lo, max(act) OVER () AS hi FROM (SELECT i.* FROM ind_chosen i JOIN (
      SELECT p.card_id FROM price_history p JOIN cards c ON c.card_id = p.card_id AND c.price_variant = p.variant
      WHERE is_tracked AND current_price >= 2 GROUP BY 1 HAVING count(*) >= 10 AND avg(market_price) >= 2) USING (card_id)
    WHERE act IS NOT NULL AND NOT coalesce(vol > 500, FALSE) AND NOT coalesce(abs(c7) > 500, FALSE) ORDER BY act DESC, card_id LIMIT {limit})) h JOIN cards USING (card_id)"""


@query("hot_cards", hot_sql(12))
def hot_cards(t):
    return M.hot_cards(t.price_history, t.cards)


@query("market_index", """SELECT R2(avg(current_price)) AS avg_price, count(*) AS total_cards, R2(sum(current_price)) AS total_market_cap,
  (SELECT max(date)::VARCHAR FROM price_history) AS last_sync_at FROM cards WHERE is_tracked AND current_price > 0""")
def market_index(t):
    return M.market_index(t.cards, t.price_history)


view("weeks", """SELECT w AS week, greatest(CAST(d - 7 * w - 7 AS DATE), first) AS start, CAST(d - 7 * w AS DATE) AS "end"
  FROM as_of, (SELECT min(date) AS first FROM price_history), (SELECT unnest(range(12))::INT AS w) WHERE d - 7 * w > first""")


@query("recap_calendar", """SELECT week, start::VARCHAR AS start, "end"::VARCHAR AS "end" FROM weeks""")
def recap_calendar(t):
    return M.recap_calendar(t.price_history, t.as_of)


view("recap_idx", """
  SELECT week, start, "end", coalesce(R2(coalesce(e, a)), 0) AS avg_price, CASE WHEN s > 0 THEN R2((coalesce(e, a) - s) / s * 100) END AS change_pct FROM (
    SELECT week, start, "end", avg(market_price) FILTER (WHERE date = "end") AS e, avg(market_price) AS a, avg(market_price) FILTER (WHERE date = start) AS s
    FROM weeks LEFT JOIN price_history ON date BETWEEN start AND "end" GROUP BY 1, 2, 3)""")


@query("index_trend", """SELECT week, start::VARCHAR AS start, "end"::VARCHAR AS "end", avg_price, change_pct FROM recap_idx""")
def index_trend(t):
    return M.recap_index(t.price_history, M.recap_calendar(t.price_history, t.as_of))


@query("weekly_recap", """
  WITH a AS (SELECT w.week, p.card_id, avg(market_price) FILTER (WHERE date BETWEEN "end" - 7 AND "end") AS a, avg(market_price) FILTER (WHERE date >= "end" - 14 AND date < "end" - 7) AS b
      FROM weeks w JOIN price_history p ON date BETWEEN "end" - 14 AND "end" JOIN cards c ON c.card_id = p.card_id AND c.price_variant = p.variant
      WHERE is_tracked AND current_price >= 2 GROUP BY 1, 2),
  m AS (SELECT week, card_id, R2((a - b) / b * 100) AS change_pct FROM a WHERE b >= 1 AND abs((a - b) / b * 100) <= 500),
  r AS (SELECT week, CASE WHEN change_pct > 0 THEN 'gainer' ELSE 'loser' END AS side, card_id, change_pct FROM m WHERE change_pct <> 0)
  SELECT week, side, row_number() OVER (PARTITION BY week, side ORDER BY abs(change_pct) DESC, card_id)::INT AS rank, card_id, change_pct FROM r
  QUALIFY row_number() OVER (PARTITION BY week, side ORDER BY abs(change_pct) DESC, card_id) <= 5
  UNION ALL SELECT week, 'index', 0, NULL, change_pct FROM recap_idx""")
def weekly_recap(t):
    return M.weekly_recap(t.price_history, t.cards, M.recap_calendar(t.price_history, t.as_of))


@query("current_recap", f"""
  WITH o AS (SELECT avg(market_price) AS v FROM price_history, as_of WHERE date = d - 7), m AS (SELECT R2(avg(current_price)) AS a, count(*) AS n, R2(sum(current_price)) AS c FROM cards WHERE is_tracked AND current_price > 0),
  l AS ((SELECT 'gainer' AS side, card_id, name, current_price AS price, change_pct, change_pct AS k FROM moved WHERE change_pct > 0 ORDER BY change_pct DESC, card_id LIMIT 5)
    UNION ALL (SELECT 'loser', card_id, name, current_price, change_pct, -change_pct FROM moved WHERE change_pct < 0 ORDER BY change_pct, card_id LIMIT 5)
    UNION ALL SELECT 'hottest', card_id, name, current_price, change_7d, activity_score FROM ({hot_sql(5)}))
  SELECT 'index' AS side, 0 AS rank, a AS price, CASE WHEN v > 0 THEN R2((a - v) / v * 100) END AS change_pct, n AS total_cards, c AS total_market_cap, NULL::BIGINT AS card_id, NULL::VARCHAR AS name FROM m, o
  UNION ALL SELECT side, (row_number() OVER (PARTITION BY side ORDER BY k DESC, card_id))::INT, price, change_pct, NULL, NULL, card_id, name FROM l""")
def current_recap(t):
    return M.current_recap(t.price_history, t.cards, t.as_of)


@query("set_analytics", """
  SELECT set_name, count(*) AS card_count, R2(avg(current_price)) AS avg_price, R2(sum(current_price)) AS total_value, R2(avg(liquidity_score)) AS avg_liquidity_score,
    R2(avg(appreciation_score)) AS avg_appreciation_score, R2(avg(appreciation_slope) * 7) AS avg_7d_change
  FROM cards LEFT JOIN metrics USING (card_id) WHERE is_tracked AND current_price > 0 GROUP BY 1 HAVING count(*) >= 2""")
def set_analytics(t):
    metrics = G.batch_metrics(t.price_history, t.cards, t.sales, t.as_of)
    out = M.set_analytics(t.cards, metrics.select("card_id", "liquidity_score", "appreciation_score", "appreciation_slope"), min_cards=2)
    return out.select(
        "set_name", "card_count",
        *[rnd(F.col(c)).alias(c) for c in ("avg_price", "total_value", "avg_liquidity_score", "avg_appreciation_score", "avg_7d_change")],
    )


@query("market_overview", """
  WITH v AS (SELECT *, is_tracked AS t, (card_id % 9 = 0 OR current_price >= 20) AS ok FROM cards WHERE current_price > 0)
  SELECT 'market' AS section, count(*) FILTER (WHERE t) AS total_cards, R2(avg(current_price) FILTER (WHERE t)) AS avg_price, R2(sum(current_price) FILTER (WHERE t)) AS total_value, min(current_price) FILTER (WHERE t) AS min_price,
    max(current_price) FILTER (WHERE t) AS max_price, count(*) FILTER (WHERE ok AND current_price >= 100) AS premium, count(*) FILTER (WHERE ok AND current_price >= 50 AND current_price < 100) AS mid_high,
    count(*) FILTER (WHERE ok AND current_price >= 20 AND current_price < 50) AS mid, NULL::BIGINT AS card_id, NULL::VARCHAR AS name, NULL::VARCHAR AS set_name, NULL::DOUBLE AS current_price, NULL::DOUBLE AS change_pct FROM v
  UNION ALL (SELECT 'gainer', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, card_id, name, set_name, current_price, change_pct FROM moved WHERE change_pct > 0 ORDER BY change_pct DESC, card_id LIMIT 5)
  UNION ALL (SELECT 'loser', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, card_id, name, set_name, current_price, change_pct FROM moved WHERE change_pct < 0 ORDER BY change_pct, card_id LIMIT 5)""")
def market_overview(t):
    cards = Q.mark_viable(t.cards.withColumn("is_viable", F.col("card_id") % 9 == 0))
    return M.market_overview(cards, t.price_history, t.as_of)


@query("set_concentration", """
  WITH s AS (SELECT set_id, set_name, count(*) AS cards, R2(sum(current_price)) AS market_cap, R2(avg(current_price)) AS avg_price, min(current_price) AS min_price,
      max(current_price) AS max_price FROM cards WHERE is_tracked AND current_price > 0 GROUP BY 1, 2)
  SELECT *, R2(cards / (SELECT sum(cards) FROM s) * 100) AS share_pct, CASE WHEN (SELECT max(cards) FROM s) >= (SELECT sum(cards) FROM s) * 0.3 THEN 'HIGH' ELSE 'LOW' END AS warning
  FROM s WHERE cards >= 2 ORDER BY market_cap DESC, set_id LIMIT 10""")
def set_concentration(t):
    return M.set_concentration(t.cards)


@query("sales_liquidity_panel", """
  SELECT card_id, name, s90 AS sales_90d, s30 AS sales_30d, R2(m) AS avg_sale, R2(u) AS median_sale, R1(CASE WHEN current_price > 0 THEN (current_price - u) / u * 100 END) AS spread_pct, conditions
  FROM cards JOIN (SELECT card_id, count(*) AS s90, count(*) FILTER (WHERE od >= d - 30) AS s30, avg(purchase_price) AS m,
      list_sort(list(purchase_price))[CAST(floor(count(*) / 2) AS INT) + 1] AS u, string_agg(DISTINCT condition, ',' ORDER BY condition) AS conditions
    FROM sday WHERE od >= d - 90 GROUP BY 1) USING (card_id)""")
def sales_liquidity_panel(t):
    return M.sales_liquidity_panel(t.sales, t.cards, t.as_of)


@query("sales_totals", "SELECT count(*) AS total_sales, count(DISTINCT card_id) AS cards_with_sales, count(*) FILTER (WHERE order_date >= d - 30) AS sales_last_30d FROM sales, as_of")
def sales_totals(t):
    return M.sales_totals(t.sales, t.as_of)


@query("sales_stats", "SELECT count(*) AS total_sales, count(DISTINCT card_id) AS cards_with_sales, min(order_date)::VARCHAR AS first_sale, max(order_date)::VARCHAR AS last_sale FROM sales")
def sales_stats(t):
    return M.sales_stats(t.sales)


@query("price_anomalies", """
  SELECT card_id, name, current_price, R2(avg_price) AS avg_price, R2(ch) AS change_pct, CASE WHEN ch > 0 THEN 'opportunity' ELSE 'warning' END AS type,
    CASE WHEN ch > 30 OR ch < -40 THEN 'urgent' ELSE 'notable' END AS severity FROM (
    SELECT card_id, name, current_price, avg_price, (current_price - avg_price) / avg_price * 100 AS ch FROM (
      SELECT c.card_id, c.name, c.current_price, avg(market_price) AS avg_price, count(*) AS n FROM price_history p
      JOIN cards c ON c.card_id = p.card_id AND c.price_variant = p.variant, as_of
      WHERE is_tracked AND current_price >= 10 AND condition = 'Near Mint' AND market_price > 5 AND date >= d - 90 GROUP BY ALL) WHERE n >= 2)
  WHERE ch > 15 OR ch < -25 ORDER BY abs(R2(ch)) DESC, card_id LIMIT 20""")
def price_anomalies(t):
    return M.price_anomalies(t.price_history, t.cards, t.as_of, days=90)


@query("tracked_stats", """
  SELECT 'tracked' AS section, CASE WHEN is_tracked THEN 'tracked' ELSE 'untracked' END AS key, count(*) AS value FROM catalogue GROUP BY 2
  UNION ALL SELECT 'curated', 'curated', count(*) FILTER (WHERE card_id % 10 = 1) FROM catalogue WHERE is_tracked
  UNION ALL SELECT 'rarity', rarity, count(*) FROM catalogue WHERE is_tracked GROUP BY 2
  UNION ALL SELECT 'recent_set', s.set_name, count(c.card_id) FROM card_sets s LEFT JOIN (SELECT * FROM catalogue WHERE is_tracked) c ON c.set_id = s.set_id, as_of
     WHERE release_date >= d - 1825 GROUP BY 2""")
def tracked_stats(t):
    curated = t.catalogue.filter("card_id % 10 = 1").select("card_id")
    return M.tracked_stats(t.catalogue, t.card_sets, curated, t.as_of)
