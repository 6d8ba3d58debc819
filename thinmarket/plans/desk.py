"""The desk's rules, point-in-time panels and the portfolio ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import catalogue as C
from thinmarket.operators import desk as D
from thinmarket.operators import history as H
from thinmarket.operators import ledger as L
from thinmarket.operators import market as M
from thinmarket.operators import sales as A
from thinmarket.operators import screener as G
from thinmarket.operators import series as S
from thinmarket.plans.indicators import indicators_sql, liquidity_sql, r4, trajectory_sql
from thinmarket.plans.registry import query, view
from thinmarket.plans.sales import slippage_sql
from thinmarket.session import reuse

VINTAGE_SQL = "set_id < 8"  # the binding's vintage sets


def panel(t, metrics=None):
    if metrics is None:
        metrics = G.batch_scores(t.price_history, t.cards, t.sales, t.as_of)
    return D.technical_data(t.price_history, t.cards, metrics, t.sales, t.card_sets, t.as_of, F.expr(VINTAGE_SQL))


view("dom_ser", """SELECT card_id, date, price, low, high, mid, row_number() OVER (PARTITION BY card_id ORDER BY date) AS i, count(*) OVER (PARTITION BY card_id) AS n FROM (
    SELECT card_id, date, market_price AS price, low_price AS low, high_price AS high, mid_price AS mid FROM dominant_all
    QUALIFY row_number() OVER (PARTITION BY card_id, date ORDER BY seq DESC, variant DESC, condition DESC) = 1)""")
view("dom_traj", trajectory_sql("dom_ser"))
view("ind_dom", indicators_sql("dom_ser", "dom_traj"))
view("desk", f"""
  SELECT *, R1(coalesce(appreciation_score, 0) * 0.6e0 + coalesce(mliq, 0) * 0.4e0) AS investment_score,
    coalesce(mliq, {liquidity_sql("sales_90d", "sales_30d", "current_price", "NULL::DOUBLE")}) AS liq FROM (
  SELECT c.card_id, c.name, c.set_id, c.set_name, c.rarity, c.current_price, c.is_tracked, c.{VINTAGE_SQL} AS is_vintage, i.n, i.adx, i.regime, i.rsi, i.sma_7, i.sma_30, i.bu, i.bm, i.bl, x.*,
    coalesce(s30, 0) AS sales_30d, coalesce(s90, 0) AS sales_90d, coalesce(s30, 0) / 30e0 AS spd, coalesce(s90, 0) / 90e0 AS v90,
    CASE WHEN coalesce(s90, 0) / 90e0 > 0.01 THEN (coalesce(s30, 0) / 30e0) / (coalesce(s90, 0) / 90e0) ELSE 1e0 END AS accel,
    m.liquidity_score AS mliq, m.appreciation_score, (d - release_date) // 30 AS age, month(d) AS mon, z.velocity, (z.velocity - z.mean_velocity) / z.std_velocity AS zs, v.vwap, v.vn
  FROM cards c JOIN ind_dom i ON i.card_id = c.card_id
  JOIN (SELECT card_id AS x_id, max(price) FILTER (WHERE i > n - 30) AS high_30, min(price) FILTER (WHERE i > n - 30) AS low_30, max(price) FILTER (WHERE i > n - 14) AS high_14,
      max(price) FILTER (WHERE i > n - 90) AS high_90, avg(price) FILTER (WHERE i > n - 90) AS mean_90, avg(price) FILTER (WHERE i > n - 60) AS mean_60, stddev_samp(price) FILTER (WHERE i > n - 60) AS std_60,
      max(price) FILTER (WHERE i = n) AS p0, max(price) FILTER (WHERE i = n - 6) AS p7, max(price) FILTER (WHERE i = n - 13) AS p14, max(price) FILTER (WHERE i = n - 29) AS p30, max(price) FILTER (WHERE i = 1) AS p1,
      max(mid) FILTER (WHERE i = n) AS lmid, coalesce((p0 - p7) / p7, (p0 - p1) / p1) AS ch7, coalesce(abs(p0 - p14) / p14, 0) AS ch14, coalesce((p0 - p30) / p30, 0) AS ch30, (p0 - lmid) / lmid * 100 AS spread_pct
    FROM dom_ser GROUP BY 1 HAVING count(*) >= 5) x ON x_id = c.card_id
  LEFT JOIN prof p ON p.card_id = c.card_id LEFT JOIN metrics m ON m.card_id = c.card_id LEFT JOIN card_sets USING (set_id) LEFT JOIN velz z ON z.card_id = c.card_id
  LEFT JOIN (SELECT card_id, sum(purchase_price * quantity) / sum(quantity) AS vwap, count(*) AS vn FROM sday WHERE od >= d - 30 AND purchase_price > 0 GROUP BY 1) v ON v.card_id = c.card_id, as_of
  WHERE current_price > 0)""")

_TECH = """card_id, n::INT AS n_points, R4(adx) AS adx, regime, R4(rsi) AS rsi_14, R4(sma_7) AS sma_7, R4(sma_30) AS sma_30, R4(high_30) AS high_30, R4(low_30) AS low_30, R4(high_90) AS high_90,
  R4(mean_60) AS mean_60, R4(std_60) AS std_60, R4(ch7) AS change_7, R4(ch14) AS change_14, R4(ch30) AS change_30, R4(spread_pct) AS spread_pct, R4(spd) AS sales_per_day, R4(v90) AS velocity_90d,
  R4(accel) AS acceleration, liq AS liquidity_score, age AS set_age_months, investment_score, is_vintage, R4(vwap) AS vwap, R4(zs) AS z_score"""


@query("technical_data", f"SELECT {_TECH} FROM desk")
def technical_data(t):
    return r4(panel(t), "card_id", "n_points", "adx", "regime", "rsi_14", "sma_7", "sma_30", "high_30", "low_30", "high_90", "mean_60", "std_60", "change_7", "change_14",
              "change_30", "spread_pct", "sales_per_day", "velocity_90d", "acceleration", "liquidity_score", "set_age_months", "investment_score", "is_vintage", "vwap", "z_score")


_RULES = {
    "velocity_spike": ("current_price >= 20 AND zs >= 2 AND abs(ch7) <= 0.3 AND velocity >= 0.3", "0.4e0 + least(1, zs / 4) * 0.4e0 + greatest(0, 1 - abs(ch7) / 0.3e0) * 0.2e0", "current_price * 1.25e0", "current_price * 0.88e0"),
    "accumulation_phase": ("current_price >= 20 AND v90 >= 0.05 AND spd / v90 >= 1.8 AND ch14 <= 0.05 AND abs(ch7) <= 0.1", "least(1, (spd / v90 - 1) / 3) + CASE WHEN regime = 'accumulation' THEN 0.15e0 ELSE 0 END", "current_price * 1.3e0", "current_price * 0.88e0"),
    "mean_reversion_v2": ("current_price >= 20 AND n >= 30 AND spd >= 0.1 AND coalesce(adx, 0) <= 25 AND std_60 > 0 AND (current_price - mean_60) / std_60 < CASE WHEN spd > 1 THEN -1.2 WHEN spd > 0.3 THEN -1.5 ELSE -2 END AND spd >= v90 * 0.5",
                          "0.3e0 + least(1, abs(current_price - mean_60) / std_60 / 3) * 0.5e0 + least(1, spd) * 0.2e0", "mean_60", "greatest(current_price - std_60, current_price * 0.8e0)"),
    "vwap_divergence": ("current_price >= 20 AND vn >= 5 AND current_price / vwap - 1 <= -0.05", "least(1, 0.4e0 + least(1, abs(current_price / vwap - 1) / 0.2e0) * 0.5e0) + CASE WHEN spd > 0.5 THEN 0.1e0 ELSE 0 END", "vwap", "current_price * 0.88e0"),
    "oop_momentum": ("current_price >= 20 AND age >= 9 AND NOT is_vintage AND spd >= 0.3 AND regime <> 'markdown' AND accel >= 1.2 AND pts >= 35", "0.3e0 + least(1, pts / 80e0) * 0.4e0 + least(1, (accel - 1) / 2) * 0.3e0", "current_price * 1.35e0", "current_price * 0.85e0"),
    "momentum_breakout": ("current_price >= 20 AND n >= 14 AND spd >= 0.3 AND regime IN ('accumulation', 'markup') AND p0 > p7 AND (n < 21 OR p7 > p14) AND current_price / low_30 - 1 <= 0.3 AND spd >= v90 * 0.8",
                          "0.3e0 + least(1, (current_price / low_30 - 1) / 0.2e0) * 0.3e0 + least(1, spd / 2) * 0.2e0 + CASE WHEN 1 - current_price / high_14 BETWEEN 0.05 AND 0.1 THEN 0.15e0 ELSE 0 END", "current_price * 1.3e0", "current_price * 0.85e0"),
    "vintage_value_buy": ("is_vintage AND rarity = 'Rare Holo' AND current_price >= 15 AND spd >= 0.05 AND regime <> 'markdown' AND n >= 15 AND 1 - current_price / high_90 >= 0.15 AND coalesce(rsi, 0) <= 45",
                          "0.55e0 + least(0.35e0, (1 - current_price / high_90 - 0.15e0) * 2.5e0) + CASE WHEN mon IN (1, 2) THEN 0.15e0 WHEN mon IN (8, 9) THEN 0.1e0 ELSE 0 END + CASE WHEN rsi < 30 THEN 0.1e0 ELSE 0 END", "mean_90", "current_price * 0.8e0"),
}
_SCORE = """R1(least(100, greatest(0, ((CASE WHEN sales_90d = 0 THEN 0 ELSE least(100, greatest(0, 50 + (accel - 1) * 50)) END) * 0.25e0 + coalesce(least(100, greatest(0, 40 - spread_pct * 2.4e0)), 30) * 0.2e0 + strength * 15
    + CASE WHEN is_vintage THEN 7.5e0 WHEN age >= 18 THEN 9 WHEN age >= 12 THEN 7 WHEN age < 3 THEN 2 ELSE 5 END + 3 + least(100, liq * 1.25e0) * 0.1e0
    + CASE WHEN current_price >= 200 THEN 10 WHEN current_price >= 100 THEN 8.5e0 WHEN current_price >= 50 THEN 6.5e0 WHEN current_price >= 30 THEN 4 WHEN current_price >= 20 THEN 2 ELSE 0 END
    + CASE mon WHEN 1 THEN 8 WHEN 2 THEN 3 WHEN 9 THEN 5 WHEN 10 THEN 2 WHEN 7 THEN -3 WHEN 8 THEN -3 WHEN 11 THEN -5 WHEN 12 THEN -8 ELSE 0 END)
    * CASE WHEN n < 10 THEN 0.7e0 WHEN n < 20 THEN 0.85e0 WHEN n < 30 THEN 0.95e0 ELSE 1 END * CASE regime WHEN 'markdown' THEN 0.5e0 WHEN 'distribution' THEN 0.7e0 WHEN 'accumulation' THEN 1.1e0 ELSE 1 END)))"""
view("desk_hits", f"SELECT *, {_SCORE} AS composite_score FROM (" + " UNION ALL ".join(
    f"SELECT *, '{r}' AS strategy, R3(least(1, {s})) AS strength, R2({tgt}) AS target_price, R2({stp}) AS stop_loss, {D.MAX_HOLD[r]} AS max_hold_days FROM desk_pts WHERE {cond}" for r, (cond, s, tgt, stp) in _RULES.items()) + ")")
view("desk_pts", "SELECT *, CASE WHEN age >= 18 THEN 40 WHEN age >= 12 THEN 25 ELSE 10 END + CASE WHEN accel >= 2 THEN 35 WHEN accel >= 1.5 THEN 20 ELSE 10 END + CASE WHEN regime IN ('accumulation', 'markup') THEN 15 ELSE 0 END AS pts FROM desk")
view("desk_scan", "SELECT * FROM desk_hits WHERE is_tracked AND (current_price >= 20 OR (is_vintage AND current_price >= 15)) AND (liq >= 25 OR is_vintage)")


# Query names of the rules.
RULE_QUERIES = {
    "velocity_spike": "sig_velocity_spike",
    "accumulation_phase": "sig_accumulation",
    "mean_reversion_v2": "sig_mean_reversion",
    "vwap_divergence": "sig_vwap_divergence",
    "oop_momentum": "sig_out_of_print",
    "momentum_breakout": "sig_confirmed_momentum",
    "vintage_value_buy": "sig_vintage_value",
}


def _rule_query(rule: str):
    @query(RULE_QUERIES[rule], f"SELECT card_id, strength, target_price, stop_loss, composite_score FROM desk_hits WHERE strategy = '{rule}'")
    def run(t):
        return D.rule_hits(panel(t), (rule,)).select("card_id", "strength", "target_price", "stop_loss", "composite_score")

    return run


for _rule in D.BUY_RULES:
    _rule_query(_rule)


@query("scan_signals", "SELECT card_id, strategy, strength, current_price AS entry_price, target_price, stop_loss, max_hold_days::INT AS max_hold_days, composite_score, liq AS liquidity_score FROM desk_scan")
def scan_signals(t):
    return D.scan_signals(panel(t)).select("card_id", "strategy", "strength", "entry_price", "target_price", "stop_loss", "max_hold_days", "composite_score", "liquidity_score")


@query("composite_buy_score", f"SELECT card_id, {_SCORE} AS composite_score FROM (SELECT *, 0.5e0 AS strength FROM desk)")
def composite_buy_score(t):
    return panel(t).select("card_id", D.composite_buy_score(F.lit(0.5)).alias("composite_score"))


@query("signal_summary", """SELECT 'strategy' AS section, strategy AS key, count(*) AS value FROM desk_scan GROUP BY 2 UNION ALL SELECT 'regime', regime, count(*) FROM metrics WHERE regime IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'total', 'signals', count(*) FROM desk_scan""")
def signal_summary(t):
    metrics = reuse(G.batch_metrics(t.price_history, t.cards, t.sales, t.as_of), one_row_per=t.read("supplier"))
    return D.signal_summary(D.scan_signals(panel(t, metrics)), metrics)


@query("top_signals", """SELECT card_id, strategy, strength, composite_score, current_price AS entry_price, target_price, stop_loss FROM desk_scan ORDER BY R6(composite_score) DESC, card_id, strategy LIMIT 20""")
def top_signals(t):
    return D.top_signals(D.scan_signals(panel(t))).select("card_id", "strategy", "strength", "composite_score", "entry_price", "target_price", "stop_loss")


def positions(t):
    return L.positions_from_trades(t.trades)


view("fills", """SELECT *, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY portfolio_id, card_id ORDER BY executed_at, trade_id) AS held,
    row_number() OVER (PARTITION BY portfolio_id, card_id ORDER BY executed_at, trade_id) AS k FROM trades""")
view("open_pos", """
  SELECT * FROM (WITH RECURSIVE w AS (
      SELECT portfolio_id, card_id, k, quantity::BIGINT AS q, R2(price) AS avg, executed_at AS opened, strategy FROM fills WHERE k = 1
      UNION ALL SELECT f.portfolio_id, f.card_id, f.k, CASE f.side WHEN 'buy' THEN w.q + f.quantity ELSE w.q - f.quantity END, CASE WHEN f.side = 'buy' THEN R2((w.avg * w.q + f.price * f.quantity) / (w.q + f.quantity)) ELSE w.avg END,
        CASE WHEN w.q = 0 THEN f.executed_at ELSE w.opened END, CASE WHEN w.q = 0 THEN f.strategy ELSE w.strategy END
      FROM w JOIN fills f ON f.portfolio_id = w.portfolio_id AND f.card_id = w.card_id AND f.k = w.k + 1)
    SELECT portfolio_id, card_id, arg_max(q, k) AS quantity, arg_max(avg, k) AS avg_entry_price, arg_max(opened, k) AS entry_date, arg_max(strategy, k) AS strategy FROM w GROUP BY 1, 2) WHERE quantity > 0""")


@query("positions_from_trades", "SELECT portfolio_id, card_id, quantity, avg_entry_price, entry_date::VARCHAR AS entry_date, strategy FROM open_pos")
def positions_from_trades(t):
    return positions(t)


@query("position_list", """SELECT portfolio_id, card_id, name, quantity, avg_entry_price, R2(p) AS price, R2(p * quantity) AS market_value, R2(p * quantity - avg_entry_price * quantity) AS unrealized_pnl,
  R2((p - avg_entry_price) / avg_entry_price * 100) AS unrealized_pnl_pct, (d - CAST(entry_date AS DATE))::INT AS days_held FROM (SELECT *, coalesce(current_price, avg_entry_price) AS p FROM open_pos LEFT JOIN cards USING (card_id)), as_of""")
def position_list(t):
    return C.position_list(positions(t), t.cards, t.as_of)


def open_positions(t):
    return positions(t).select("portfolio_id", "card_id", F.col("avg_entry_price").alias("entry_price"), "entry_date", "strategy",
                               F.lit(None).cast("double").alias("stop_loss"), F.lit(None).cast("double").alias("take_profit"))


@query("exit_signals", """
  SELECT portfolio_id, card_id, strategy, r.x AS exit_rule, r.s AS strength, R2(g * 100) AS pnl_pct, held AS days_held FROM (
    SELECT *, CASE WHEN current_price <= e * CASE WHEN is_vintage THEN 0.65 ELSE 0.7 END THEN {'x': 'catastrophic_stop', 's': 1e0}
      WHEN spd < CASE WHEN is_vintage THEN 0.03 ELSE 0.05 END AND held > CASE WHEN is_vintage THEN 60 ELSE 30 END THEN {'x': 'liquidity_death', 's': 0.95e0}
      WHEN held < mh THEN CASE WHEN stopped THEN {'x': 'stop_loss', 's': 0.85e0} END
      WHEN g >= CASE WHEN is_vintage THEN 0.5 ELSE 0.4 END AND ac <= 1.5 THEN {'x': 'take_profit', 's': 0.85e0} WHEN g > 0.2 AND current_price < high_30 * 0.92 THEN {'x': 'trailing_stop', 's': 0.9e0}
      WHEN stopped THEN {'x': 'stop_loss', 's': 0.85e0} WHEN strategy NOT IN ('mean_reversion_v2', 'vintage_value_buy') AND regime IN ('distribution', 'markdown') AND g > 0 THEN {'x': 'regime_breakdown', 's': 0.75e0}
      WHEN strategy IN ('velocity_spike', 'accumulation_phase') AND ac < 0.5 AND held > 14 THEN {'x': 'velocity_fade', 's': 0.8e0}
      WHEN held > CASE WHEN is_vintage THEN 365 ELSE xh END AND g < CASE WHEN is_vintage THEN 0.08 ELSE 0.1 END THEN {'x': 'stale_position', 's': 0.6e0}
      WHEN mon IN (11, 12) AND g > 0.15 AND held > 30 AND (NOT is_vintage OR g > 0.3) THEN {'x': 'seasonal_sell', 's': 0.6e0} END AS r
    FROM (SELECT p.portfolio_id, p.strategy, p.avg_entry_price AS e, k.*, (current_price - avg_entry_price) / avg_entry_price AS g, (d - CAST(entry_date AS DATE))::INT AS held, CASE WHEN v90 < 0.01 THEN 1 ELSE spd / v90 END AS ac,
        current_price <= avg_entry_price * CASE WHEN is_vintage THEN 0.75 ELSE 0.8 END AS stopped, CASE p.strategy WHEN 'velocity_spike' THEN 14 WHEN 'accumulation_phase' THEN 21 WHEN 'mean_reversion_v2' THEN 30 ELSE 45 END AS mh,
        CASE p.strategy WHEN 'velocity_spike' THEN 45 WHEN 'accumulation_phase' THEN 60 WHEN 'mean_reversion_v2' THEN 120 ELSE 365 END AS xh FROM open_pos p JOIN desk k ON k.card_id = p.card_id, as_of)) WHERE r IS NOT NULL""")
def exit_signals(t):
    return D.exit_signals(open_positions(t), panel(t), t.as_of)


@query("buy_candidates", """
  WITH u AS (SELECT DISTINCT alert_id AS portfolio_id, card_id FROM alerts UNION SELECT alert_id, (card_id + 50) % (SELECT count(*) FROM supplier) FROM alerts), s AS (SELECT * FROM trades, as_of WHERE side = 'sell'),
  b AS (SELECT portfolio_id, card_id FROM open_pos UNION SELECT portfolio_id, card_id FROM s WHERE realized_pnl < 0 AND CAST(executed_at AS DATE) >= d - 60 UNION SELECT portfolio_id, card_id FROM s WHERE CAST(executed_at AS DATE) >= d - 14
        UNION SELECT portfolio_id, card_id FROM s WHERE realized_pnl < 0 GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT u.portfolio_id, u.card_id, strategy, composite_score FROM u ANTI JOIN b ON b.portfolio_id = u.portfolio_id AND b.card_id = u.card_id JOIN desk_scan USING (card_id) WHERE composite_score >= 40""")
def buy_candidates(t):
    watched = t.alerts.select(F.col("alert_id").alias("portfolio_id"), "card_id")
    universe = watched.unionByName(watched.withColumn("card_id", (F.col("card_id") + 50) % t.n_cards)).distinct()
    out = D.buy_candidates(D.scan_signals(panel(t)), universe, positions(t), t.trades, t.as_of, min_score=40.0)
    return out.select("portfolio_id", "card_id", "strategy", "composite_score")


@query("position_size", """
  SELECT card_id, CAST(CASE WHEN dollars >= current_price THEN least(floor(dollars / current_price), CASE WHEN is_vintage AND current_price > 50 THEN 1 WHEN current_price > 100 THEN 1 WHEN current_price > 50 THEN 2 WHEN current_price > 20 THEN 3 ELSE 4 END) ELSE 0 END AS INT) AS copies
  FROM (SELECT card_id, current_price, is_vintage, least(10000 * least(0.1e0, greatest(0.02e0, (0.55e0 * 0.15e0 - 0.45e0 * 0.12e0) / 0.15e0 * 0.33e0 * (0.3e0 + greatest(0, sc - 50) / 50 * 0.7e0))),
      10000 * least(0.1e0, 0.02e0 + ln(spd + 1) * 0.05e0), 10000 * CASE WHEN is_vintage THEN 0.15e0 ELSE 0.08e0 END, 6000 - 2500) AS dollars FROM (SELECT *, """ + _SCORE + """ AS sc FROM (SELECT *, 0.9e0 AS strength FROM desk)))""")
def position_size(t):
    size = D.position_size(F.lit(10000.0), F.lit(6000.0), F.col("current_price"), F.col("sc"), F.col("sales_per_day"), F.col("is_vintage"), F.lit(0.0), F.lit(3))
    return panel(t).withColumn("sc", D.composite_buy_score(F.lit(0.9))).select("card_id", size.alias("copies"))


STEP = 28
view("pit_base", f"""
  WITH w AS (SELECT s.card_id, s.i, s.date, s.price AS current_price, s.mid, t.rsi, t.adx, t.e12, avg(s.price) OVER (q ROWS 59 PRECEDING) AS mean_60, stddev_pop(s.price) OVER (q ROWS 59 PRECEDING) AS std_60,
      CASE WHEN s.i >= 7 THEN avg(s.price) OVER (q ROWS 6 PRECEDING) END AS sma_7, CASE WHEN s.i >= 30 THEN avg(s.price) OVER (q ROWS 29 PRECEDING) END AS sma_30, CASE WHEN s.i >= 200 THEN avg(s.price) OVER (q ROWS 199 PRECEDING) END AS m200,
      CASE WHEN s.i >= 210 THEN avg(s.price) OVER (q ROWS BETWEEN 209 PRECEDING AND 10 PRECEDING) END AS o200, CASE WHEN s.i >= 8 THEN avg(s.price) OVER (q ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS q7,
      CASE WHEN s.i >= 31 THEN avg(s.price) OVER (q ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS q30, CASE WHEN s.i >= 20 THEN avg(s.price) OVER (q ROWS 19 PRECEDING) END AS bm,
      CASE WHEN s.i >= 20 THEN avg(s.price) OVER (q ROWS 19 PRECEDING) + 2 * stddev_samp(s.price) OVER (q ROWS 19 PRECEDING) END AS bu, CASE WHEN s.i >= 20 THEN greatest(0, avg(s.price) OVER (q ROWS 19 PRECEDING) - 2 * stddev_samp(s.price) OVER (q ROWS 19 PRECEDING)) END AS bl,
      max(s.price) OVER (q ROWS 29 PRECEDING) AS high_30, min(s.price) OVER (q ROWS 29 PRECEDING) AS low_30, max(s.price) OVER (q ROWS 89 PRECEDING) AS high_90, lag(s.price, 6) OVER q AS p7, lag(s.price, 13) OVER q AS p14, lag(s.price, 29) OVER q AS p30
    FROM dom_ser s JOIN dom_traj t ON t.card_id = s.card_id AND t.i = s.i WINDOW q AS (PARTITION BY s.card_id ORDER BY s.i)),
  steps AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(order_date AS DATE)) FROM sales), d, INTERVAL {STEP} DAY)) AS DATE) AS sim_date FROM as_of),
  hit AS (SELECT c.card_id, sim_date, max(w.i) AS i FROM steps CROSS JOIN (SELECT card_id FROM cards WHERE is_tracked AND current_price > 0) c JOIN w ON w.card_id = c.card_id AND w.date <= sim_date GROUP BY 1, 2),
  mon AS (SELECT card_id AS mc, date_trunc('month', order_date)::DATE AS m, count(*) AS k FROM sales GROUP BY 1, 2),
  r AS (SELECT hit.sim_date, w.*, coalesce(a.k, 0) AS m0, coalesce(b.k, 0) AS m1, coalesce(e.k, 0) AS m2 FROM hit JOIN w ON w.card_id = hit.card_id AND w.i = hit.i
    LEFT JOIN mon a ON a.mc = hit.card_id AND a.m = date_trunc('month', sim_date) LEFT JOIN mon b ON b.mc = hit.card_id AND b.m = date_trunc('month', sim_date) - INTERVAL 1 MONTH
    LEFT JOIN mon e ON e.mc = hit.card_id AND e.m = date_trunc('month', sim_date) - INTERVAL 2 MONTH WHERE w.i >= 5)
  SELECT r.*, c.name, c.rarity, c.{VINTAGE_SQL} AS is_vintage, (m0 + m1) / 60e0 AS spd, (m0 + m1 + m2) / 90e0 AS v90, CASE WHEN (m0 + m1 + m2) / 90e0 > 0.01 THEN ((m0 + m1) / 60e0) / ((m0 + m1 + m2) / 90e0) ELSE 1 END AS accel,
    (current_price - p7) / p7 AS ch7, abs(current_price - p14) / p14 AS ch14, (current_price - p30) / p30 AS ch30, abs(current_price - mid) / mid * 100 AS sp, greatest(0, (sim_date - release_date) / 30.44e0) AS age,
    CASE WHEN i < 30 THEN 'unknown' WHEN i < 200 THEN CASE WHEN current_price > sma_30 * 1.05 THEN 'markup' WHEN current_price < sma_30 * 0.95 THEN 'markdown' ELSE 'accumulation' END
      WHEN coalesce(adx, 0) > 25 THEN CASE WHEN current_price > m200 THEN 'markup' ELSE 'markdown' END WHEN i >= 210 AND m200 / o200 - 1 < -0.01 THEN 'distribution' ELSE 'accumulation' END AS regime,
    {liquidity_sql("(m0 + m1 + m2)", "m0", "current_price", "NULL::DOUBLE").replace("current_price", "r.current_price")} AS liq
  FROM r JOIN (SELECT card_id, name, set_id, rarity FROM cards) c ON c.card_id = r.card_id LEFT JOIN card_sets USING (set_id)""")


def pit(t, strict: bool = False):
    return reuse(H.pit_panel(t.price_history, t.cards, t.sales, t.card_sets, t.first_day, t.as_of, STEP, F.expr(VINTAGE_SQL), strict))


@query("pit_panel", """SELECT sim_date::VARCHAR AS sim_date, card_id, i::INT AS n_points, R4(current_price) AS current_price, regime, R4(rsi) AS rsi_14, R4(adx) AS adx, R4(sma_7) AS sma_7, R4(sma_30) AS sma_30, R4(high_30) AS high_30, R4(low_30) AS low_30,
  R4(high_90) AS high_90, R4(ch7) AS change_7, R4(ch14) AS change_14, R4(ch30) AS change_30, R4(sp) AS spread_pct, R4(spd) AS sales_per_day, R4(v90) AS velocity_90d, R4(accel) AS acceleration, liq AS liquidity_score, R4(age) AS set_age_months, is_vintage,
  R4(CASE WHEN ch30 > 0 THEN least(100, ch30 / 30 * 100 * 200) ELSE 0 END * 0.6e0 + liq * 0.4e0) AS investment_score FROM pit_base""")
def pit_panel(t):
    return r4(pit(t), "sim_date", "card_id", "n_points", "current_price", "regime", "rsi_14", "adx", "sma_7", "sma_30", "high_30", "low_30", "high_90", "change_7", "change_14", "change_30", "spread_pct",
              "sales_per_day", "velocity_90d", "acceleration", "liquidity_score", "set_age_months", "is_vintage", "investment_score")


@query("pit_panel_strict", """
  SELECT p.sim_date::VARCHAR AS sim_date, p.card_id, R4((k + m1) / 60e0) AS sales_per_day FROM (SELECT b.sim_date, b.card_id, b.m1, count(s.od) AS k FROM pit_base b LEFT JOIN sday s ON s.card_id = b.card_id AND s.od <= b.sim_date
    AND date_trunc('month', s.od) = date_trunc('month', b.sim_date) GROUP BY 1, 2, 3) p""")
def pit_panel_strict(t):
    return r4(pit(t, strict=True), "sim_date", "card_id", "sales_per_day")


_HIST = {
    "velocity_spike": ("accel >= 2 AND coalesce(abs(ch7), 0) <= 0.3 AND spd >= 0.3", "least(1, 0.4e0 + (accel - 1) * 0.3e0) + CASE WHEN i > 30 THEN 0.1e0 ELSE 0 END", "current_price * 1.3e0", "current_price * 0.85e0"),
    "accumulation_phase": ("v90 > 0.05 AND spd / v90 >= 1.8 AND coalesce(ch14, 0) < 0.05 AND coalesce(abs(ch7), 0) < 0.1", "0.4e0 + (spd / v90 - 1.8e0) * 0.15e0", "current_price * 1.25e0", "current_price * 0.85e0"),
    "mean_reversion_v2": ("i >= 30 AND spd >= 0.1 AND coalesce(adx, 0) < 25 AND std_60 > 0 AND (current_price - mean_60) / std_60 < zt AND spd >= v90 * 0.5", "0.4e0 + abs((current_price - mean_60) / std_60 - zt) * 0.2e0", "mean_60", "current_price * 0.85e0"),
    "vwap_divergence": ("floor(spd * 30) >= 5 AND sp > 5", "0.4e0 + sp * 0.03e0", "current_price * 1.2e0", "current_price * 0.88e0"),
    "oop_momentum": ("age >= 9 AND NOT is_vintage AND spd >= 0.3 AND regime <> 'markdown' AND accel >= 1.2 AND pt >= 35", "0.3e0 + pt / 100e0", "current_price * 1.35e0", "current_price * 0.85e0"),
    "momentum_breakout": ("i >= 21 AND p7 > p14 AND current_price > p7 AND current_price / low_30 - 1 < 0.3 AND spd >= 0.3 AND regime IN ('accumulation', 'markup') AND spd >= v90 * 0.5", "0.4e0 + (p7 / p14 - 1 + current_price / p7 - 1) * 2", "current_price * 1.3e0", "current_price * 0.88e0"),
    "vintage_value_buy": ("is_vintage AND rarity = 'Rare Holo' AND current_price >= 15 AND spd >= 0.05 AND regime <> 'markdown' AND 1 - current_price / high_90 >= 0.15 AND coalesce(rsi, 0) < 45",
                          "0.35e0 + least(1, (1 - current_price / high_90) / 0.4e0) * 0.4e0 + coalesce((45 - rsi) / 45, 0.3e0) * 0.25e0", "current_price + (high_90 - current_price) * 0.6e0", "current_price * 0.8e0"),
}
_LEGACY = {
    "sma_golden_cross": ("q7 <= q30 AND sma_7 > sma_30 AND regime IN ('accumulation', 'markup')", "least(1, 0.5e0 + (sma_7 / sma_30 - 1) * 5) + CASE WHEN regime = 'markup' THEN 0.15e0 ELSE 0 END", "current_price * 1.4e0", "current_price * 0.8e0"),
    "rsi_oversold_bounce": ("rsi < 30 AND liq >= 15 AND bu > bl AND (current_price - bl) / (bu - bl) <= 0.25", "0.4e0 + (30 - rsi) / 30 * 0.4e0 + (1 - (current_price - bl) / (bu - bl) / 0.25e0) * 0.2e0", "bm", "current_price * 0.9e0"),
    "spread_compression": ("sp < 15 AND spd >= 0.5", "0.3e0 + greatest(0, (15 - sp) / 15) * 0.4e0 + least(1, spd / 2) * 0.3e0", "current_price * (1 + greatest(be / 100 + 0.1e0, 0.4e0))", "current_price * 0.8e0"),
}
_BE = "R1(((current_price + 4.8e0) / 0.8675e0 - current_price) / current_price * 100)"
view("pit_pts", f"""SELECT *, CASE WHEN spd > 1 THEN -1.2e0 WHEN spd > 0.3 THEN -1.5e0 ELSE -2 END AS zt, {_BE} AS be,
  CASE WHEN age >= 36 THEN 40 WHEN age >= 18 THEN 25 ELSE 15 END + least(30, floor((accel - 1) * 20 + 1e-9)) + CASE regime WHEN 'markup' THEN 30 WHEN 'accumulation' THEN 20 WHEN 'distribution' THEN 0 ELSE 10 END AS pt FROM pit_base""")


def _hist_sql(rules: dict) -> str:
    parts = " UNION ALL ".join(f"SELECT *, '{r}' AS strategy, R3(least(1, {s})) AS strength, R2({tg}) AS target_price, R2({st}) AS stop_loss FROM pit_pts WHERE {c}" for r, (c, s, tg, st) in rules.items())
    return f"""SELECT *, R3(least(1, strength * 0.4e0 + liq / 100e0 * 0.25e0 + coalesce(least(1, greatest(0, (30 - sp) / 25)) * 0.15e0, 0.075e0)
      + CASE regime WHEN 'markup' THEN 1 WHEN 'accumulation' THEN 0.7e0 WHEN 'distribution' THEN 0.15e0 WHEN 'markdown' THEN 0 ELSE 0.4e0 END * 0.1e0
      + CASE WHEN (target_price - current_price) / current_price * 100 > be * 1.5 THEN 0.1e0 WHEN (target_price - current_price) / current_price * 100 > be THEN 0.05e0 ELSE 0 END)) AS score FROM ({parts})"""


view("hist_hits", _hist_sql(_HIST))
view("legacy_hits", _hist_sql(_LEGACY))
_HCOLS = "sim_date::VARCHAR AS sim_date, card_id, strategy, strength, target_price, stop_loss, score"


@query("historic_signals", f"SELECT {_HCOLS} FROM hist_hits")
def historic_signals(t):
    return H.rule_hits(pit(t), H.HISTORIC_RULES).select("sim_date", "card_id", "strategy", "strength", "target_price", "stop_loss", "score")


@query("legacy_signals", f"SELECT {_HCOLS} FROM legacy_hits")
def legacy_signals(t):
    return H.rule_hits(pit(t), H.LEGACY_RULES).select("sim_date", "card_id", "strategy", "strength", "target_price", "stop_loss", "score")


@query("pit_signals", f"SELECT {_HCOLS}, row_number() OVER (PARTITION BY sim_date ORDER BY score DESC, card_id, strategy) AS rank FROM hist_hits WHERE current_price >= 20 AND (spd >= 0.01 OR is_vintage) AND liq >= 25")
def pit_signals(t):
    return H.pit_signals(pit(t))


@query("historic_signal_score", f"SELECT card_id, strategy, count(*) AS n, R4(avg(score)) AS avg_score, max(score) AS best_score FROM hist_hits GROUP BY 1, 2")
def historic_signal_score(t):
    hits = H.rule_hits(pit(t), H.HISTORIC_RULES)
    return hits.groupBy("card_id", "strategy").agg(F.count("*").alias("n"), rnd(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("best_score"))


@query("historic_exit_rules", """
  WITH p AS (SELECT o.portfolio_id, o.strategy, avg_entry_price AS e, CAST(entry_date AS DATE) AS ed, l.* FROM open_pos o JOIN pit_base l ON l.card_id = o.card_id AND l.sim_date >= CAST(entry_date AS DATE)),
  tops AS (SELECT k.card_id, k.ed, k.sim_date, max(s.price) AS top FROM (SELECT DISTINCT card_id, ed, sim_date FROM p) k JOIN dom_ser s ON s.card_id = k.card_id AND s.date BETWEEN k.ed AND k.sim_date GROUP BY 1, 2, 3),
  a AS (SELECT p.*, (current_price - e) / e AS g, (sim_date - ed)::INT AS held, greatest(current_price, coalesce(top, current_price)) AS pk,
      (sim_date - ed) >= CASE strategy WHEN 'velocity_spike' THEN 14 WHEN 'accumulation_phase' THEN 21 WHEN 'mean_reversion_v2' THEN 30 ELSE 45 END AS ripe, strategy = 'vintage_value_buy' AS vin FROM p LEFT JOIN tops USING (card_id, ed, sim_date)),
  h AS (SELECT *, list_filter([CASE WHEN current_price <= e * 0.8 THEN {'r': 'stop_loss', 's': 1e0} END, CASE WHEN ripe AND current_price >= e * 1.4 THEN {'r': 'take_profit', 's': 0.9e0} END,
      CASE WHEN ripe AND g >= 0.2 AND current_price <= pk * 0.92 AND pk > e THEN {'r': 'trailing_stop', 's': 0.85e0} END,
      CASE WHEN ripe AND strategy NOT IN ('mean_reversion_v2', 'vintage_value_buy') AND q7 >= q30 AND sma_7 < sma_30 THEN {'r': 'death_cross', 's': 0.7e0} END,
      CASE WHEN ripe AND rsi > 70 AND bu > bl AND (current_price - bl) / (bu - bl) > 0.8 THEN {'r': 'overbought', 's': 0.75e0} END,
      CASE WHEN ripe AND strategy NOT IN ('mean_reversion_v2', 'vintage_value_buy') AND regime IN ('distribution', 'markdown') THEN {'r': 'bearish_regime', 's': 0.6e0} END,
      CASE WHEN ripe AND spd < 0.05 THEN {'r': 'liquidity_dry', 's': 0.5e0} END, CASE WHEN ripe AND held > CASE WHEN vin THEN 365 ELSE 180 END AND g < CASE WHEN vin THEN 0.05 ELSE 0.1 END THEN {'r': 'stale', 's': 0.45e0} END,
      CASE WHEN ripe AND month(sim_date) IN (11, 12) AND g > 0.05 THEN {'r': 'seasonal', 's': 0.55e0} END], lambda v: v IS NOT NULL) AS v FROM a)
  SELECT sim_date::VARCHAR AS sim_date, portfolio_id, card_id, strategy, array_to_string(list_transform(v, lambda z: z.r), ',') AS reasons, list_max(list_transform(v, lambda z: z.s)) AS strength, R2(g * 100) AS pnl_pct, held AS days_held FROM h WHERE len(v) > 0""")
def historic_exit_rules(t):
    series = S.dedup_by_date(S.dominant_variant(t.price_history))
    return H.historic_exits(open_positions(t), pit(t), series, t.first_day, STEP)


@query("fill_costs", f"""
  WITH a AS (SELECT t.*, c.current_price AS m, avg_entry_price, R2({slippage_sql("c.current_price", "sales_per_day")}) AS slippage_pct, {slippage_sql("c.current_price", "sales_per_day")} AS sl FROM trades t JOIN cards c ON c.card_id = t.card_id AND current_price > 0
      LEFT JOIN liqd l ON l.card_id = t.card_id LEFT JOIN open_pos p ON p.portfolio_id = t.portfolio_id AND p.card_id = t.card_id),
  b AS (SELECT *, R2(m * CASE side WHEN 'buy' THEN 1 + sl / 100 ELSE 1 - sl / 100 END) AS execution_price FROM a),
  e AS (SELECT *, R2(execution_price * quantity) AS gross, R2(abs(execution_price - m) * quantity) AS slippage_cost FROM b),
  f AS (SELECT *, CASE side WHEN 'buy' THEN 0 ELSE R2(gross * 0.1255e0) END AS fee_cost, CASE WHEN side = 'sell' THEN R2(avg_entry_price * quantity) END AS basis FROM e),
  g AS (SELECT *, CASE side WHEN 'buy' THEN gross ELSE R2(gross - fee_cost) END AS total_cost FROM f)
  SELECT trade_id, side, slippage_pct, execution_price, slippage_cost, fee_cost, total_cost, R2(total_cost - basis) AS new_pnl, R2(R2(total_cost - basis) / basis * 100) AS new_pnl_pct FROM g""")
def fill_costs(t):
    out = L.fill_costs(t.trades, t.cards, A.liquidity_data(t.sales, t.cards, t.as_of), positions(t))
    return out.select("trade_id", "side", "slippage_pct", "execution_price", "slippage_cost", "fee_cost", "total_cost", "new_pnl", "new_pnl_pct")


def portfolios(t):
    return t.read("customer").select(
        F.col("c_custkey").alias("portfolio_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 9 != 0).alias("is_active"),
        rnd(F.col("c_acctbal") + 1000).alias("cash"), F.lit(5000.0).alias("high_water_mark"),
    )


@query("mark_to_market", """
  SELECT c_custkey AS portfolio_id, R2(c_acctbal + 1000) AS cash, R2(coalesce(v, 0)) AS positions_value, R2(coalesce(u, 0)) AS unrealized_pnl, R2(R2(c_acctbal + 1000) + coalesce(v, 0)) AS total_value,
    greatest(5000, R2(R2(c_acctbal + 1000) + coalesce(v, 0))) AS high_water_mark, coalesce(k, 0) AS num_positions FROM customer LEFT JOIN (
    SELECT portfolio_id, sum(current_price * quantity) AS v, sum(R2(current_price * quantity - avg_entry_price * quantity)) AS u, count(*) AS k FROM open_pos JOIN cards USING (card_id) WHERE current_price > 0 GROUP BY 1) ON portfolio_id = c_custkey""")
def mark_to_market(t):
    return L.mark_to_market(portfolios(t), positions(t), t.cards)


@query("leaderboard", """SELECT c_custkey AS portfolio_id, c_name AS name, R2((R2(c_acctbal + 1000) + coalesce(v, 0) - 5000) / 50) AS total_return_pct FROM customer LEFT JOIN (
    SELECT portfolio_id, sum(current_price * quantity) AS v FROM open_pos JOIN cards USING (card_id) WHERE current_price > 0 GROUP BY 1) ON portfolio_id = c_custkey WHERE c_custkey % 9 <> 0 ORDER BY 3 DESC, 1 LIMIT 100""")
def leaderboard(t):
    marked = L.mark_to_market(portfolios(t), positions(t), t.cards).join(portfolios(t).select("portfolio_id", "name", "is_active"), "portfolio_id")
    ranked = marked.withColumn("total_return_pct", rnd((F.col("total_value") - 5000) / 50))
    return L.leaderboard(ranked).select("portfolio_id", "name", "total_return_pct")


view("snaps", """
  SELECT *, R2(total_value - prev) AS daily_pnl, R2((total_value - prev) / prev * 100) AS daily_pnl_pct, R2(total_value - 5000) AS cumulative_pnl, R2((total_value - 5000) / 5000 * 100) AS cumulative_pnl_pct, R2((hwm - total_value) / hwm * 100) AS drawdown_pct FROM (
    SELECT *, coalesce(lag(total_value) OVER (PARTITION BY portfolio_id ORDER BY date), 5000) AS prev, greatest(5000, max(total_value) OVER (PARTITION BY portfolio_id ORDER BY date)) AS hwm FROM (
      SELECT o_custkey AS portfolio_id, CAST(o_orderdate AS DATE) AS date, arg_max(3000 + o_totalprice / 100, (o_orderdate, o_orderkey)) AS total_value, 3000.0 AS cash, R2(arg_max(o_totalprice / 100, (o_orderdate, o_orderkey))) AS positions_value,
        arg_max(o_orderkey % 5 + 1, (o_orderdate, o_orderkey)) AS num_positions FROM orders GROUP BY 1, 2))""")


def snapshots(t):
    marks = t.read("orders").select(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderkey").alias("mark_id"), F.col("o_orderdate").cast("timestamp").alias("marked_at"),
        (3000 + F.col("o_totalprice") / 100).alias("total_value"), F.lit(3000.0).alias("cash"), (F.col("o_totalprice") / 100).alias("positions_value"),
        (F.col("o_orderkey") % 5 + 1).alias("num_positions"),
    )
    return L.daily_snapshots(marks, capital=5000.0)


_SNAP = "portfolio_id, date::VARCHAR AS date, R2(total_value) AS total_value, daily_pnl, daily_pnl_pct, cumulative_pnl, cumulative_pnl_pct, R2(hwm) AS high_water_mark, drawdown_pct, cash::DOUBLE AS cash, positions_value, num_positions"


@query("daily_snapshots", f"SELECT {_SNAP} FROM snaps")
def daily_snapshots(t):
    return snapshots(t)


@query("equity_curve", f"SELECT {_SNAP} FROM snaps, as_of WHERE date >= d - 180")
def equity_curve(t):
    return L.equity_curve(snapshots(t), t.as_of, days=180)


view("psum", """
  SELECT c.*, s.* EXCLUDE (sid) FROM (SELECT portfolio_id, max(drawdown_pct) AS max_drawdown_pct, R2(arg_max(total_value, date)) AS total_value, arg_max(cumulative_pnl_pct, date) AS total_return_pct FROM snaps GROUP BY 1) c LEFT JOIN (
    SELECT portfolio_id AS sid, count(*) AS total_sells, count(*) FILTER (WHERE realized_pnl > 0) AS winning_trades, count(*) FILTER (WHERE realized_pnl <= 0) AS losing_trades, R1(count(*) FILTER (WHERE realized_pnl > 0) * 100 / count(*)) AS win_rate,
      R2(coalesce(avg(realized_pnl) FILTER (WHERE realized_pnl > 0), 0)) AS avg_win, R2(coalesce(avg(realized_pnl) FILTER (WHERE realized_pnl <= 0), 0)) AS avg_loss,
      CASE WHEN abs(coalesce(sum(realized_pnl) FILTER (WHERE realized_pnl <= 0), 0)) > 0 THEN R2(coalesce(sum(realized_pnl) FILTER (WHERE realized_pnl > 0), 0) / abs(sum(realized_pnl) FILTER (WHERE realized_pnl <= 0))) END AS profit_factor,
      max(realized_pnl) AS best_trade, min(realized_pnl) AS worst_trade FROM trades WHERE side = 'sell' GROUP BY 1) s ON sid = portfolio_id""")


@query("portfolio_summary", "SELECT * FROM psum")
def portfolio_summary(t):
    return L.portfolio_summary(t.trades, snapshots(t))


@query("recent_trades", """SELECT portfolio_id, rank::INT AS rank, trade_id, card_id, coalesce(name, 'Unknown') AS card_name, side, quantity, price, realized_pnl, signal, strategy, executed_at::VARCHAR AS executed_at FROM (
    SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY executed_at DESC, trade_id DESC) AS rank FROM trades) LEFT JOIN (SELECT card_id, name FROM catalogue) USING (card_id) WHERE rank <= 20""")
def recent_trades(t):
    return L.recent_trades(t.trades, t.catalogue).select("portfolio_id", "rank", "trade_id", "card_id", "card_name", "side", "quantity", "price", "realized_pnl", "signal", "strategy", F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss").alias("executed_at"))


@query("performance_analytics", """SELECT p.*, coalesce(sr, 0) AS sharpe_ratio FROM psum p JOIN (SELECT portfolio_id, CASE WHEN count(*) > 1 AND stddev_samp(daily_pnl_pct) > 0 THEN R2(avg(daily_pnl_pct) / stddev_samp(daily_pnl_pct) * sqrt(252)) END AS sr FROM snaps GROUP BY 1) USING (portfolio_id)""")
def performance_analytics(t):
    return L.performance_analytics(t.trades, snapshots(t))


@query("performance_breakdown", """SELECT strategy, signal, count(*) AS count, count(*) FILTER (WHERE realized_pnl > 0) AS wins, R2(sum(realized_pnl)) AS total_pnl, R1(count(*) FILTER (WHERE realized_pnl > 0) * 100 / count(*)) AS win_rate, R2(avg(realized_pnl)) AS avg_pnl
  FROM trades WHERE side = 'sell' GROUP BY GROUPING SETS ((strategy), (signal))""")
def performance_breakdown(t):
    return L.performance_breakdown(t.trades)


@query("concentration", """
  WITH h AS (SELECT portfolio_id, current_price * quantity AS v, set_name, split_part(name, ' ', 1) AS w FROM open_pos JOIN cards USING (card_id) WHERE current_price > 0),
  s AS (SELECT portfolio_id, 'set' AS dimension, set_name AS key, sum(v) AS v FROM h GROUP BY 1, 3 UNION ALL SELECT portfolio_id, 'name', w, sum(v) FROM h GROUP BY 1, 3)
  SELECT portfolio_id, dimension, key, R2(v) AS market_value, R2(v / sum(v) OVER (PARTITION BY portfolio_id, dimension) * 100) AS share_pct FROM s""")
def concentration(t):
    return L.concentration(positions(t), t.cards)


def lots(t):
    codes = F.array(*[F.lit(c) for c in ("NM", "LP", "MP", "HP", "DMG")])
    return t.trades.filter("side = 'buy'").withColumn("condition", F.get(codes, (F.col("trade_id") % 5).cast("int")))


view("valued_lots", """
  WITH l AS (SELECT portfolio_id, card_id, ['NM', 'LP', 'MP', 'HP', 'DMG'][trade_id % 5 + 1] AS condition, sum(quantity) AS q, sum(quantity * price) AS cost FROM trades WHERE side = 'buy' GROUP BY 1, 2, 3),
  v AS (SELECT l.*, current_price * q * CASE condition WHEN 'NM' THEN 1 WHEN 'LP' THEN 0.87e0 WHEN 'MP' THEN 0.75e0 WHEN 'HP' THEN 0.55e0 ELSE 0.35e0 END AS val FROM l JOIN cards USING (card_id) WHERE current_price > 0)
  SELECT portfolio_id, card_id, condition, q::BIGINT AS quantity, R2(cost / q) AS avg_cost, R2(val) AS value, R2(val - cost) AS pnl, R2((val - cost) / cost * 100) AS pnl_pct, R2(val / sum(val) OVER (PARTITION BY portfolio_id) * 100) AS share_pct FROM v""")


@query("holdings_valuation", "SELECT * FROM valued_lots")
def holdings_valuation(t):
    return L.holdings_valuation(lots(t), t.cards)


@query("holdings_summary", """
  WITH k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl_pct DESC, card_id, condition) AS b, row_number() OVER (PARTITION BY portfolio_id ORDER BY pnl_pct, card_id, condition) AS w,
    row_number() OVER (PARTITION BY portfolio_id ORDER BY value DESC, card_id, condition) AS m FROM valued_lots)
  SELECT portfolio_id, count(*) AS holdings, R2(sum(value)) AS total_value, R2(sum(value - pnl)) AS total_cost, R2(sum(value) - sum(value - pnl)) AS total_pnl, max(card_id) FILTER (WHERE b = 1) AS best_card_id, max(pnl_pct) AS best_pct,
    max(card_id) FILTER (WHERE w = 1) AS worst_card_id, min(pnl_pct) AS worst_pct, max(card_id) FILTER (WHERE m = 1) AS largest_card_id, R2(max(value) / sum(value) * 100) AS largest_pct FROM k GROUP BY 1""")
def holdings_summary(t):
    return L.holdings_summary(L.holdings_valuation(lots(t), t.cards))


@query("sold_summary", """SELECT portfolio_id, count(*) AS sold, R2(sum((price - 250) * quantity)) AS total_profit, R2(avg((price - 250) / 250 * 100)) AS avg_roi, R1(count(*) FILTER (WHERE price >= 250) * 100 / count(*)) AS win_rate FROM trades WHERE side = 'sell' GROUP BY 1""")
def sold_summary(t):
    sold = t.trades.filter("side = 'sell'").select("portfolio_id", "quantity", F.col("price").alias("sold_price"), F.lit(250.0).alias("cost"))
    return L.sold_summary(sold)


def values(t):
    return snapshots(t).select("portfolio_id", "date", F.col("total_value").alias("value"))


@query("vs_benchmark", """
  WITH i AS (SELECT start AS date, avg_price FROM recap_idx), v AS (SELECT portfolio_id, date, R2(total_value) AS value FROM snaps),
  l AS (SELECT v.*, coalesce((SELECT arg_max(avg_price, i.date) FROM i WHERE i.date <= v.date), (SELECT arg_min(avg_price, date) FROM i)) AS level FROM v),
  b AS (SELECT *, first_value(value) OVER w AS bv, first_value(level) OVER w AS bl, max(value) OVER w AS pk FROM l WINDOW w AS (PARTITION BY portfolio_id ORDER BY date))
  SELECT portfolio_id, date::VARCHAR AS date, R2((value - bv) / bv * 100) AS portfolio_pct, R2((level - bl) / bl * 100) AS index_pct, R2((value - bv) / bv * 100 - (level - bl) / bl * 100) AS difference, R2(pk) AS peak FROM b""")
def vs_benchmark(t):
    index = M.recap_index(t.price_history, M.recap_calendar(t.price_history, t.as_of)).select(F.col("start").alias("date"), "avg_price")
    return L.vs_benchmark(values(t), index)


@query("timeframe_changes", """
  WITH v AS (SELECT portfolio_id, date, R2(total_value) AS value, d FROM snaps, as_of)
  SELECT portfolio_id, R2((arg_max(value, date) / arg_min(value, date) FILTER (WHERE date >= d - 7) - 1) * 100) AS week_pct, R2((arg_max(value, date) / arg_min(value, date) FILTER (WHERE date >= d - 30) - 1) * 100) AS month_pct,
    R2((arg_max(value, date) / arg_min(value, date) - 1) * 100) AS all_pct, R2(max(value)) AS peak FROM v GROUP BY 1""")
def timeframe_changes(t):
    return L.timeframe_changes(values(t), t.as_of)
