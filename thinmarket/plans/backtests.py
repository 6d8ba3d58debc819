"""Strategy signals and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.operators import backtest as B
from thinmarket.operators import strategies as H
from thinmarket.plans.indicators import r4, trajectory_sql
from thinmarket.plans.prices import clean_sql
from thinmarket.plans.registry import query, view

view("bt_src", """SELECT card_id, date, price, row_number() OVER (PARTITION BY card_id ORDER BY date) AS i, count(*) OVER (PARTITION BY card_id) AS n FROM (
    SELECT card_id, date, market_price AS price FROM (SELECT *, count(*) OVER (PARTITION BY card_id) AS k FROM dominant_all) WHERE k >= 35
    QUALIFY row_number() OVER (PARTITION BY card_id, date ORDER BY seq DESC, variant DESC, condition DESC) = 1) QUALIFY count(*) OVER (PARTITION BY card_id) >= 35""")
view("bt_ser", clean_sql("bt_src"))
view("bt_traj", trajectory_sql("bt_ser"))
view("bt_panel", """
  SELECT *, CASE WHEN bu > bl THEN (price - bl) / (bu - bl) END AS place FROM (
    SELECT s.card_id, s.i, s.n, s.date, s.price, t.e12, t.e26, t.rsi, t.line, t.signal, first_value(s.price) OVER w AS p0,
      CASE WHEN s.i >= 7 THEN avg(s.price) OVER (w ROWS 6 PRECEDING) END AS s7, CASE WHEN s.i >= 30 THEN avg(s.price) OVER (w ROWS 29 PRECEDING) END AS s30,
      avg(s.price) OVER (w ROWS 19 PRECEDING) AS bm, avg(s.price) OVER (w ROWS 19 PRECEDING) + 2 * stddev_samp(s.price) OVER (w ROWS 19 PRECEDING) AS bu,
      greatest(0, avg(s.price) OVER (w ROWS 19 PRECEDING) - 2 * stddev_samp(s.price) OVER (w ROWS 19 PRECEDING)) AS bl,
      max(s.price) OVER (w ROWS 19 PRECEDING) AS h20, min(s.price) OVER (w ROWS 19 PRECEDING) AS l20,
      regr_slope(ln(s.price), s.i) OVER (w ROWS 29 PRECEDING) AS sl, regr_r2(ln(s.price), s.i) OVER (w ROWS 29 PRECEDING) AS r2
    FROM bt_ser s JOIN bt_traj t ON t.card_id = s.card_id AND t.i = s.i WINDOW w AS (PARTITION BY s.card_id ORDER BY s.i))""")
view("bt_prev", """SELECT *, lag(s7) OVER w AS qs7, lag(s30) OVER w AS qs30, lag(line) OVER w AS qline, lag(signal) OVER w AS qsignal, lag(rsi) OVER w AS qrsi, lag(e12) OVER w AS q12, lag(e26) OVER w AS q26
  FROM (SELECT * FROM bt_panel WHERE i >= 31) WINDOW w AS (PARTITION BY card_id ORDER BY i)""")
view("bt_sig", """
  SELECT card_id, i, n, date, price, p0,
    CASE WHEN qs7 <= qs30 AND s7 > s30 THEN 'buy' WHEN qs7 >= qs30 AND s7 < s30 THEN 'sell' END AS sma_crossover,
    CASE WHEN rsi < 30 THEN 'buy' WHEN rsi > 70 THEN 'sell' END AS rsi_mean_reversion,
    CASE WHEN qline <= qsignal AND line > signal THEN 'buy' WHEN qline >= qsignal AND line < signal THEN 'sell' END AS macd_signal,
    CASE WHEN place < 0.1 THEN 'buy' WHEN place > 0.9 THEN 'sell' END AS bollinger_bounce,
    CASE WHEN st > 0.15 THEN 'buy' WHEN st < -0.15 THEN 'sell' END AS combined,
    CASE WHEN h20 > l20 THEN CASE WHEN (price - l20) / (h20 - l20) > 0.85 AND s7 > s30 AND rsi < 65 THEN 'buy' WHEN (qrsi > 70 AND rsi < 65) OR price < s30 * 0.98 THEN 'sell' END END AS momentum_breakout,
    CASE WHEN place < 0.05 AND rsi < 25 THEN 'buy' WHEN (place > 0.45 AND place < 0.55 AND rsi > 45) OR place < -0.2 THEN 'sell' END AS mean_reversion_bands,
    CASE WHEN s7 > e12 AND e12 > e26 AND e12 > s30 * 0.99 AND q12 < q26 THEN 'buy' WHEN s7 < e12 AND e12 < e26 AND q12 >= q26 THEN 'sell' END AS trend_rider,
    CASE WHEN s7 > s30 AND rsi BETWEEN 40 AND 65 AND price > bm AND sl > 0.001 AND r2 > 0.3 THEN 'buy' WHEN (qs7 >= qs30 AND s7 < s30) OR rsi > 75 OR price < bl THEN 'sell' END AS steady_gainer
  FROM (SELECT *, ((CASE WHEN rsi < 25 THEN 1e0 WHEN rsi < 35 THEN 0.5e0 WHEN rsi > 80 THEN -1 WHEN rsi > 65 THEN -0.5e0 ELSE (50 - rsi) / 50 END)
      + CASE WHEN signal IS NULL THEN 0 WHEN line > signal THEN 0.5e0 ELSE -0.5e0 END + CASE WHEN price > s30 THEN 0.5e0 ELSE -0.5e0 END
      + CASE WHEN place < 0.2 THEN 0.7e0 WHEN place > 0.8 THEN -0.7e0 ELSE 0 END)
      / (2 + CASE WHEN signal IS NULL THEN 0 ELSE 1 END + CASE WHEN place IS NULL THEN 0 ELSE 1 END) AS st FROM bt_prev)""")
view("bt_long", "SELECT card_id, i, n, date, price, p0, strategy, signal FROM (UNPIVOT bt_sig ON " + ", ".join(H.STRATEGIES) + " INTO NAME strategy VALUE signal)")
view("bt_pos", """
  SELECT *, CASE WHEN long AND NOT was THEN 'buy' WHEN was AND NOT long THEN 'sell' END AS action FROM (
    SELECT *, coalesce(lag(long) OVER (PARTITION BY card_id, strategy ORDER BY i), FALSE) AS was, lag(price) OVER (PARTITION BY card_id, strategy ORDER BY i) AS pp FROM (
      SELECT g.card_id, g.i, g.date, g.price, g.p0, st.strategy, coalesce(last_value(l.signal IGNORE NULLS) OVER (PARTITION BY g.card_id, st.strategy ORDER BY g.i) = 'buy', FALSE) AS long
      FROM bt_sig g CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{s}'" for s in H.STRATEGIES) + """]) AS strategy) st LEFT JOIN bt_long l ON l.card_id = g.card_id AND l.i = g.i AND l.strategy = st.strategy))""")
view("bt_eq", """
  SELECT *, (greatest(1000, max(value) OVER (PARTITION BY card_id, strategy ORDER BY i)) - value) / greatest(1000, max(value) OVER (PARTITION BY card_id, strategy ORDER BY i)) * 100 AS dd,
         last_value(CASE WHEN action = 'buy' THEN price END IGNORE NULLS) OVER (PARTITION BY card_id, strategy ORDER BY i) AS entry FROM (
    SELECT *, 1000 * exp(sum(ln(CASE WHEN was THEN price / pp ELSE 1 END)) OVER (PARTITION BY card_id, strategy ORDER BY i)) AS value, CASE WHEN was THEN price / pp - 1 ELSE 0 END AS ret FROM bt_pos)""")
_RES = """count(action) AS total_trades, count(*) FILTER (WHERE action = 'sell' AND price > entry) AS winning_trades, count(*) FILTER (WHERE action = 'sell' AND price <= entry) AS losing_trades,
    greatest(0, R2(max(dd))) AS max_drawdown_pct, CASE WHEN count(*) FILTER (WHERE ret <> 0) > 1 THEN avg(ret) FILTER (WHERE ret <> 0) / nullif(stddev_samp(ret) FILTER (WHERE ret <> 0), 0) * sqrt(365) END AS rs"""
_OUT = """coalesce(R1(winning_trades * 100 / nullif(winning_trades + losing_trades, 0)), 0) AS win_rate, R2(CASE WHEN strategy_return_pct < 0 THEN least(rs, -0.01) ELSE rs END) AS sharpe_ratio"""
view("bt_res", f"""
  SELECT * EXCLUDE (rs), {_OUT} FROM (SELECT card_id, strategy, R4(any_value(p0)) AS initial_price, R4(arg_max(price, i)) AS final_price, max(date)::VARCHAR AS end_date,
    R2(least(10000, greatest(-100, (arg_max(value, i) - 1000) / 1000 * 100))) AS strategy_return_pct, R2((arg_max(price, i) - any_value(p0)) / any_value(p0) * 100) AS buy_hold_return_pct, {_RES} FROM bt_eq GROUP BY 1, 2)""")
# Fees as a recursion over the ordered trades of each card and strategy: an independent form.
view("bt_walk", """
  SELECT * FROM (WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY card_id, strategy ORDER BY i) AS k FROM bt_pos),
    w AS (SELECT card_id, strategy, k, i, price, action, 1000e0 * (CASE WHEN action = 'buy' THEN 0 ELSE 1 END) AS cash, CASE WHEN action = 'buy' THEN 1000e0 / price ELSE 0e0 END AS units, 0e0 AS fee,
            CASE WHEN action = 'buy' THEN price END AS entry, action AS done FROM r WHERE k = 1
      UNION ALL
      SELECT r.card_id, r.strategy, r.k, r.i, r.price, r.action,
        CASE WHEN r.action = 'buy' AND w.cash > 0 THEN 0 WHEN r.action = 'sell' AND w.units > 0 THEN greatest(0, w.units * r.price * 0.8675e0 - 4.8e0) ELSE w.cash END,
        CASE WHEN r.action = 'buy' AND w.cash > 0 THEN w.cash / r.price WHEN r.action = 'sell' THEN 0 ELSE w.units END,
        CASE WHEN r.action = 'sell' AND w.units > 0 THEN w.units * r.price - greatest(0, w.units * r.price * 0.8675e0 - 4.8e0) ELSE 0 END,
        CASE WHEN r.action = 'buy' THEN r.price ELSE w.entry END,
        CASE WHEN r.action = 'buy' AND w.cash > 0 THEN 'buy' WHEN r.action = 'sell' AND w.units > 0 THEN 'sell' END
      FROM w JOIN r ON r.card_id = w.card_id AND r.strategy = w.strategy AND r.k = w.k + 1)
    SELECT * FROM w)""")
view("bt_fee", f"""
  SELECT * EXCLUDE (rs, p0, p1), {_OUT}, R2(p0) AS initial_cost,
    R1((R2(p1 - (p1 * 0.1325e0 + 4.8e0)) - R2(p0)) / R2(p0) * 100) AS buy_hold_return_pct, R1(((p0 + 4.8e0) / 0.8675e0 - p0) / p0 * 100) AS breakeven_pct FROM (
    SELECT card_id, strategy, any_value(p0) AS p0, arg_max(price, i) AS p1, R2(least(10000, greatest(-100, (arg_max(value, i) - 1000) / 1000 * 100))) AS strategy_return_pct, R2(sum(fee)) AS total_fees_paid, {_RES}
    FROM (SELECT x.* EXCLUDE (action), x.done AS action, p.p0, CASE WHEN p.was AND lv > 0 THEN value / lv - 1 ELSE 0 END AS ret,
            (greatest(1000, max(value) OVER (PARTITION BY x.card_id, x.strategy ORDER BY x.i)) - value) / greatest(1000, max(value) OVER (PARTITION BY x.card_id, x.strategy ORDER BY x.i)) * 100 AS dd
      FROM (SELECT *, cash + units * price AS value, lag(cash + units * price) OVER (PARTITION BY card_id, strategy ORDER BY i) AS lv FROM bt_walk) x JOIN bt_pos p ON p.card_id = x.card_id AND p.strategy = x.strategy AND p.i = x.i) GROUP BY 1, 2)""")


def source(t):
    return B.backtest_series_of(t.price_history)


# Query names of the strategies.
SIGNAL_QUERIES = {
    "sma_crossover": "sig_sma_crossover",
    "rsi_mean_reversion": "sig_rsi",
    "macd_signal": "sig_macd",
    "bollinger_bounce": "sig_bollinger",
    "combined": "sig_combined",
    "momentum_breakout": "sig_breakout",
    "mean_reversion_bands": "sig_mean_reversion_bands",
    "trend_rider": "sig_trend_rider",
    "steady_gainer": "sig_steady_gainer",
}


def _signal_query(strategy: str):
    @query(SIGNAL_QUERIES[strategy], f"SELECT card_id, i::INT AS i, date::VARCHAR AS date, {strategy} AS signal FROM bt_sig WHERE {strategy} IS NOT NULL")
    def run(t):
        panel = H.indicator_panel(source(t))
        return H.signals(panel, (strategy,)).filter(F.col(strategy).isNotNull()).select("card_id", "i", "date", F.col(strategy).alias("signal"))

    return run


for _name in H.STRATEGIES:
    _signal_query(_name)


_SHOW = ("card_id", "strategy", "initial_price", "final_price", "end_date", "strategy_return_pct", "buy_hold_return_pct", "total_trades",
         "winning_trades", "losing_trades", "max_drawdown_pct", "win_rate", "sharpe_ratio")


@query("backtest_series", "SELECT * FROM bt_res WHERE strategy = 'combined'")
def backtest_series(t):
    return r4(B.backtest_all(source(t), ("combined",)).select(*_SHOW))


@query("backtest_all", "SELECT * FROM bt_res")
def backtest_all(t):
    return r4(B.backtest_all(source(t)).select(*_SHOW))


@query("backtest_fees", "SELECT card_id, strategy, strategy_return_pct, buy_hold_return_pct, total_fees_paid, breakeven_pct, total_trades, winning_trades, losing_trades, max_drawdown_pct, win_rate, sharpe_ratio FROM bt_fee")
def backtest_fees(t):
    return B.backtest_fees(source(t)).select(
        "card_id", "strategy", "strategy_return_pct", "buy_hold_return_pct", "total_fees_paid", "breakeven_pct", "total_trades",
        "winning_trades", "losing_trades", "max_drawdown_pct", "win_rate", "sharpe_ratio",
    )


@query("gross_vs_net_backtest", """SELECT card_id, strategy, g.strategy_return_pct AS gross_return_pct, f.strategy_return_pct AS net_return_pct, g.total_trades, f.total_fees_paid,
  R2(g.strategy_return_pct - f.strategy_return_pct) AS fee_drag_pct FROM bt_res g JOIN bt_fee f USING (card_id, strategy) WHERE strategy IN ('combined', 'bollinger_bounce')""")
def gross_vs_net_backtest(t):
    return B.gross_vs_net(source(t), ("combined", "bollinger_bounce"))


@query("backtest_portfolio", """
  WITH top AS (SELECT card_id FROM price_history JOIN catalogue USING (card_id) WHERE is_tracked GROUP BY 1 HAVING count(*) >= 35 ORDER BY count(*) DESC, card_id LIMIT 10),
  r AS (SELECT top.card_id, b.* EXCLUDE (card_id) FROM top LEFT JOIN (SELECT * FROM bt_res WHERE strategy = 'combined') b USING (card_id)),
  a AS (SELECT count(*) AS k, count(strategy_return_pct) AS cards_count, sum(1 + coalesce(strategy_return_pct, 0) / 100) AS u, sum(1 + buy_hold_return_pct / 100) AS h, sum(total_trades)::BIGINT AS total_trades FROM r)
  SELECT cards_count, R2(10000 / k * u) AS final_value, R2((10000 / k * u - 10000) / 100) AS portfolio_return_pct, R2((10000 / k * h - 10000) / 100) AS buy_hold_return_pct,
    R2((10000 / k * u - 10000) / 100 - (10000 / k * h - 10000) / 100) AS alpha, total_trades FROM a""")
def backtest_portfolio(t):
    return B.portfolio_backtest(t.price_history, t.catalogue)


@query("ensemble_signal", """
  SELECT card_id, CASE WHEN b + s = 0 THEN 'HOLD' WHEN b > s THEN 'BUY' ELSE 'SELL' END AS signal, CASE WHEN b + s = 0 THEN 0 ELSE R2(abs(b - s) / (b + s)) END AS confidence, R2(b) AS buy_weight, R2(s) AS sell_weight, n_votes FROM (
    SELECT card_id, sum(CASE WHEN up THEN w ELSE 0 END) AS b, sum(CASE WHEN up THEN 0 ELSE w END) AS s, count(*) AS n_votes FROM (
      SELECT card_id, CASE WHEN sh < 0 THEN strategy_return_pct <= 0 ELSE strategy_return_pct > 0 END AS up, CASE WHEN sh < 0 THEN least(-sh, 2) ELSE greatest(0.1e0, sh) END AS w
      FROM (SELECT *, coalesce(sharpe_ratio, 0) AS sh FROM bt_res WHERE total_trades > 0)) GROUP BY 1)""")
def ensemble_signal(t):
    return B.ensemble_signal(B.backtest_all(source(t)))


@query("card_strategy_comparison", """SELECT card_id, strategy, strategy_return_pct, win_rate, total_trades, max_drawdown_pct, sharpe_ratio FROM bt_res
  WHERE strategy IN ('sma_crossover', 'bollinger_bounce', 'combined') AND card_id IN (SELECT card_id FROM cards WHERE current_price > 0 ORDER BY current_price DESC, card_id LIMIT 5)""")
def card_strategy_comparison(t):
    top = t.cards.filter("current_price > 0").orderBy(F.desc("current_price"), "card_id").limit(5).select("card_id")
    return B.strategy_comparison(source(t), top)


@query("buy_hold_picks", """
  WITH p AS (SELECT *, max(market_price) OVER (PARTITION BY card_id ORDER BY date, seq, variant, condition) AS peak FROM price_history),
  a AS (SELECT card_id, count(*) AS n_rows, arg_min(market_price, (date, seq, variant, condition)) AS f, arg_max(market_price, (date, seq, variant, condition)) AS l, max((peak - market_price) / peak * 100) AS dd FROM p GROUP BY 1 HAVING count(*) >= 35)
  SELECT card_id, n_rows, R2((l - f) / f * 100) AS buy_hold_return_pct, R1((R2(l - (l * 0.1325e0 + 4.8e0)) - R2(f)) / R2(f) * 100) AS fee_adjusted_return_pct, R2(l * 0.1325e0 + 4.8e0) AS total_fees,
    R2(dd) AS max_drawdown_pct, R1((R2(l - (l * 0.1325e0 + 4.8e0)) - R2(f)) / R2(f) * 100) > 0 AS profitable_after_fees FROM a""")
def buy_hold_picks(t):
    return B.buy_hold_picks(t.price_history)


@query("rebase_equity", """
  SELECT card_id, strategy, i::INT AS i, date::VARCHAR AS date, R4(least(500, greatest(-100, (value / first_value(value) OVER w - 1) * 100))) AS strategy_pct, R4(least(500, greatest(-100, (price / first_value(price) OVER w - 1) * 100))) AS hold_pct
  FROM bt_eq WHERE strategy = 'combined' WINDOW w AS (PARTITION BY card_id, strategy ORDER BY i)""")
def rebase_equity(t):
    return B.rebase_equity(B.equity(source(t), ("combined",)))


view("eqm", """SELECT *, lag(value) OVER (PARTITION BY card_id ORDER BY i) AS pv, max(value) OVER (PARTITION BY card_id ORDER BY i) AS pk,
    max(CASE WHEN action = 'buy' THEN date END) OVER (PARTITION BY card_id ORDER BY i) AS bd FROM bt_eq WHERE strategy = 'combined'""")


def closed_trades(rows):
    """Sells of equity rows with profit per unit and days held."""
    from pyspark.sql import Window

    w = Window.partitionBy("card_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.max(F.when(F.col("action") == "buy", F.col("date"))).over(w)
    return rows.withColumn("bought", bought).filter("action = 'sell'").select(
        "card_id", "date", (F.col("price") - F.col("entry")).alias("pnl"), F.datediff("date", "bought").alias("hold_days")
    )


@query("equity_metrics", """
  WITH s AS (SELECT card_id, arg_min(value, i) AS v0, arg_max(value, i) AS v1, max(date) - min(date) AS days, max((pk - value) / pk * 100) AS dd, avg(value / pv - 1) AS m, stddev_samp(value / pv - 1) AS s, count(pv) AS k,
      sqrt(avg(ret ** 2) FILTER (WHERE ret < 0)) AS ds FROM eqm GROUP BY 1),
  t AS (SELECT card_id, count(*) AS closed, R1(count(*) FILTER (WHERE price > entry) * 100 / count(*)) AS win_rate, coalesce(sum(price - entry) FILTER (WHERE price > entry), 0) AS won,
      abs(coalesce(sum(price - entry) FILTER (WHERE price <= entry), 0)) AS lost, R1(avg(date - bd)) AS avg_hold_days, R2(max(price - entry)) AS best_trade, R2(min(price - entry)) AS worst_trade FROM eqm WHERE action = 'sell' GROUP BY 1)
  SELECT card_id, R2((v1 / v0 - 1) * 100) AS total_return_pct, R2(((v1 / v0) ** (365e0 / days) - 1) * 100) AS annualized_return_pct, R2(dd) AS max_drawdown_pct,
    CASE WHEN k > 1 AND s > 0 THEN R3(m / s * sqrt(252)) ELSE 0 END AS sharpe_ratio, CASE WHEN k > 1 AND ds > 0 THEN R3(m / ds * sqrt(252)) ELSE 0 END AS sortino_ratio,
    closed, win_rate, CASE WHEN lost > 0 THEN R3(won / lost) WHEN won = 0 THEN 0 END AS profit_factor, avg_hold_days, best_trade, worst_trade FROM s LEFT JOIN t USING (card_id)""")
def equity_metrics(t):
    rows = B.equity(source(t), ("combined",))
    return B.equity_metrics(rows.select("card_id", "date", "value"), closed_trades(rows))


@query("equity_by_strategy", """SELECT strategy, count(*) AS count, count(*) FILTER (WHERE price > entry) AS wins, R1(count(*) FILTER (WHERE price > entry) * 100 / count(*)) AS win_rate, R2(sum(price - entry)) AS total_pnl, R2(avg(price - entry)) AS avg_pnl
  FROM bt_eq WHERE action = 'sell' GROUP BY 1""")
def equity_by_strategy(t):
    sells = B.equity(source(t)).filter("action = 'sell'")
    return B.equity_by_strategy(sells.select("strategy", (F.col("price") - F.col("entry")).alias("pnl")))


@query("monthly_returns", """SELECT card_id, strftime(date, '%Y-%m') AS month, R2((arg_max(value, i) / arg_min(value, i) - 1) * 100) AS return_pct, count(*) FILTER (WHERE action = 'sell') AS n_trades FROM eqm GROUP BY 1, 2""")
def monthly_returns(t):
    rows = B.equity(source(t), ("combined",))
    return B.monthly_returns(rows.select("card_id", "date", "value"), closed_trades(rows))
