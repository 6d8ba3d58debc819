"""Technical indicators: latest values per card and the full analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions import folds as K
from thinmarket.functions.numeric import rnd
from thinmarket.operators import indicators as I
from thinmarket.operators import panel as P
from thinmarket.operators import series as S
from thinmarket.plans.registry import query, view


def trajectory_sql(src: str) -> str:
    """All recurrences over ``src(card_id, i, n, price)`` as one recursive query."""
    return f"""
  SELECT * FROM (
    WITH RECURSIVE base AS (
      SELECT card_id, i, n, price, ma, lag(ma) OVER w AS mp, price - lag(price) OVER w AS d,
             avg(CASE WHEN i > 1 THEN greatest(price - pp, 0) END) OVER (PARTITION BY card_id ORDER BY i) AS mg, avg(CASE WHEN i > 1 THEN greatest(pp - price, 0) END) OVER (PARTITION BY card_id ORDER BY i) AS ml
      FROM (SELECT card_id, i, n, price, lag(price) OVER (PARTITION BY card_id ORDER BY i) AS pp,
                   avg(price) OVER (PARTITION BY card_id ORDER BY i) AS ma FROM {src})
      WINDOW w AS (PARTITION BY card_id ORDER BY i)),
    walk AS (
      SELECT card_id, i, price, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS e50, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss,
             NULL::DOUBLE AS fast, NULL::DOUBLE AS slow, 0::DOUBLE AS lsum, NULL::DOUBLE AS signal, 0 AS seen, 0::DOUBLE AS warm, NULL::DOUBLE AS trend
      FROM base WHERE i = 1
      UNION ALL
      SELECT card_id, i, price, e12, e26, e50, gain, loss, fast, slow,
             CASE WHEN i >= 27 THEN lsum + fast - slow ELSE lsum END,
             CASE WHEN i = 35 THEN (lsum + fast - slow) / 9 WHEN i > 35 THEN signal + (fast - slow - signal) * 0.2e0 END,
             seen, CASE WHEN live AND seen <= 14 THEN warm + dx ELSE warm END,
             CASE WHEN NOT live THEN trend WHEN seen = 14 THEN (warm + dx) / 14 WHEN seen > 14 THEN (trend * 13 + dx) / 14 END
      FROM (SELECT *, CASE WHEN live THEN abs(gain - loss) / (gain + loss) * 100 END AS dx, seen0 + CASE WHEN live THEN 1 ELSE 0 END AS seen FROM (
        SELECT *, i >= 16 AND gain + loss > 0 AS live FROM (
          SELECT b.card_id, b.i, b.price, w.seen AS seen0, w.warm, w.trend, w.lsum, w.signal,
            CASE WHEN b.i = 12 THEN b.ma WHEN b.i > 12 THEN w.e12 + (b.price - w.e12) * 2 / 13e0 END AS e12,
            CASE WHEN b.i = 26 THEN b.ma WHEN b.i > 26 THEN w.e26 + (b.price - w.e26) * 2 / 27e0 END AS e26,
            CASE WHEN b.i = 50 THEN b.ma WHEN b.i > 50 THEN w.e50 + (b.price - w.e50) * 2 / 51e0 END AS e50,
            CASE WHEN b.i = 15 THEN b.mg WHEN b.i > 15 THEN (w.gain * 13 + greatest(b.d, 0)) / 14 END AS gain,
            CASE WHEN b.i = 15 THEN b.ml WHEN b.i > 15 THEN (w.loss * 13 + greatest(-b.d, 0)) / 14 END AS loss,
            CASE WHEN b.i = 13 THEN b.mp WHEN b.i > 13 THEN w.fast + (b.price - w.fast) * 2 / 13e0 END AS fast,
            CASE WHEN b.i = 27 THEN b.mp WHEN b.i > 27 THEN w.slow + (b.price - w.slow) * 2 / 27e0 END AS slow
          FROM walk w JOIN base b ON b.card_id = w.card_id AND b.i = w.i + 1))))
    SELECT card_id, i, price, e12, e26, e50, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
           fast - slow AS line, signal, CASE WHEN i >= 29 THEN trend END AS adx FROM walk)"""


def indicators_sql(src: str, traj: str) -> str:
    """Latest value of every indicator over ``src(card_id, i, n, date, price, low, high)``."""
    return f"""
  SELECT *, CASE WHEN strength > 0.3 THEN 'buy' WHEN strength > 0.08 THEN 'accumulate' WHEN strength < -0.3 THEN 'avoid'
                 WHEN strength < -0.08 THEN 'reduce' ELSE 'hold' END AS signal_name
  FROM (SELECT *, CASE WHEN wt > 0 THEN greatest(-1, least(1, (sc + CASE WHEN act > 50 AND sc > 0 THEN 0.15e0 WHEN act > 50 AND sc < 0 THEN -0.15e0 ELSE 0 END)
                       / (wt + CASE WHEN act > 50 THEN 0.5e0 ELSE 0 END))) ELSE 0 END AS strength FROM (
   SELECT *,
    coalesce(CASE WHEN rsi > 80 THEN -3 WHEN rsi > 70 THEN -2.1e0 WHEN rsi < 20 THEN 3 WHEN rsi < 30 THEN 2.1e0 ELSE (50 - rsi) / 50 * 0.9e0 END, 0)
    + CASE WHEN hist IS NULL THEN 0 WHEN hist > 0 THEN 1.4e0 ELSE -1.4e0 END
    + CASE WHEN sma_30 IS NULL THEN 0 WHEN price / sma_30 - 1 > 0.1e0 THEN 1.2e0 WHEN price > sma_30 THEN 0.6e0 WHEN price / sma_30 - 1 < -0.1e0 THEN -1.2e0 ELSE -0.6e0 END
    + CASE WHEN bu > bl THEN CASE WHEN (price - bl) / (bu - bl) < 0.2e0 THEN 1.05e0 WHEN (price - bl) / (bu - bl) > 0.8e0 THEN -1.05e0
                             ELSE (0.5e0 - (price - bl) / (bu - bl)) * 0.6e0 END ELSE 0 END
    + CASE WHEN mom > 10 THEN 0.5e0 WHEN mom > 5 THEN 0.3e0 WHEN mom < -10 THEN -0.5e0 WHEN mom < -5 THEN -0.3e0 ELSE 0 END AS sc,
    CASE WHEN rsi IS NULL THEN 0 ELSE 3 END + CASE WHEN hist IS NULL THEN 0 ELSE 2 END + CASE WHEN sma_30 IS NULL THEN 0 ELSE 2 END
    + CASE WHEN bu > bl THEN 1.5e0 ELSE 0 END + CASE WHEN mom IS NULL THEN 0 ELSE 1 END AS wt
   FROM (SELECT *, R1(CASE WHEN n >= 5 AND aw > 0 THEN asum / aw * 100 END) AS act FROM (
    SELECT *, coalesce(least(30, vol * 0.5e0), 0) + coalesce(least(20, sr * 0.5e0), 0) + coalesce(least(25, abs(accel) * 0.2e0), 0) + coalesce(least(25, abs(c7) * 0.2e0), 0) AS asum,
      CASE WHEN vol IS NULL THEN 0 ELSE 30e0 END + CASE WHEN sr IS NULL THEN 0 ELSE 20e0 END + CASE WHEN accel IS NULL THEN 0 ELSE 25e0 END + CASE WHEN c7 IS NULL THEN 0 ELSE 25e0 END AS aw,
      CASE WHEN n < 30 THEN 'unknown'
           WHEN n < 200 THEN CASE WHEN price > sma_30 * 1.05 THEN 'markup' WHEN price < sma_30 * 0.95 THEN 'markdown' ELSE 'accumulation' END
           WHEN coalesce(adx, 0) > 25 THEN CASE WHEN price > sma_200 THEN 'markup' ELSE 'markdown' END
           WHEN n >= 210 AND sma_200_prev > 0 AND sma_200 / sma_200_prev - 1 < -0.01 THEN 'distribution' ELSE 'accumulation' END AS regime,
      CASE WHEN sup >= price THEN R2(lo60 * 0.9e0) ELSE sup END AS support FROM (
     SELECT s.card_id, s.n, s.price, g.*, t.e12, t.e26, CASE WHEN s.n >= 50 THEN t.e50 END AS e50, t.rsi, t.line, t.signal, t.line - t.signal AS hist, t.adx,
      a.sma_7, a.sma_30, a.sma_90, a.sma_200, a.sma_200_prev, a.bm, a.bu, a.bl, a.mom, a.accel, a.vol, a.sr,
      h.half_life, c.* EXCLUDE (card_id), least(1, ln(s.n) / ln(1000)) AS confidence
     FROM {src} s
     JOIN {traj} t ON t.card_id = s.card_id AND t.i = s.i
     JOIN (SELECT card_id AS g_id, max(price) AS ath, min(price) AS atl, min(date) AS first_date, arg_min(price, i) AS first_price,
             list_sort(list(price) FILTER (WHERE i > n - 60)) AS s60, s60[CAST(floor(len(s60) * 0.1) AS INT) + 1] AS sup,
             s60[least(len(s60), CAST(floor(len(s60) * 0.9) AS INT) + 1)] AS resistance, s60[1] AS lo60 FROM {src} GROUP BY 1) g ON g_id = s.card_id
     JOIN (SELECT card_id, i,
             CASE WHEN i >= 7 THEN avg(price) OVER (w ROWS 6 PRECEDING) END AS sma_7, CASE WHEN i >= 30 THEN avg(price) OVER (w ROWS 29 PRECEDING) END AS sma_30,
             CASE WHEN i >= 90 THEN avg(price) OVER (w ROWS 89 PRECEDING) END AS sma_90, CASE WHEN i >= 200 THEN avg(price) OVER (w ROWS 199 PRECEDING) END AS sma_200,
             CASE WHEN i >= 210 THEN avg(price) OVER (w ROWS BETWEEN 209 PRECEDING AND 10 PRECEDING) END AS sma_200_prev,
             CASE WHEN i >= 20 THEN avg(price) OVER (w ROWS 19 PRECEDING) END AS bm,
             CASE WHEN i >= 20 THEN avg(price) OVER (w ROWS 19 PRECEDING) + 2 * stddev_samp(price) OVER (w ROWS 19 PRECEDING) END AS bu,
             CASE WHEN i >= 20 THEN greatest(0, avg(price) OVER (w ROWS 19 PRECEDING) - 2 * stddev_samp(price) OVER (w ROWS 19 PRECEDING)) END AS bl,
             CASE WHEN i >= 10 THEN (price / lag(price, 9) OVER w - 1) * 100 END AS mom,
             CASE WHEN i >= 15 THEN (price / lag(price, 4) OVER w - 1) * 100 - (lag(price, 4) OVER w / lag(price, 9) OVER w - 1) * 100 END AS accel,
             CASE WHEN i >= 15 THEN stddev_pop(ret) OVER (w ROWS 13 PRECEDING) * 100 END AS vol,
             avg(CASE WHEN high <> 0 AND low <> 0 AND price > 0 THEN (high - low) / price END) OVER (w ROWS 13 PRECEDING) * 100 AS sr
           FROM (SELECT *, price / lag(price) OVER (PARTITION BY card_id ORDER BY i) - 1 AS ret FROM {src}) WINDOW w AS (PARTITION BY card_id ORDER BY i)) a
       ON a.card_id = s.card_id AND a.i = s.i
     LEFT JOIN (SELECT card_id, CASE WHEN count(*) >= 29 AND regr_slope(d, pp) < 0 THEN least(-ln(2) / regr_slope(d, pp), 999) END AS half_life FROM (
             SELECT card_id, lag(price) OVER (PARTITION BY card_id ORDER BY i) AS pp, price - lag(price) OVER (PARTITION BY card_id ORDER BY i) AS d FROM {src})
           WHERE pp IS NOT NULL GROUP BY 1) h ON h.card_id = s.card_id
     JOIN (SELECT l.card_id,
             {", ".join(f"(l.price / arg_min(o.price, (abs(o.date - (l.date - {d})), o.i)) FILTER (WHERE abs(o.date - (l.date - {d})) <= {gap}) - 1) * 100 AS c{d}" for d, gap in I.CHANGE_HORIZONS.items())}
           FROM {src} l JOIN {src} o ON o.card_id = l.card_id WHERE l.i = l.n GROUP BY l.card_id, l.price) c ON c.card_id = s.card_id
     WHERE s.i = s.n)))))"""


view("traj", trajectory_sql("ser"))
view("traj_chosen", trajectory_sql("chosen"))
view("ind", indicators_sql("ser", "traj"))
view("ind_chosen", indicators_sql("chosen", "traj_chosen"))


def packed(t):
    return S.series_arrays(t.series).select("card_id", "bars", I.prices_of("bars").alias("p"))


def r4(df, *names):
    """The key, the given double columns at four digits, the others as they are."""
    return df.select(
        *[rnd(F.col(c), 4).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns if not names or c in names]
    )




@query("sma", "SELECT card_id, R4(sma_7) AS sma_7, R4(sma_30) AS sma_30, R4(sma_90) AS sma_90, R4(sma_200) AS sma_200 FROM ind")
def sma(t):
    return r4(packed(t).select("card_id", *[K.sma(F.col("p"), k).alias(f"sma_{k}") for k in (7, 30, 90, 200)]))


@query("ema", "SELECT card_id, R4(e12) AS ema_12, R4(e26) AS ema_26, R4(e50) AS ema_50 FROM ind")
def ema(t):
    return r4(packed(t).select("card_id", *[K.ema(F.col("p"), k).alias(f"ema_{k}") for k in (12, 26, 50)]))


@query("rsi", "SELECT card_id, R4(rsi) AS rsi_14 FROM ind")
def rsi(t):
    return r4(packed(t).select("card_id", K.rsi(F.col("p")).alias("rsi_14")))


@query("macd", "SELECT card_id, R4(line) AS line, R4(signal) AS signal, R4(hist) AS histogram FROM ind")
def macd(t):
    return r4(packed(t).select("card_id", K.macd(F.col("p")).alias("m")).select("card_id", "m.*"))


@query("bollinger", "SELECT card_id, R4(bu) AS upper, R4(bm) AS middle, R4(bl) AS lower FROM ind")
def bollinger(t):
    return r4(packed(t).select("card_id", K.bollinger(F.col("p")).alias("b")).select("card_id", "b.*"))


@query("adx", "SELECT card_id, R4(adx) AS adx FROM ind")
def adx(t):
    return r4(packed(t).select("card_id", K.adx(F.col("p")).alias("adx")))


@query("regime", "SELECT card_id, regime FROM ind")
def regime(t):
    return packed(t).withColumn("adx", K.adx(F.col("p"))).select("card_id", K.regime(F.col("p"), F.col("adx")).alias("regime"))


@query("half_life", "SELECT card_id, R4(half_life) AS half_life FROM ind")
def half_life(t):
    return r4(packed(t).select("card_id", K.half_life(F.col("p")).alias("half_life")))


@query("data_confidence", "SELECT card_id, R4(confidence) AS data_confidence FROM ind")
def data_confidence(t):
    counts = t.series.groupBy("card_id").count()
    return r4(counts.select("card_id", K.data_confidence(F.col("count")).alias("data_confidence")))


@query("volatility", "SELECT card_id, R4(vol) AS volatility FROM ind")
def volatility(t):
    return r4(packed(t).select("card_id", K.volatility(F.col("p")).alias("volatility")))


@query("spread_ratio", "SELECT card_id, R4(sr) AS spread_ratio FROM ind")
def spread_ratio(t):
    return r4(packed(t).select("card_id", K.spread_ratio(F.col("bars")).alias("spread_ratio")))


@query("momentum", "SELECT card_id, R4(mom) AS momentum FROM ind")
def momentum(t):
    return r4(packed(t).select("card_id", K.momentum(F.col("p")).alias("momentum")))


@query("momentum_accel", "SELECT card_id, R4(accel) AS momentum_accel FROM ind")
def momentum_accel(t):
    return r4(packed(t).select("card_id", K.momentum_accel(F.col("p")).alias("momentum_accel")))


_CHANGES = ", ".join(f"R4(c{d}) AS change_{d}d" for d in I.CHANGE_HORIZONS) + ", R4((price / first_price - 1) * 100) AS change_all"


@query("price_changes", f"SELECT card_id, {_CHANGES} FROM ind")
def price_changes(t):
    return r4(packed(t).select("card_id", *[c.alias(n) for n, c in I.price_changes(F.col("bars")).items()]))


_RANGES = """R4(ath) AS all_time_high, R4(atl) AS all_time_low, R4((price - ath) / ath * 100) AS pct_from_ath,
  R4(CASE WHEN ath > atl THEN (price - atl) / (ath - atl) * 100 END) AS price_percentile, n::INT AS n_points, first_date::VARCHAR AS first_date, R4(price) AS last_price"""


@query("range_stats", f"SELECT card_id, {_RANGES} FROM ind")
def range_stats(t):
    return r4(packed(t).select("card_id", *[c.alias(n) for n, c in I.range_stats(F.col("bars")).items()]))


@query("support_resistance", "SELECT card_id, R4(support) AS support, R4(resistance) AS resistance FROM ind")
def support_resistance(t):
    return r4(packed(t).select("card_id", K.support_resistance(F.col("p")).alias("s")).select("card_id", "s.*"))


_ANALYSIS = f"""R4(sma_7) AS sma_7, R4(sma_30) AS sma_30, R4(sma_90) AS sma_90, R4(sma_200) AS sma_200, R4(e12) AS ema_12, R4(e26) AS ema_26, R4(e50) AS ema_50,
  R4(rsi) AS rsi_14, R4(line) AS macd_line, R4(signal) AS macd_signal, R4(hist) AS macd_histogram, R4(bu) AS bollinger_upper, R4(bm) AS bollinger_middle, R4(bl) AS bollinger_lower,
  R4(mom) AS momentum, R4(accel) AS momentum_accel, R4(vol) AS volatility, R4(sr) AS spread_ratio, R4(adx) AS adx, regime, R4(half_life) AS half_life,
  R4(confidence) AS data_confidence, R4(support) AS support, R4(resistance) AS resistance, {_CHANGES}, {_RANGES},
  R1(act) AS activity_score, R4(strength) AS signal_strength, signal_name AS signal"""


@query("activity_score", "SELECT card_id, R1(act) AS activity_score FROM ind")
def activity_score(t):
    return r4(I.analyze(packed(t).select("card_id", "bars")), "card_id", "activity_score")


@query("composite_signal", "SELECT card_id, R4(strength) AS signal_strength, signal_name AS signal FROM ind")
def composite_signal(t):
    return r4(I.analyze(packed(t).select("card_id", "bars")), "card_id", "signal_strength", "signal")


view("prof", """
  SELECT card_id, count(*) FILTER (WHERE od >= d - 30) AS s30, count(*) AS s90,
         quantile_cont(purchase_price, 0.5) FILTER (WHERE purchase_price > 0) AS med, avg(purchase_price) AS avg_sale
  FROM (SELECT *, CAST(order_date AS DATE) AS od FROM sales) s, as_of WHERE od >= d - 90 GROUP BY 1""")


def liquidity_sql(s90: str, s30: str, price: str, spread: str) -> str:
    return f"""CAST(least(100, greatest(0,
      CASE WHEN {s90} >= 50 THEN 40 WHEN {s90} >= 20 THEN 30 WHEN {s90} >= 10 THEN 25 WHEN {s90} >= 5 THEN 15 WHEN {s90} >= 1 THEN 5 ELSE 0 END
      + CASE WHEN {s90} > 0 AND {s30} > 0 THEN CASE WHEN {s30} * 3 >= {s90} * 1.5 THEN 30 WHEN {s30} * 3 >= {s90} THEN 20 WHEN {s30} * 3 >= {s90} * 0.5 THEN 10 ELSE 0 END
             WHEN {s30} > 0 THEN 15 ELSE 0 END
      + CASE WHEN abs({spread}) < 5 THEN 20 WHEN abs({spread}) < 10 THEN 15 WHEN abs({spread}) < 20 THEN 10 WHEN abs({spread}) < 30 THEN 5 ELSE 0 END
      + CASE WHEN {price} BETWEEN 20 AND 100 THEN 10 WHEN {price} BETWEEN 10 AND 250 THEN 7 WHEN {price} BETWEEN 5 AND 500 THEN 4 WHEN {price} > 500 THEN 2 ELSE 0 END)) AS INT)"""


@query("analyze_cards", f"""
  SELECT i.card_id, {_ANALYSIS}, coalesce(s30, 0) AS sales_30d, coalesce(s90, 0) AS sales_90d,
    {liquidity_sql("coalesce(s90, 0)", "coalesce(s30, 0)", "coalesce(current_price, 0)", "((current_price - avg_sale) / avg_sale * 100)")} AS liquidity_score
  FROM ind_chosen i JOIN cards USING (card_id) LEFT JOIN prof USING (card_id)""")
def analyze_cards(t):
    """The flagship: the whole analysis of every card with its liquidity."""
    return r4(P.analysis_with_liquidity(t.price_history, t.cards, t.sales, t.as_of))


def breakeven_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN R1((({p} + 4.8e0) / 0.8675e0 - {p}) / {p} * 100) ELSE 999e0 END"


def time_to_sell_sql(p: str, s90: str, s30: str) -> str:
    base = f"CASE WHEN {p} < 5 THEN 1e0 WHEN {p} < 20 THEN 3 WHEN {p} < 100 THEN 7 WHEN {p} < 500 THEN 21 ELSE 45 END"
    return f"""CAST(round(greatest(1, CASE WHEN {s90} > 0 THEN {base} * 0.3e0 + 90e0 / {s90} * 0.7e0 ELSE {base} * 3 END
      * CASE WHEN {s30} > 0 AND {s90} > 0 AND {s30} * 3 > {s90} * 1.5 THEN 0.6e0 WHEN {s30} > 0 AND {s90} > 0 AND {s30} * 3 < {s90} * 0.5 THEN 1.5e0 ELSE 1 END)) AS BIGINT)"""


_NET = "R2({s} - ({s} * 0.1325e0 + 4.8e0))"


@query("analysis_panel", f"""
  SELECT i.card_id, name, set_name, R4(current_price) AS current_price, price_tier, R4(strength) AS signal_strength, signal_name AS signal, regime,
    R4(CASE WHEN bu > bl THEN (price - bl) / (bu - bl) END) AS bb_position, flags, breakeven_pct, viable, sales_30d, sales_90d,
    {liquidity_sql("sales_90d", "sales_30d", "current_price", "spread_pct")} AS liquidity_score,
    {time_to_sell_sql("current_price", "sales_90d", "sales_30d")} AS days_to_sell,
    R1(net_return) AS hold_net_return_pct,
    R1(CASE WHEN sma_90 > 0 THEN ((current_price / sma_90) ** (365e0 / held) - 1) * 100 END) AS hold_annualized_gross_pct,
    R1(CASE WHEN sma_90 > 0 THEN CASE WHEN avg_pnl / sma_90 > -1 THEN ((1 + avg_pnl / sma_90) ** (365e0 / held) - 1) * 100 ELSE -100 END END) AS hold_annualized_net_pct,
    CASE WHEN sma_90 > 0 THEN (current_price - sma_90) / sma_90 * 100 > {breakeven_sql("sma_90")} END AS hold_clears_hurdle,
    CASE WHEN sma_90 > 0 THEN CASE WHEN held < 30 THEN 'short' ELSE 'medium' END END AS recommended_hold
  FROM (SELECT *, coalesce(s30, 0) AS sales_30d, coalesce(s90, 0) AS sales_90d, abs(current_price - med) / med * 100 AS spread_pct,
      CASE WHEN current_price >= 100 THEN 'premium' WHEN current_price >= 50 THEN 'mid_high' WHEN current_price >= 20 THEN 'mid' ELSE 'budget' END AS price_tier,
      concat_ws(',', CASE WHEN price / sma_7 > 3 OR price / sma_7 < 0.33 THEN 'EXTREME_MA_DIVERGENCE' END, CASE WHEN n < 30 THEN 'LOW_DATA' END,
         CASE WHEN confidence < 0.5 THEN 'LOW_CONFIDENCE' END, CASE WHEN price <= support THEN 'AT_OR_BELOW_SUPPORT' END) AS flags,
      {breakeven_sql("current_price")} AS breakeven_pct, current_price >= 20 AS viable, least(n, 90) AS held, R2({_NET.format(s="current_price")} - R2(sma_90)) AS avg_pnl,
      ({_NET.format(s="current_price")} - R2(first_price)) / R2(first_price) * 100 AS net_return
    FROM ind_chosen JOIN cards USING (card_id) LEFT JOIN prof USING (card_id) WHERE current_price > 0) i""")
def analysis_panel(t):
    return r4(P.analysis_panel(t.price_history, t.cards, t.sales, t.as_of))


@query("compare_cards", """
  SELECT card_id, R4(current_price) AS current_price, coalesce(s90, 0) AS sales_90d, R4(rsi) AS rsi_14, regime, R4(strength) AS signal_strength, R4(sma_30) AS sma_30
  FROM ind_chosen JOIN cards USING (card_id) LEFT JOIN prof USING (card_id)
  QUALIFY row_number() OVER (ORDER BY current_price DESC NULLS LAST, card_id) <= 10""")
def compare_cards(t):
    ids = t.cards.orderBy(F.desc_nulls_last("current_price"), "card_id").limit(10).select("card_id")
    return r4(P.compare_cards(t.price_history, t.cards, t.sales, t.as_of, ids))
