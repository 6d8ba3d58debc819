"""Universe, data quality, predictions, alerts and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import alerts as N
from thinmarket.operators import catalogue as C
from thinmarket.operators import market as M
from thinmarket.operators import predictions as R
from thinmarket.operators import quality as Q
from thinmarket.plans.indicators import r4
from thinmarket.plans.ingest import mapped_cards
from thinmarket.plans.registry import query, view


def curated(t):
    return t.catalogue.filter("card_id % 10 = 1").select("card_id")


@query("rebuild_tracked", """
  SELECT card_id, CASE WHEN card_id % 10 = 1 THEN 'curated' WHEN release_date >= d - 1825 AND rarity IN ('Ultra Rare', 'Rare Holo') THEN 'rarity'
    WHEN release_date >= d - 1825 AND current_price > 2 THEN 'recent_price' WHEN current_price >= 10 THEN 'price_threshold' END AS reason FROM cards LEFT JOIN card_sets USING (set_id), as_of""")
def rebuild_tracked(t):
    return Q.rebuild_tracked(t.cards, t.card_sets, curated(t), t.as_of).select("card_id", "reason")


@query("enforce_quality", """
  SELECT card_id, coalesce(k, 0) AS n_bars, m::VARCHAR AS latest, CASE WHEN coalesce(k, 0) < 30 THEN 'thin' WHEN m IS NULL OR m < d - 7 THEN 'stale' END AS removed
  FROM catalogue LEFT JOIN (SELECT card_id, count(*) AS k, max(date) AS m FROM price_history WHERE condition = 'Near Mint' AND variant = 'normal' GROUP BY 1) USING (card_id), as_of WHERE is_tracked""")
def enforce_quality(t):
    bars = t.price_history.filter("condition = 'Near Mint' AND variant = 'normal'")
    out = Q.enforce_quality(t.catalogue, bars, t.as_of)
    return out.select("card_id", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "latest", "removed")


_AUDIT = """
  WITH top AS (SELECT * FROM cards WHERE current_price > 0 {cut}),
  s AS (SELECT card_id, R2(quantile_cont(purchase_price, 0.5)) AS med, count(*) AS k FROM sday WHERE od >= d - 90 AND purchase_price > 0 GROUP BY 1),
  p AS (SELECT h.card_id, max(date) AS latest, arg_max(market_price, (date, seq, condition)) FILTER (WHERE variant = want AND condition = 'Near Mint') AS nm,
      arg_max(market_price, (date, seq, condition)) FILTER (WHERE variant = want AND condition = 'Lightly Played') AS lp, arg_max(market_price, (date, seq, condition)) FILTER (WHERE variant = want) AS now,
      arg_max(market_price, (date, seq, condition)) FILTER (WHERE variant = want AND date <= d - 7) AS old FROM price_history h JOIN (SELECT card_id, coalesce(price_variant, 'normal') AS want FROM top) USING (card_id), as_of GROUP BY 1),
  a AS (SELECT top.*, med, coalesce(k, 0) AS k, latest, nm, lp, R2((now - old) / old * 100) AS ch, release_date, d FROM top LEFT JOIN p USING (card_id) LEFT JOIN s USING (card_id) LEFT JOIN card_sets USING (set_id), as_of)
  SELECT card_id, name, set_name, current_price, category, value FROM (
    SELECT *, 'price_median_mismatch' AS category, R1(current_price / med) AS value FROM a WHERE med > 0 AND k > 5 AND current_price > 10 * med
    UNION ALL SELECT *, 'likely_wrong_variant', 0 FROM a WHERE rarity = 'Common' AND price_variant = 'holofoil' AND release_date >= DATE '1998-01-01'
    UNION ALL SELECT *, 'stale_data', d - latest FROM a WHERE d - latest > 14
    UNION ALL SELECT *, 'zero_sales_expensive', current_price FROM a WHERE current_price > 20 AND k = 0
    UNION ALL SELECT *, 'condition_inversions', R0((lp / nm - 1) * 100) FROM a WHERE lp > nm * 1.2
    UNION ALL SELECT *, 'extreme_changes', ch FROM a WHERE ch > 500 OR ch < -90)"""


@query("audit_top_cards", _AUDIT.replace("{cut}", "ORDER BY current_price DESC, card_id LIMIT 100"))
def audit_top_cards(t):
    return Q.audit_top_cards(t.cards, t.price_history, t.sales, t.card_sets, t.as_of, modern_from="1998-01-01")


@query("audit_cards", f"""SELECT category, count(*) AS n_cards, R2(sum(value)) AS total, min(card_id) AS first_card FROM ({_AUDIT.replace("{cut}", "")}) GROUP BY 1""")
def audit_cards(t):
    """All priced cards: findings by category."""
    found = Q.audit_top_cards(t.cards, t.price_history, t.sales, t.card_sets, t.as_of, limit=None, modern_from="1998-01-01")
    return found.groupBy("category").agg(F.count("*").alias("n_cards"), rnd(F.sum("value")).alias("total"), F.min("card_id").alias("first_card"))


@query("variant_mismatch_candidates", """
  WITH v AS (SELECT card_id, variant, avg(market_price) AS m FROM price_history WHERE variant <> 'normal' OR card_id % 2 = 0 GROUP BY 1, 2),
  o AS (SELECT card_id, max(m) FILTER (WHERE variant = 'normal') AS pref, min(m) AS low, arg_min(variant, m) AS lv FROM v GROUP BY 1)
  SELECT card_id, name, rarity, price_variant AS old_variant, current_price AS old_price, CASE WHEN pref IS NOT NULL THEN 'normal' ELSE lv END AS new_variant, R4(coalesce(pref, low)) AS new_price
  FROM cards JOIN card_sets USING (set_id) JOIN o USING (card_id) WHERE release_date >= DATE '1993-01-01' AND rarity = 'Common' AND price_variant = 'holofoil' AND current_price > 5
    AND (pref IS NOT NULL OR lv <> price_variant)""")
def variant_mismatch_candidates(t):
    prices = t.price_history.filter("variant <> 'normal' OR card_id % 2 = 0").groupBy("card_id", "variant").agg(F.avg("market_price").alias("market"))
    out = Q.variant_mismatch_candidates(t.cards, t.card_sets, prices, modern_from="1993-01-01")
    return out.withColumn("new_price", rnd(F.col("new_price"), 4))


@query("bad_price_rows", """
  WITH l AS (SELECT p.card_id, max(date) AS pd FROM price_history p, as_of WHERE date < d GROUP BY 1)
  SELECT DISTINCT h.card_id, h.date::VARCHAR AS date, h.variant, h.condition, R4(h.market_price) AS market_price FROM price_history h JOIN l USING (card_id)
  JOIN price_history o ON o.card_id = h.card_id AND o.date = pd, as_of WHERE h.date = d AND (h.market_price < o.market_price * 0.33 OR h.market_price > o.market_price * 3)""")
def bad_price_rows(t):
    return r4(Q.bad_price_rows(t.price_history, t.as_of).select("card_id", "date", "variant", "condition", "market_price"))


@query("stale_cards", "SELECT card_id, max(date)::VARCHAR AS latest FROM price_history JOIN catalogue USING (card_id), as_of WHERE is_tracked AND condition = 'Near Mint' GROUP BY 1, d HAVING max(date) < d - 10")
def stale_cards(t):
    return Q.stale_cards(t.catalogue, t.price_history.filter("condition = 'Near Mint'"), t.as_of, days=10).select("card_id", "latest")


@query("mark_viable", "SELECT card_id, card_id % 9 = 0 OR coalesce(current_price >= 20, FALSE) AS is_viable FROM cards")
def mark_viable(t):
    return Q.mark_viable(t.cards.withColumn("is_viable", F.col("card_id") % 9 == 0)).select("card_id", "is_viable")


@query("sync_worklist", """
  (SELECT 'history' AS list, card_id, coalesce(k, 0)::DOUBLE AS rank_by FROM cards LEFT JOIN (SELECT card_id, count(*) AS k FROM price_history GROUP BY 1) USING (card_id) WHERE is_tracked ORDER BY rank_by DESC, card_id LIMIT 20)
  UNION ALL (SELECT 'price', card_id, current_price FROM cards WHERE current_price > 0 ORDER BY current_price DESC, card_id LIMIT 20)
  UNION ALL (SELECT 'viable', card_id, current_price FROM cards WHERE current_price >= 20 ORDER BY current_price DESC, card_id LIMIT 20)
  UNION ALL (SELECT 'oldest', card_id, -epoch(u) FROM (SELECT card_id, CASE WHEN card_id % 6 <> 0 THEN CAST(d - CAST(card_id % 20 AS INT) AS TIMESTAMP) END AS u FROM cards, as_of WHERE current_price IS NOT NULL) ORDER BY u NULLS FIRST, card_id LIMIT 20)""")
def sync_worklist(t):
    parts = [Q.sync_worklist(t.cards, t.price_history, 20, by).select(F.lit(by).alias("list"), "card_id", "rank_by") for by in ("history", "price", "viable")]
    oldest = Q.sync_worklist(mapped_cards(t), t.price_history, 20, "oldest").select(F.lit("oldest").alias("list"), "card_id", "rank_by")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(oldest)


_NEAR = "(SELECT arg_min(s.price, (abs(s.date - (p.predicted_at + {h})), s.date)) FROM series s WHERE s.card_id = p.card_id AND abs(s.date - (p.predicted_at + {h})) <= 3 AND p.predicted_at + {h} <= d)"
view("resolved", f"""
  SELECT *, CASE WHEN o1 <> 'pending' THEN o1 WHEN current_price <= stop_loss THEN 'incorrect' WHEN current_price >= target_price THEN 'correct' ELSE 'pending' END AS outcome FROM (
    SELECT *, CASE WHEN p30 IS NULL THEN 'pending' WHEN signal IN ('buy', 'accumulate') THEN CASE WHEN r30 > 0 THEN 'correct' ELSE 'incorrect' END
        WHEN signal = 'hold' THEN CASE WHEN abs(r30) < 10 THEN 'correct' ELSE 'incorrect' END WHEN signal = 'watch' THEN 'expired' ELSE 'pending' END AS o1 FROM (
      SELECT *, R2((q7 - entry_price) / entry_price * 100) AS r7, R2((q30 - entry_price) / entry_price * 100) AS r30, R2((q90 - entry_price) / entry_price * 100) AS r90,
        R2(q7) AS p7, R2(q14) AS p14, R2(q30) AS p30, R2(q60) AS p60, R2(q90) AS p90 FROM (
        SELECT p.*, {", ".join(_NEAR.format(h=h) + f" AS q{h}" for h in R.HORIZONS)}, c.current_price FROM predictions p LEFT JOIN cards c ON c.card_id = p.card_id, as_of)))""")


def resolved(t):
    return R.backfill_predictions(t.predictions, t.series, t.cards, t.as_of)


_FILLED = {"p7": "price_7d", "p14": "price_14d", "p30": "price_30d", "p60": "price_60d", "p90": "price_90d", "r7": "return_pct_7d", "r30": "return_pct_30d", "r90": "return_pct_90d"}


@query("backfill_predictions", f"""SELECT prediction_id, card_id, signal, {", ".join(f"CASE WHEN prediction_id % 7 <> 0 THEN {k} END AS {v}" for k, v in _FILLED.items())},
  CASE WHEN prediction_id % 7 = 0 THEN 'expired' ELSE outcome END AS outcome FROM resolved""")
def backfill_predictions(t):
    """Every seventh prediction is closed already."""
    some = t.predictions.withColumn("outcome", F.when(F.col("prediction_id") % 7 == 0, "expired"))
    out = R.backfill_predictions(some, t.series, t.cards, t.as_of)
    return out.drop("source", "predicted_at", "entry_price", "target_price", "stop_loss")


@query("accuracy_report", """SELECT source, signal, count(*) AS resolved, count(*) FILTER (WHERE outcome = 'correct') AS correct, R1(count(*) FILTER (WHERE outcome = 'correct') * 100 / count(*)) AS hit_rate,
  arg_max(prediction_id, (r30, -prediction_id)) FILTER (WHERE r30 IS NOT NULL) AS best_id, arg_min(prediction_id, (r30, prediction_id)) FILTER (WHERE r30 IS NOT NULL) AS worst_id
  FROM resolved WHERE outcome IN ('correct', 'incorrect') GROUP BY GROUPING SETS ((), (source), (signal))""")
def accuracy_report(t):
    return R.accuracy_report(resolved(t))


@query("newest_predictions", """
  SELECT prediction_id, p.card_id, coalesce(name, 'Unknown') AS name, signal, source, R4(entry_price) AS entry_price, R4(c.current_price) AS current_price, R4(target_price) AS target_price, R4(stop_loss) AS stop_loss,
    R4(r7) AS return_pct_7d, R4(r30) AS return_pct_30d, R4(r90) AS return_pct_90d, outcome, predicted_at::VARCHAR AS predicted_at
  FROM (SELECT * EXCLUDE (current_price) FROM resolved ORDER BY predicted_at DESC, prediction_id DESC LIMIT 20) p LEFT JOIN cards c ON c.card_id = p.card_id""")
def newest_predictions(t):
    return r4(R.newest_predictions(resolved(t), t.cards))


@query("list_predictions", """SELECT prediction_id, card_id, name, current_price, signal, outcome FROM (SELECT * EXCLUDE (current_price) FROM resolved WHERE outcome = 'correct' ORDER BY predicted_at DESC, prediction_id DESC LIMIT 50) LEFT JOIN cards USING (card_id)""")
def list_predictions(t):
    return C.list_predictions(resolved(t), t.cards, outcome="correct").select("prediction_id", "card_id", "name", "current_price", "signal", "outcome")


@query("recent_picks", """SELECT prediction_id, card_id, name, signal, R1((current_price - entry_price) / entry_price * 100) AS return_pct FROM (SELECT * FROM predictions ORDER BY predicted_at DESC, prediction_id DESC LIMIT 20) JOIN cards USING (card_id)""")
def recent_picks(t):
    return C.recent_picks(t.predictions, t.cards).select("prediction_id", "card_id", "name", "signal", "return_pct")


@query("auto_predictions", """
  WITH c AS (SELECT p.card_id FROM price_history p JOIN cards c ON c.card_id = p.card_id AND c.price_variant = p.variant WHERE is_tracked AND current_price >= 2
             GROUP BY 1 HAVING count(*) >= 10 AND avg(market_price) >= 2),
  h AS (SELECT i.* FROM ind_chosen i JOIN c USING (card_id) WHERE act IS NOT NULL AND NOT coalesce(vol > 500, FALSE) AND NOT coalesce(abs(c7) > 500, FALSE) ORDER BY act DESC, card_id LIMIT 20)
  SELECT card_id, signal_name AS signal, 'signal_engine' AS source, current_price AS entry_price, d::VARCHAR AS predicted_at FROM h JOIN cards USING (card_id), as_of
  WHERE signal_name <> 'hold' AND card_id NOT IN (SELECT card_id FROM resolved WHERE outcome = 'pending')""")
def auto_predictions(t):
    return R.auto_predictions(M.hot_cards(t.price_history, t.cards, limit=20), resolved(t), t.as_of)


@query("target_stop_hits", """SELECT prediction_id, card_id, name, CASE WHEN current_price >= target_price THEN 'milestone' ELSE 'warning' END AS type, CASE WHEN current_price >= target_price THEN 'notable' ELSE 'urgent' END AS severity
  FROM predictions JOIN cards USING (card_id) WHERE current_price > 0 AND (current_price >= target_price OR current_price <= stop_loss)""")
def target_stop_hits(t):
    return R.target_stop_hits(t.predictions.withColumn("outcome", F.lit("pending")), t.cards)


@query("prediction_status", """SELECT count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) AS total, count(*) FILTER (WHERE outcome IN ('correct', 'incorrect')) AS resolved,
  R1(count(*) FILTER (WHERE outcome = 'correct') * 100 / count(*) FILTER (WHERE outcome IN ('correct', 'incorrect'))) AS hit_rate, (SELECT count(*) FROM insights WHERE NOT acknowledged) AS unread FROM resolved""")
def prediction_status(t):
    return R.prediction_status(resolved(t), t.insights)


@query("fire_alerts", """
  WITH m AS (SELECT card_id, quantile_cont(purchase_price, 0.5) AS med FROM sday WHERE od >= d - 90 GROUP BY 1),
  a AS (SELECT a.*, c.name, current_price, abs(current_price - med) / med * 100 AS sp FROM alerts a JOIN cards c USING (card_id) LEFT JOIN m USING (card_id), as_of
        WHERE is_active AND current_price > 0 AND (last_triggered_at IS NULL OR last_triggered_at <= CAST(d AS TIMESTAMP) - INTERVAL 24 HOUR)),
  f AS (SELECT *, CASE WHEN threshold_above <> 0 AND current_price >= threshold_above THEN 'above' WHEN threshold_below <> 0 AND current_price <= threshold_below THEN 'below' WHEN sp <= spread_threshold THEN 'spread_below' END AS fired FROM a)
  SELECT alert_id, card_id, email, name, current_price, fired, R4(CASE fired WHEN 'above' THEN threshold_above WHEN 'below' THEN threshold_below ELSE spread_threshold END) AS threshold FROM f WHERE fired IS NOT NULL""")
def fire_alerts(t):
    return r4(N.fire_alerts(t.alerts, t.cards, t.sales, t.as_of))


@query("upsert_alerts", """
  WITH n AS (SELECT * REPLACE (alert_id + 1000000 AS alert_id, TRUE AS is_active) FROM alerts WHERE alert_id % 4 = 0), k AS (SELECT card_id, email, max(alert_id) AS newest FROM n GROUP BY 1, 2)
  SELECT alert_id, card_id, email, is_active AND (newest IS NULL OR alert_id = newest) AS is_active FROM (SELECT * FROM alerts UNION ALL SELECT * FROM n) LEFT JOIN k USING (card_id, email)""")
def upsert_alerts(t):
    new = t.alerts.filter("alert_id % 4 = 0").withColumn("alert_id", F.col("alert_id") + 1000000).withColumn("is_active", F.lit(True))
    return N.upsert_alerts(t.alerts, new).select("alert_id", "card_id", "email", "is_active")


@query("dedup_insights", """
  WITH x AS (SELECT max(created_at) AS now FROM insights), o AS (SELECT card_id, type, min(insight_id) AS open_id FROM insights, x WHERE NOT acknowledged AND created_at >= now - INTERVAL 24 HOUR GROUP BY 1, 2)
  SELECT insight_id, card_id, type, open_id, CASE WHEN open_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM insights LEFT JOIN o USING (card_id, type) WHERE insight_id % 5 = 0""")
def dedup_insights(t):
    now = t.insights.agg(F.max("created_at")).scalar()
    new = t.insights.filter("insight_id % 5 = 0").select("insight_id", "card_id", "type")
    return N.dedup_insights(t.insights, new, now)


view("srank", """SELECT card_id, set_name, row_number() OVER (PARTITION BY set_name ORDER BY current_price DESC, card_id) AS set_rank, count(*) OVER (PARTITION BY set_name) AS set_total
  FROM cards WHERE is_tracked AND current_price > 0""")


@query("set_rank", "SELECT * FROM srank")
def set_rank(t):
    return N.set_rank(t.cards)


view("movers", """SELECT count(*) FILTER (WHERE abs((current_price - o) / o * 100) > 20) AS big_movers, count(*) AS checked FROM cards JOIN (
    SELECT card_id, arg_max(price, date) AS o FROM series, as_of WHERE date <= d - 7 GROUP BY 1) USING (card_id) WHERE is_tracked AND current_price > 0""")


@query("count_big_movers", "SELECT * FROM movers")
def count_big_movers(t):
    return N.big_movers(t.cards, t.series, t.as_of)


@query("card_insights", """
  WITH r AS (SELECT c.card_id, c.set_name, current_price, i.c7, coalesce(s30, 0) AS s30, (current_price - sma_90) / sma_90 * 100 AS o90, (current_price - avg_sale) / avg_sale * 100 AS osale, (i.price - ath) / ath * 100 AS pa, rsi, set_rank, set_total, big_movers
    FROM cards c LEFT JOIN ind_chosen i USING (card_id) LEFT JOIN prof USING (card_id) LEFT JOIN (SELECT * EXCLUDE (set_name) FROM srank) USING (card_id), movers WHERE current_price > 0),
  l AS (SELECT card_id, list_filter([
    CASE WHEN c7 > 20 THEN {'t': 'Surging', 'k': 'bullish', 'x': printf('Up %+.1f%% in a week; %d cards moved this much', R1(c7), big_movers)} WHEN c7 > 10 THEN {'t': 'Climbing', 'k': 'bullish', 'x': printf('Up %+.1f%% this week', R1(c7))}
      WHEN c7 < -15 THEN {'t': 'Dip Alert', 'k': 'bearish', 'x': printf('Down %+.1f%% this week', R1(c7))} WHEN c7 < -5 THEN {'t': 'Cooling Off', 'k': 'bearish', 'x': printf('Down %+.1f%% this week', R1(c7))} END,
    CASE WHEN s30 > 20 THEN {'t': 'Hot Seller', 'k': 'bullish', 'x': printf('%d sales in 30 days', s30)} WHEN s30 > 5 THEN {'t': 'Active Market', 'k': 'neutral', 'x': printf('%d sales in 30 days', s30)}
      WHEN s30 > 0 THEN {'t': 'Slow Mover', 'k': 'bearish', 'x': printf('%d sales in 30 days', s30)} END,
    CASE WHEN o90 < -15 THEN {'t': 'Below Average', 'k': 'bullish', 'x': printf('%.0f%% below the 90-point average', R0(abs(o90)))} WHEN o90 > 15 THEN {'t': 'Premium', 'k': 'bearish', 'x': printf('%.0f%% above the 90-point average', R0(abs(o90)))} END,
    CASE WHEN set_total > 1 THEN {'t': 'Set Rank', 'k': CASE WHEN set_rank <= 10 THEN 'info' ELSE 'neutral' END, 'x': printf('#%d in %s of %d', set_rank, set_name, set_total)} END,
    CASE WHEN osale < -10 THEN {'t': 'Flip Opportunity', 'k': 'bullish', 'x': printf('%.0f%% below the mean sale', R0(abs(osale)))} WHEN osale > 50 THEN {'t': 'Overpriced', 'k': 'bearish', 'x': printf('%.0f%% above the mean sale', R0(abs(osale)))} END,
    CASE WHEN pa < -40 THEN {'t': 'Well Below Peak', 'k': 'neutral', 'x': printf('%.0f%% below the peak', R0(abs(pa)))} WHEN abs(pa) < 5 THEN {'t': 'Near All-Time High', 'k': 'bullish', 'x': printf('%.0f%% below the peak', R0(abs(pa)))} END,
    CASE WHEN rsi > 70 THEN {'t': 'Overbought', 'k': 'bearish', 'x': printf('RSI at %.0f', R0(rsi))} WHEN rsi < 30 THEN {'t': 'Oversold', 'k': 'bullish', 'x': printf('RSI at %.0f', R0(rsi))} END],
    lambda v: v IS NOT NULL)[1:5] AS v FROM r)
  SELECT card_id, (generate_subscripts(v, 1) - 1)::INT AS pos, unnest(list_transform(v, lambda z: z.t)) AS title, unnest(list_transform(v, lambda z: z.k)) AS type, unnest(list_transform(v, lambda z: z.x)) AS text FROM l
  UNION ALL SELECT card_id, 0, 'No Price Data', 'info', 'No price yet; prices are refreshed periodically' FROM cards WHERE current_price IS NULL OR current_price <= 0""")
def card_insights(t):
    return N.card_insights(t.price_history, t.cards, t.sales, t.series, t.as_of)


@query("card_summary_text", """
  WITH r AS (SELECT c.card_id, current_price, coalesce(med, current_price) AS p, med, coalesce(s30, 0) AS s30, coalesce(k, 0) AS k, (sma_30 - sma_90) / sma_90 * 100 AS tr, (current_price - coalesce(med, current_price)) / coalesce(med, current_price) * 100 AS sp
    FROM cards c LEFT JOIN ind_chosen USING (card_id) LEFT JOIN prof USING (card_id) LEFT JOIN (SELECT card_id, count(*) AS k FROM sales GROUP BY 1) USING (card_id))
  SELECT card_id, CASE WHEN p IS NULL THEN 'Price data is not yet available for this card.' ELSE concat_ws(' ',
    CASE WHEN med IS NOT NULL THEN printf('This card is worth ~$%.2f based on recent sales.', R2(p)) ELSE printf('This card is listed at $%.2f.', R2(p)) END,
    CASE WHEN k = 0 THEN 'No recent sales have been recorded yet.' WHEN s30 > 0 THEN printf('It sold %d time%s in the last 30 days.', s30, CASE WHEN s30 = 1 THEN '' ELSE 's' END)
      ELSE printf('%d sale%s on record, but none in the last 30 days.', k, CASE WHEN k = 1 THEN '' ELSE 's' END) END,
    CASE WHEN tr >= 5 THEN 'Prices have been trending up.' WHEN tr <= -5 THEN 'Prices have been trending down.' END,
    CASE WHEN sp < -10 AND s30 / 30 >= 0.5 THEN 'This looks like a good buying opportunity — listed below recent sale prices with steady demand.'
      WHEN sp > 50 THEN 'Currently listed well above recent sales — consider waiting for a price drop or shopping around.'
      WHEN s30 / 30 < 0.2 THEN 'This card sells infrequently, so it may take a while to find a buyer if you sell.'
      WHEN sp BETWEEN -10 AND 20 THEN 'The listing price is close to recent sale values — fairly priced right now.' END) END AS summary FROM r""")
def card_summary_text(t):
    return N.card_summary_text(t.price_history, t.cards, t.sales, t.as_of)
