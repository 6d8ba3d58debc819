"""Series preparation and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import indicators as I
from thinmarket.operators import sales as A
from thinmarket.operators import series as S
from thinmarket.plans.registry import query, view

view("selected", """
  SELECT * EXCLUDE (rt, tier), tier FROM (
    SELECT *, min(rt) OVER (PARTITION BY card_id) AS tier FROM (
      SELECT p.*, CASE WHEN (c.price_variant IS NULL OR p.variant = c.price_variant) AND p.condition = 'Near Mint' THEN 1
                       WHEN c.price_variant IS NULL OR p.variant = c.price_variant THEN 2 ELSE 3 END AS rt
      FROM price_history p JOIN catalogue c ON p.card_id = c.card_id)) WHERE rt <= tier""")

_DOMINANT = """
  SELECT q.* FROM {src} q JOIN (
    SELECT card_id, arg_min(variant, (-k, f, s)) AS top, max(k) AS best, sum(k) AS total FROM (
      SELECT card_id, variant, count(*) AS k, min(date) AS f, arg_min(seq, (date, seq)) AS s FROM {src} GROUP BY 1, 2) GROUP BY 1) d
  ON q.card_id = d.card_id WHERE q.variant = d.top OR d.best < 0.3 * d.total"""
view("dominant_all", _DOMINANT.format(src="price_history"))
view("dominant_sel", _DOMINANT.format(src="selected"))
view("chosen", """
  SELECT * EXCLUDE (k, med, good), row_number() OVER (PARTITION BY card_id ORDER BY date, seq, variant, condition) AS i,
         count(*) OVER (PARTITION BY card_id) AS n FROM (
    SELECT *, count(*) FILTER (WHERE price BETWEEN 0.05 * med AND 10 * med) OVER (PARTITION BY card_id) AS good FROM (
      SELECT card_id, date, seq, variant, condition, market_price AS price, low_price AS low, high_price AS high,
             count(*) OVER (PARTITION BY card_id) AS k,
             list_sort(list(market_price) OVER (PARTITION BY card_id))[CAST(floor(count(*) OVER (PARTITION BY card_id) / 2) AS INT) + 1] AS med
      FROM dominant_sel))
  WHERE k < 5 OR good < 3 OR price BETWEEN 0.05 * med AND 10 * med""")


@query("select_series", "SELECT card_id, date::VARCHAR AS date, variant, condition, R6(market_price) AS market_price, tier::INT AS tier FROM selected")
def select_series(t):
    out = S.select_series(t.price_history, t.catalogue)
    return out.select("card_id", "date", "variant", "condition", rnd(F.col("market_price"), 6).alias("market_price"), "tier")


@query("select_series_alias", """
  WITH al AS (SELECT * FROM (VALUES ('holofoil', ['holo', 'holofoil']),
      ('normal', ['normal','holofoil','holo','1stEditionHolofoil','1stEditionNormal','unlimitedHolofoil','unlimited'])) v(pv, names)),
  r AS (SELECT p.*, c.price_variant, list_contains(names, p.variant) OR c.price_variant IS NULL AS vok
        FROM price_history p JOIN catalogue c ON p.card_id = c.card_id LEFT JOIN al ON al.pv = c.price_variant),
  r2 AS (SELECT *, CASE WHEN vok AND condition = 'Near Mint' THEN 1 WHEN vok THEN 2 ELSE 3 END AS rt FROM r),
  r3 AS (SELECT * FROM (SELECT *, min(rt) OVER (PARTITION BY card_id) AS tier FROM r2) WHERE rt <= tier),
  d AS (SELECT card_id, arg_min(variant, (-k, f, s)) AS top, max(k) AS best, sum(k) AS total FROM (
        SELECT card_id, variant, count(*) AS k, min(date) AS f, arg_min(seq, (date, seq)) AS s FROM r3 GROUP BY 1, 2) GROUP BY 1),
  k AS (SELECT r3.* FROM r3 JOIN d ON r3.card_id = d.card_id
        WHERE (price_variant IS NOT NULL AND tier < 3) OR variant = top OR best < 0.3 * total),
  cond AS (SELECT card_id, string_agg(DISTINCT condition, ',' ORDER BY condition) AS conditions FROM price_history GROUP BY 1)
  SELECT k.card_id, k.date::VARCHAR AS date, R6(arg_max(market_price, (seq, variant, condition))) AS price, max(tier)::INT AS tier,
         any_value(conditions) AS conditions FROM k JOIN cond ON k.card_id = cond.card_id GROUP BY 1, 2""")
def select_series_alias(t):
    out = S.select_series_alias(t.price_history, t.catalogue)
    return out.select("card_id", "date", rnd(F.col("price"), 6).alias("price"), "tier", F.array_join("conditions", ",").alias("conditions"))


@query("dominant_variant", "SELECT card_id, date::VARCHAR AS date, variant, condition, R6(market_price) AS market_price FROM dominant_all")
def dominant_variant(t):
    out = S.dominant_variant(t.price_history)
    return out.select("card_id", "date", "variant", "condition", rnd(F.col("market_price"), 6).alias("market_price"))


@query("spike_filter", """
  WITH m AS (SELECT *, quantile_disc(price, 0.5) OVER (PARTITION BY card_id) AS q,
       list_sort(list(price) OVER (PARTITION BY card_id))[CAST(floor(n / 2) AS INT) + 1] AS med FROM ser),
  g AS (SELECT *, count(*) FILTER (WHERE price BETWEEN 0.05 * med AND 10 * med) OVER (PARTITION BY card_id) AS good FROM m)
  SELECT card_id, date::VARCHAR AS date, R6(price) AS price FROM g WHERE n < 5 OR good < 3 OR price BETWEEN 0.05 * med AND 10 * med""")
def spike_filter(t):
    return S.spike_filter(t.series).select("card_id", "date", rnd(F.col("price"), 6).alias("price"))


@query("dedup_by_date", "SELECT card_id, date::VARCHAR AS date, R6(price) AS price, R6(low) AS low, R6(high) AS high FROM series")
def dedup_by_date(t):
    return t.series.select("card_id", "date", *[rnd(F.col(c), 6).alias(c) for c in ("price", "low", "high")])


def clean_sql(src: str) -> str:
    """Sequential cleaning as a recursion that carries the last seven cleaned prices."""
    return f"""
  SELECT card_id, i, date, n, c AS price FROM (
    WITH RECURSIVE base AS (
      SELECT s.card_id, s.i, s.n, s.date, s.price,
             list(s.price) OVER (PARTITION BY s.card_id ORDER BY s.i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM {src} s),
    steps AS (
      SELECT card_id, i, date, n, hist, c FROM (
        SELECT b.card_id, b.i, b.date, b.n, [] :: DOUBLE[] AS hist,
               CASE WHEN m > 0 AND (b.price > m * 3 OR b.price < m * 0.33) THEN m ELSE b.price END AS c
        FROM (SELECT *, list_sort(ahead)[CAST(floor(len(ahead) / 2) AS INT) + 1] AS m FROM base WHERE i = 1) b)
      UNION ALL
      SELECT card_id, i, date, n, hist, CASE WHEN m > 0 AND (price > m * 3 OR price < m * 0.33) THEN m ELSE price END
      FROM (SELECT *, list_sort(list_concat(hist, ahead))[CAST(floor((len(hist) + len(ahead)) / 2) AS INT) + 1] AS m FROM (
        SELECT b.card_id, b.i, b.date, b.n, b.price, b.ahead, list_append(w.hist, w.c)[-7:] AS hist
        FROM steps w JOIN base b ON b.card_id = w.card_id AND b.i = w.i + 1)))
    SELECT * FROM steps)"""


view("cleaned", clean_sql("ser"))


@query("clean_outliers", "SELECT card_id, i::INT AS i, date::VARCHAR AS date, R6(price) AS price FROM cleaned")
def clean_outliers(t):
    return I.clean_outliers(t.series).select("card_id", "i", "date", rnd(F.col("price"), 6).alias("price"))


@query("variant_switch_trim", """
  WITH j AS (SELECT *, lag(price) OVER (PARTITION BY card_id ORDER BY i) AS pv FROM ser),
  m AS (SELECT card_id, list_sort(list(price) FILTER (WHERE i <= n - 3)) AS older, max(n) AS n, arg_max(price, i) AS last,
               min(i) FILTER (WHERE price / pv > 5 OR price / pv < 0.2) AS jump FROM j GROUP BY 1),
  k AS (SELECT card_id, CASE WHEN n >= 3 AND len(older) > 0 AND jump IS NOT NULL
               AND (last / older[CAST(floor(len(older) / 2) AS INT) + 1] > 5 OR last / older[CAST(floor(len(older) / 2) AS INT) + 1] < 0.2)
               THEN jump ELSE 1 END AS start FROM m)
  SELECT j.card_id, j.date::VARCHAR AS date, R6(j.price) AS price FROM j JOIN k ON j.card_id = k.card_id WHERE j.i >= k.start""")
def variant_switch_trim(t):
    return S.variant_switch_trim(t.series).select("card_id", "date", rnd(F.col("price"), 6).alias("price"))


@query("forward_fill_calendar", """
  WITH h AS (SELECT c.card_id, (1 + c.card_id % 3) * CASE c.card_id % 2 WHEN 0 THEN 1.0 ELSE 0.8 END AS w, c.current_price FROM cards c),
  days AS (SELECT CAST(unnest(generate_series(d - INTERVAL 179 DAY, d, INTERVAL 1 DAY)) AS DATE) AS date FROM as_of),
  v AS (SELECT days.date, h.w * coalesce(
      (SELECT arg_max(s.price, s.date) FROM series s WHERE s.card_id = h.card_id AND s.date <= days.date),
      (SELECT arg_min(s.price, s.date) FROM series s WHERE s.card_id = h.card_id), h.current_price) AS value
    FROM h CROSS JOIN days),
  a AS (SELECT date, sum(value) AS value FROM v GROUP BY 1)
  SELECT date::VARCHAR AS date, R2(value) AS value FROM a WHERE date >= (SELECT min(date) FROM a WHERE value > 0)""")
def forward_fill_calendar(t):
    key = F.col("card_id")
    holdings = t.cards.select(
        "card_id", (1 + key % 3).alias("quantity"),
        F.when(key % 2 == 0, 1.0).otherwise(0.8).alias("multiplier"), "current_price",
    )
    return S.forward_fill_calendar(holdings, t.series, t.as_of).select("date", rnd(F.col("value")).alias("value"))


@query("asof_price", """
  SELECT o_orderkey AS key_id, R6((SELECT arg_max(s.price, s.date) FROM series s
         WHERE s.card_id = card_id_of AND s.date <= CAST(o_orderdate AS DATE))) AS asof_price FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS card_id_of FROM orders)""")
def asof_price(t):
    keys = t.read("orders").select(
        F.col("o_orderkey").alias("key_id"), (F.col("o_custkey") % t.n_cards).alias("card_id"), F.to_date("o_orderdate").alias("day")
    )
    out = keys.join(S.daily_prices(t.series, ["card_id"], carried=True), "card_id", "left")
    return out.select("key_id", rnd(S.price_carried(F.col("day")), 6).alias("asof_price"))


@query("nearest_price", """
  SELECT o_orderkey AS key_id, R6((SELECT arg_min(s.price, (abs(s.date - CAST(o_orderdate AS DATE)), s.date)) FROM series s
         WHERE s.card_id = card_id_of AND abs(s.date - CAST(o_orderdate AS DATE)) <= 3)) AS near_price FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS card_id_of FROM orders)""")
def nearest_price(t):
    keys = t.read("orders").select(
        F.col("o_orderkey").alias("key_id"), (F.col("o_custkey") % t.n_cards).alias("card_id"), F.to_date("o_orderdate").alias("day")
    )
    out = keys.join(S.daily_prices(t.series, ["card_id"]), "card_id", "left")
    return out.select("key_id", rnd(S.price_near(F.col("day"), 3), 6).alias("near_price"))


@query("latest_price", "SELECT card_id, current_price FROM cards WHERE current_price IS NOT NULL")
def latest_price(t):
    return S.latest_price(t.price_history, t.catalogue)


view("weekly_items", """
  WITH i2 AS (SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'holofoil' WHEN 1 THEN 'normal' END AS pv FROM part),
  bars AS (SELECT item_id, CAST(order_date AS DATE) AS date, variant, condition FROM sales GROUP BY 1, 2, 3, 4),
  thick AS (SELECT item_id FROM bars GROUP BY 1 HAVING count(DISTINCT date) >= 30),
  busy AS (SELECT item_id FROM sales GROUP BY 1 HAVING count(*) >= 2),
  s AS (SELECT sales.item_id, CAST(date_trunc('week', order_date) AS DATE) AS date, condition, variant, purchase_price
        FROM sales JOIN i2 ON sales.item_id = i2.item_id AND sales.variant = coalesce(i2.pv, 'normal')
        WHERE sales.item_id NOT IN (SELECT item_id FROM thick) AND sales.item_id IN (SELECT item_id FROM busy)),
  w AS (SELECT item_id, date, condition, variant, quantile_cont(purchase_price, 0.5) AS med, min(purchase_price) AS lo,
               max(purchase_price) AS hi, count(*) AS n_sales FROM s GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
  SELECT w.item_id, w.date, w.condition, w.variant, R2(med) AS market_price, R2(lo) AS low_price, R2(med) AS mid_price,
         R2(hi) AS high_price, n_sales FROM w ANTI JOIN bars ON bars.item_id = w.item_id AND bars.date = w.date
         AND bars.condition = w.condition AND bars.variant = w.variant""")


@query("weekly_bars_from_sales", "SELECT * REPLACE (date::VARCHAR AS date) FROM weekly_items")
def weekly_bars_from_sales(t):
    return weekly_items(t)


@query("fill_current_prices", """
  SELECT item_id, CASE WHEN item_id % 4 > 1 THEN list_price ELSE coalesce(newest, CASE WHEN item_id % 4 = 1 THEN 0e0 END) END AS current_price FROM items LEFT JOIN (
    SELECT item_id, arg_max(market_price, (date, variant)) AS newest FROM weekly_items WHERE condition = 'Near Mint' GROUP BY 1) USING (item_id)""")
def fill_current_prices(t):
    """Prices of items without one from the weekly bars of their sales; every second item has one already."""
    k = F.col("item_id")
    old = F.when(k % 4 > 1, F.col("list_price")).when(k % 4 == 1, 0.0)
    return S.fill_current_prices(t.items.select("item_id", old.alias("current_price")), weekly_items(t), "item_id")


def weekly_items(t):
    key = F.col("item_id")
    items = t.items.select("item_id", F.when(key % 3 == 0, "holofoil").when(key % 3 == 1, "normal").alias("price_variant"))
    bars = t.sales.groupBy("item_id", F.to_date("order_date").alias("date"), "variant", "condition").agg(F.count("*").alias("c"))
    return S.weekly_bars_from_sales(t.sales, items, bars, key="item_id")


@query("daily_median_sma", """
  WITH m AS (SELECT card_id, CAST(order_date AS DATE) AS date, list_sort(list(purchase_price))[CAST(floor(count(*) / 2) AS INT) + 1] AS daily_median
             FROM sales GROUP BY 1, 2)
  SELECT card_id, date::VARCHAR AS date, R4(daily_median) AS daily_median,
    R4(CASE WHEN count(*) OVER w30 >= 2 THEN avg(daily_median) OVER w30 END) AS sma_30,
    R4(CASE WHEN count(*) OVER w180 >= 2 THEN avg(daily_median) OVER w180 END) AS sma_180
  FROM m WINDOW w30 AS (PARTITION BY card_id ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW),
                w180 AS (PARTITION BY card_id ORDER BY date RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW)""")
def daily_median_sma(t):
    out = S.daily_median_sma(S.daily_median_sma(A.daily_upper_median(t.sales), 30), 180)
    return out.select("card_id", "date", *[rnd(F.col(c), 4).alias(c) for c in ("daily_median", "sma_30", "sma_180")])


@query("series_overlay", """
  WITH k AS (SELECT *, least(90, greatest(60, CAST(floor(n * 0.6) AS INT))) AS lk FROM ser),
  r AS (SELECT *, sum(price) OVER (PARTITION BY card_id ORDER BY i) AS run FROM k)
  SELECT card_id, date::VARCHAR AS date, R4(price) AS price,
    R4(CASE WHEN i >= 30 THEN avg(price) OVER (PARTITION BY card_id ORDER BY i ROWS 29 PRECEDING) END) AS sma_30,
    R4(CASE WHEN i >= lk THEN (run - coalesce(lag(run, lk) OVER (PARTITION BY card_id ORDER BY i), 0)) / lk END) AS sma_long,
    R4(CASE WHEN i >= 20 THEN avg(price) OVER w + 2 * stddev_pop(price) OVER w END) AS bb_upper,
    R4(CASE WHEN i >= 20 THEN avg(price) OVER w END) AS bb_middle,
    R4(CASE WHEN i >= 20 THEN greatest(0, avg(price) OVER w - 2 * stddev_pop(price) OVER w) END) AS bb_lower
  FROM r WINDOW w AS (PARTITION BY card_id ORDER BY i ROWS 19 PRECEDING)""")
def series_overlay(t):
    out = S.series_overlay(t.series)
    return out.select("card_id", "date", *[rnd(F.col(c), 4).alias(c) for c in ("price", "sma_30", "sma_long", "bb_upper", "bb_middle", "bb_lower")])


@query("rebase_compare", """
  WITH p AS (SELECT card_id AS card_a, card_id + 1 AS card_b FROM catalogue WHERE card_id % 2 = 0),
  a AS (SELECT p.*, s.date, s.price AS pa FROM p JOIN series s ON s.card_id = card_a),
  b AS (SELECT p.*, s.date, s.price AS pb FROM p JOIN series s ON s.card_id = card_b),
  f AS (SELECT card_a, card_b, date, pa, pb FROM a FULL JOIN b USING (card_a, card_b, date)),
  z AS (SELECT card_a, card_b, min(date) AS d0 FROM f WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY 1, 2),
  base AS (SELECT z.card_a, z.card_b, f.pa AS ba, f.pb AS bb FROM z JOIN f ON f.card_a = z.card_a AND f.card_b = z.card_b AND f.date = z.d0)
  SELECT f.card_a, f.card_b, f.date::VARCHAR AS date, R4((pa - ba) / ba * 100) AS change_a, R4((pb - bb) / bb * 100) AS change_b
  FROM f LEFT JOIN base ON f.card_a = base.card_a AND f.card_b = base.card_b""")
def rebase_compare(t):
    pairs = t.catalogue.filter("card_id % 2 = 0").select(F.col("card_id").alias("card_a"), (F.col("card_id") + 1).alias("card_b"))
    out = S.rebase_compare(pairs, t.series)
    return out.select("card_a", "card_b", "date", *[rnd(F.col(c), 4).alias(c) for c in ("change_a", "change_b")])


@query("price_summary", """
  WITH r AS (SELECT s.*, row_number() OVER (PARTITION BY card_id ORDER BY date) AS j, count(*) OVER (PARTITION BY card_id) AS m
             FROM series s WHERE date >= (SELECT d - 90 FROM as_of)),
  q AS (SELECT *, (j - 1) % greatest(1, m // 12) = 0 AS hit FROM r)
  SELECT card_id, count(*) AS n_points, R4(arg_min(price, date)) AS first_price, R4(arg_max(price, date)) AS last_price,
    R4(max(price)) AS high, R4(min(price)) AS low, R4((arg_max(price, date) - arg_min(price, date)) / arg_min(price, date) * 100) AS change_pct,
    count(*) FILTER (WHERE hit) AS sample_points, R4(sum(price) FILTER (WHERE hit)) AS sample_sum FROM q GROUP BY 1""")
def price_summary(t):
    out = S.price_summary(t.series, t.as_of)
    return out.select(
        "card_id", "n_points", "sample_points",
        *[rnd(F.col(c), 4).alias(c) for c in ("first_price", "last_price", "high", "low", "change_pct", "sample_sum")],
    )


@query("price_samples", """
  SELECT card_id, date::VARCHAR AS date, R2(price) AS price FROM (
    SELECT s.*, row_number() OVER (PARTITION BY card_id ORDER BY date) AS j, count(*) OVER (PARTITION BY card_id) AS m FROM series s WHERE date >= (SELECT d - 90 FROM as_of))
  WHERE (j - 1) % greatest(1, m // 12) = 0""")
def price_samples(t):
    return S.price_samples(t.series, t.as_of)


@query("outlier_bounds", """
  WITH s AS (SELECT card_id, list_sort(list(price)) AS p, count(*) AS n, quantile_cont(price, 0.5) AS med FROM series GROUP BY 1),
  q AS (SELECT *, p[CAST(floor(n * 0.25) AS INT) + 1] AS q1, p[CAST(floor(n * 0.75) AS INT) + 1] AS q3, n >= 5 AND p[-1] > 5 * med AS spiky FROM s)
  SELECT card_id, R4(CASE WHEN spiky THEN p[CAST(floor(n * 0.9) AS INT) + 1] * 1.1 ELSE p[-1] END) AS cap,
    R4(CASE WHEN spiky THEN p[1] * 0.95 ELSE p[1] END) AS floor, R4(q3 + 2 * (q3 - q1)) AS upper_fence FROM q""")
def outlier_bounds(t):
    out = S.outlier_bounds(t.series)
    return out.select("card_id", *[rnd(F.col(c), 4).alias(c) for c in ("cap", "floor", "upper_fence")])
