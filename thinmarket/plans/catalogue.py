"""Lists, search, paging, ledgers' look-ups and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions import text as X
from thinmarket.functions.numeric import rnd
from thinmarket.operators import catalogue as C
from thinmarket.operators import picks as K
from thinmarket.plans.indicators import r4
from thinmarket.plans.registry import query, view
from thinmarket.session import reuse


@query("list_cards", "SELECT card_id, name, set_name, rarity, current_price FROM cards WHERE is_tracked AND name ILIKE '%000%' ORDER BY current_price DESC NULLS LAST, card_id LIMIT 20 OFFSET 20")
def list_cards(t):
    page, _ = C.list_cards(t.cards, q="000", sort_by="current_price", sort_dir="desc", page=2, page_size=20)
    return page.select("card_id", "name", "set_name", "rarity", "current_price")


@query("list_cards_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM cards WHERE is_tracked AND current_price IS NOT NULL AND rarity = 'Ultra Rare'")
def list_cards_total(t):
    return C.list_cards(t.cards, rarity="Ultra Rare", has_price=True, page_size=20)[1]


@query("list_cards_supertype", "SELECT card_id, name FROM cards WHERE is_tracked AND card_id % 8 = 4 ORDER BY name NULLS FIRST, card_id LIMIT 20")
def list_cards_supertype(t):
    kinds = t.cards.withColumn("supertype", F.when(F.col("card_id") % 8 == 4, "Energy").otherwise("Creature"))
    return C.list_cards(kinds, supertype="Energy", page_size=20)[0].select("card_id", "name")


@query("filter_values", "SELECT 'set_name' AS field, set_name AS value FROM items WHERE set_name IS NOT NULL UNION SELECT 'rarity', rarity FROM items WHERE rarity IS NOT NULL")
def filter_values(t):
    return C.filter_values(t.items)


@query("card_with_set", "SELECT card_id, name, c.set_name, k AS set_total_cards, release_date::VARCHAR AS release_date FROM catalogue c LEFT JOIN card_sets s USING (set_id) LEFT JOIN (SELECT set_id, count(*) AS k FROM catalogue GROUP BY 1) USING (set_id)")
def card_with_set(t):
    counts = t.catalogue.groupBy("set_id").agg(F.count("*").alias("set_total_cards"))
    sets = t.card_sets.select("set_id", "release_date").join(counts, "set_id", "left")
    return C.card_with_set(t.catalogue, sets).select("card_id", "name", "set_name", "set_total_cards", "release_date")


view("item_cards", "SELECT i.*, p.current_price FROM items i JOIN (SELECT item_id, round(arg_max(price, date) + 1e-9, 2) AS current_price FROM item_prices GROUP BY 1) p USING (item_id)")
_BASE = r"""CASE WHEN trim(regexp_split_to_array(name, '\s+(ex|EX|GX|V|VMAX|VSTAR|BREAK|LV\.X|TAG TEAM|Prism Star)\b')[1]) = '' THEN name
  ELSE trim(regexp_split_to_array(name, '\s+(ex|EX|GX|V|VMAX|VSTAR|BREAK|LV\.X|TAG TEAM|Prism Star)\b')[1]) END"""


def item_cards(t):
    prices = t.item_last_prices.groupBy("item_id").agg(rnd(F.max_by("price", "date")).alias("current_price"))
    return reuse(t.items.join(prices, "item_id"))


@query("similar_cards", f"""
  WITH b AS (SELECT *, lower({_BASE}) AS base, lower(name) AS low FROM item_cards WHERE current_price > 0),
  r AS (SELECT b.item_id, 'namesake' AS kind, o.item_id AS similar_id, o.name, o.set_name, o.current_price FROM b JOIN b o ON contains(o.low, b.base) AND o.set_name <> b.set_name
        QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY o.current_price DESC, o.item_id) <= 3
        UNION ALL SELECT b.item_id, 'same_set', o.item_id, o.name, o.set_name, o.current_price FROM b JOIN b o ON NOT contains(o.low, b.base) AND o.set_name = b.set_name
        QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY o.current_price DESC, o.item_id) <= 3),
  old AS (SELECT item_id AS oid, arg_max(price, date) AS p FROM item_prices, as_of WHERE date <= d - 7 GROUP BY 1)
  SELECT item_id, kind, similar_id, name, set_name, current_price, CASE WHEN abs((current_price - p) / p * 100) <= 500 THEN R2((current_price - p) / p * 100) END AS price_change_7d
  FROM r LEFT JOIN old ON oid = similar_id""")
def similar_cards(t):
    # The newest sale is on the last day of its item: the sales need not be read again.
    as_of = t.item_last_prices.agg(F.max("date")).scalar()
    return C.similar_cards(item_cards(t), t.item_last_prices, as_of, key="item_id", keep=reuse)


@query("market_ticker", "SELECT card_id, name, current_price FROM cards WHERE is_tracked AND current_price > 0 ORDER BY current_price DESC, card_id LIMIT 20")
def market_ticker(t):
    return C.market_ticker(t.cards).select("card_id", "name", "current_price")


@query("search_by_tier", """SELECT item_id, name, current_price, 'mid_high' AS tier FROM item_cards WHERE current_price >= 50 AND current_price < 100 AND current_price >= 55 ORDER BY current_price DESC, item_id LIMIT 20""")
def search_by_tier(t):
    rows = item_cards(t).withColumn("is_viable", F.col("current_price") >= E.MIN_VIABLE_PRICE).withColumnRenamed("item_id", "card_id")
    out = C.search_by_tier(rows, tier="mid_high", min_price=55.0)
    return out.select(F.col("card_id").alias("item_id"), "name", "current_price", "tier")


@query("trade_blotter", "SELECT trade_id, card_id, name, set_name, side, quantity, R4(price) AS price FROM (SELECT * FROM trades WHERE side = 'sell' ORDER BY executed_at DESC, trade_id DESC LIMIT 50 OFFSET 10) LEFT JOIN catalogue USING (card_id)")
def trade_blotter(t):
    return r4(C.trade_blotter(t.trades, t.catalogue, side="sell", offset=10), "trade_id", "card_id", "name", "set_name", "side", "quantity", "price")


@query("list_insights", """SELECT insight_id, type, severity, card_id, json_extract_string(metadata_json, '$.k') AS k FROM insights WHERE severity = 'notable' AND NOT acknowledged ORDER BY created_at DESC, insight_id DESC LIMIT 50""")
def list_insights(t):
    out = C.list_insights(t.insights, severity="notable", acknowledged=False)
    return out.select("insight_id", "type", "severity", "card_id", F.col("metadata")["k"].alias("k"))


@query("alerts_for_user", """SELECT alert_id, email, card_id, c.name, current_price, CASE WHEN is_active THEN 'active' ELSE 'history' END AS status
  FROM alerts a LEFT JOIN cards c USING (card_id) WHERE is_active OR last_triggered_at IS NOT NULL""")
def alerts_for_user(t):
    return C.alerts_for_user(t.alerts, t.cards).select("alert_id", "email", "card_id", "name", "current_price", "status")


@query("sales_list", """SELECT card_id, seq, item_id, R4(purchase_price) AS purchase_price, rn::INT AS rn,
    R4((list_sort(list(purchase_price) OVER (PARTITION BY card_id)))[CAST(floor(count(*) OVER (PARTITION BY card_id) / 2) AS INT) + 1]) AS median_price
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY order_date DESC, seq DESC, item_id DESC, purchase_price DESC) AS rn FROM sales) WHERE rn <= 20""")
def sales_list(t):
    return r4(C.sales_list(t.sales), "card_id", "seq", "item_id", "purchase_price", "rn", "median_price")


@query("analysis_history", "SELECT event_id AS analysis_id, ts::VARCHAR AS created_at, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 END::INT AS n_picks FROM events")
def analysis_history(t):
    props = F.col("props")
    picks = F.when(F.col("event_id") % 3 == 0, props).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.concat(F.lit("["), props, F.lit(","), props, F.lit("]")))
    rows = t.read("events").select(F.col("event_id").alias("analysis_id"), F.col("ts").alias("created_at"), picks.alias("picks_json"))
    return C.analysis_history(rows)


@query("normalize_name", "SELECT item_id, trim(replace(replace(lower(name), '-', ' '), '.', '')) || '|' || trim(replace(lower(set_name), '-', ' ')) AS key FROM items")
def normalize_name(t):
    return t.items.select("item_id", X.name_key(F.col("name"), F.col("set_name")).alias("key"))


@query("base_name", f"SELECT item_id, {_BASE} AS base_name FROM items")
def base_name(t):
    return t.items.select("item_id", X.base_name(F.col("name")).alias("base_name"))


@query("parse_signal_tier", """SELECT doc_id, CASE WHEN contains(u, 'BUY NOW') THEN 'buy' WHEN contains(u, 'ACCUMULATE') AND NOT contains(u, 'PULLBACK') THEN 'accumulate' WHEN contains(u, 'ACCUMULATE') THEN 'watch'
    WHEN contains(u, 'WATCH') THEN 'watch' ELSE 'hold' END AS signal,
    CASE WHEN contains(lower(text), 'premium') THEN 'premium' WHEN contains(lower(text), 'mid-high') OR contains(lower(text), 'mid high') THEN 'mid_high' WHEN contains(lower(text), 'mid') THEN 'mid' END AS tier
  FROM (SELECT doc_id, text, upper(text) AS u FROM documents)""")
def parse_signal_tier(t):
    return t.read("documents").select("doc_id", X.parse_signal(F.col("text")).alias("signal"), X.parse_tier(F.col("text")).alias("tier"))


def recommendation_texts(t):
    """One text per customer: its orders as numbered recommendations."""
    o = t.read("orders").select(
        F.col("o_custkey").alias("text_id"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + F.col("o_custkey") % 90).alias("card_id"),
        (F.col("o_totalprice") / 1000).alias("price"), F.col("o_orderpriority").alias("prio"),
    ).join(t.catalogue.select("card_id", "name", "set_name"), "card_id")
    advice = F.when(F.substring("prio", 1, 1) == "1", "BUY NOW").when(F.substring("prio", 1, 1) == "2", "ACCUMULATE on PULLBACK").when(F.substring("prio", 1, 1) == "3", "ACCUMULATE").otherwise("HOLD")
    line = F.concat(
        (F.col("k") % 1000).cast("string"), F.lit(". **"), F.col("name"), F.lit("** — "), F.col("set_name"), F.lit(" — $"), F.format_number("price", 2),
        F.lit(" — "), F.when(F.col("k") % 2 == 0, "Premium").otherwise("Mid-High"), F.lit("\n   Strategy: "), advice, F.lit("\n"),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "")
    return o.groupBy("text_id").agg(F.concat(F.lit("Intro\n1. ignored\nPORTFOLIO RECOMMENDATIONS\n"), lines, F.lit("\nWATCHLIST\n9. nothing\n")).alias("text"))


@query("extract_picks", """
  WITH o AS (SELECT o_custkey AS text_id, o_orderkey AS k, o_orderkey % 7 + o_custkey % 90 AS card_id, round(o_totalprice / 1000 + 1e-12, 2) AS price, substr(o_orderpriority, 1, 1) AS prio FROM orders),
  b AS (SELECT o.*, c.current_price, row_number() OVER (PARTITION BY text_id ORDER BY k) AS block FROM o JOIN cards c USING (card_id)),
  ok AS (SELECT *, row_number() OVER (PARTITION BY text_id, card_id ORDER BY block) AS seen FROM b WHERE current_price > 0 AND abs(current_price - price) / greatest(price, 1) <= 0.75)
  SELECT text_id, block::INT AS block, card_id, CASE WHEN k % 2 = 0 THEN 'premium' ELSE 'mid_high' END AS price_tier,
    CASE prio WHEN '1' THEN 'buy' WHEN '2' THEN 'watch' WHEN '3' THEN 'accumulate' ELSE 'hold' END AS signal FROM ok WHERE seen = 1""")
def extract_picks(t):
    return K.extract_picks(recommendation_texts(t), t.cards)
