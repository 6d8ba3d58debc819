"""Ingest jobs over feed documents that Spark derives from the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import screener as G
from thinmarket.plans.indicators import r4
from thinmarket.plans.registry import query, view
from thinmarket.session import checkpoint_root
from thinmarket.sources import feeds, sinks

D6 = 6


def price_files(t):
    """One price document per card: variant-condition to history to daily cents; half are wrapped."""
    day = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("k"),
        F.struct((F.col("market_price") * 100).alias("avg"), (F.col("low_price") * 100).alias("min"), (F.col("high_price") * 100).alias("max"), F.lit(1).alias("count")).alias("v"),
    )
    cond = F.when(F.col("condition") == "Near Mint", "nearmint").otherwise("good")
    per = t.price_history.groupBy("card_id", F.concat_ws("-", "variant", cond).alias("k")).agg(F.struct(F.map_from_entries(F.collect_list(day)).alias("history")).alias("v"))
    docs = per.groupBy("card_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("doc"))
    content = F.when(F.col("card_id") % 2 == 0, F.col("doc")).otherwise(F.concat(F.lit('{"data":'), F.col("doc"), F.lit("}")))
    return docs.select(F.concat(F.lit("/landing/en/set/"), F.col("card_id").cast("string"), F.lit(".tcgplayer.json")).alias("path"), content.alias("content"))


view("combo", """
  SELECT h.* FROM price_history h JOIN (SELECT card_id, arg_max((variant, condition), (k, CASE condition WHEN 'Near Mint' THEN 20 ELSE 10 END + CASE variant WHEN 'holofoil' THEN 3 WHEN 'reverseHolofoil' THEN 2 ELSE 1 END)) AS b
    FROM (SELECT card_id, variant, condition, count(*) AS k FROM price_history GROUP BY 1, 2, 3) GROUP BY 1) c ON c.card_id = h.card_id AND c.b = (h.variant, h.condition)""")


@query("pick_variant_condition", "SELECT 'set-' || card_id AS tcg_id, date::VARCHAR AS date, variant, CASE condition WHEN 'Near Mint' THEN 'nearmint' ELSE 'good' END AS condition, R4(market_price) AS market_price FROM combo")
def pick_variant_condition(t):
    out = feeds.pick_variant_condition(feeds.parse_price_json(price_files(t)))
    return r4(out, "tcg_id", "date", "variant", "condition", "market_price")


@query("ingest_price_json", """
  SELECT 'set-' || card_id AS tcg_id, date::VARCHAR AS date, variant, R4(market_price) AS market_price, R4(low_price) AS low_price, R4(high_price) AS high_price FROM combo
  WHERE card_id % 5 <> 0 AND card_id IN (SELECT card_id FROM combo GROUP BY 1 HAVING max(market_price) >= 1040) AND NOT (card_id % 3 = 0 AND year(date) = 1999)""")
def ingest_price_json(t):
    name = F.concat(F.lit("set-"), F.col("card_id").cast("string")).alias("tcg_id")
    tracked = t.catalogue.filter("is_tracked").select(name)
    have = t.price_history.filter("card_id % 3 = 0 AND year(date) = 1999").select(name, "date", "variant")
    out = feeds.ingest_price_json(price_files(t), 104000, tracked, have)
    return r4(out, "tcg_id", "date", "variant", "market_price", "low_price", "high_price")


def csv_rows(t):
    """Item sales as rows of a history CSV: mixed date formats, blanks, prices with signs."""
    i = F.col("item_id")
    day = F.when(i % 6 == 0, F.date_format("order_date", "yyyy-MM-dd")).when(i % 6 == 3, F.date_format("order_date", "yyyy-MM-dd'T23:30:00.5-07:00'")).when(i % 3 == 1, F.date_format("order_date", "MM/dd/yyyy")).otherwise(F.date_format("order_date", "MMMM d, yyyy"))
    amount = F.format_string("$%.2f", F.round(F.col("purchase_price") + 1e-9, 2))
    rows = t.sales.join(t.items.select("item_id", "name", "set_name"), "item_id")
    return rows.select(
        (F.col("seq") * 100000 + i).alias("line"), F.when(i % 50 == 7, F.lit("unknown thing")).otherwise(F.upper("name")).alias("product-name"), F.col("set_name").alias("console"), day.alias("date"),
        F.when(F.col("quantity") % 9 == 0, "N/A").otherwise(amount).alias("loose_price"), F.when(F.col("quantity") % 2 == 0, amount).otherwise("").alias("cib_price"),
    )


@query("ingest_price_csv", """
  WITH p AS (SELECT seq * 100000 + s.item_id AS line, s.item_id, CAST(order_date AS DATE) AS date, R2(purchase_price) AS a, quantity, i.name, i.set_name FROM sales s JOIN items i USING (item_id)),
  k2 AS (SELECT lower(name) AS n, lower(set_name) AS s, max(item_id) AS id FROM items GROUP BY 1, 2),
  r AS (SELECT line, date, CASE WHEN item_id % 50 = 7 THEN NULL ELSE k2.id END AS card_id, CASE WHEN quantity % 9 <> 0 THEN a END AS lo, CASE WHEN quantity % 2 = 0 THEN a END AS hi FROM p LEFT JOIN k2 ON k2.n = lower(p.name) AND k2.s = lower(p.set_name)),
  u AS (SELECT *, coalesce(lo, hi) AS m, card_id IS NOT NULL AND coalesce(lo, hi) IS NOT NULL AS ok FROM r),
  f AS (SELECT *, line = min(CASE WHEN ok THEN line END) OVER (PARTITION BY card_id, date) AS first FROM u)
  SELECT CASE WHEN card_id IS NULL THEN 'unmatched' WHEN m IS NULL THEN 'skipped' WHEN (card_id, date) IN (SELECT (item_id, CAST(order_date AS DATE)) FROM sales WHERE item_id % 4 = 0 AND year(order_date) = 2000) OR NOT first THEN 'duplicate' ELSE 'new' END AS status, count(*) AS n, R2(sum(m)) AS market, R2(sum(R2((m + hi) / 2))) AS mid FROM f GROUP BY 1""")
def ingest_price_csv(t):
    cards = t.items.select(F.col("item_id").alias("card_id"), "name", "set_name", F.lit(None).cast("string").alias("price_variant"))
    have = t.sales.filter("item_id % 4 = 0 AND year(order_date) = 2000").select(F.col("item_id").alias("card_id"), F.to_date("order_date").alias("date"), F.lit("normal").alias("variant"))
    out = feeds.ingest_price_csv(csv_rows(t), cards, have)
    return out.groupBy("status").agg(F.count("*").alias("n"), rnd(F.sum("market_price")).alias("market"), rnd(F.sum("mid_price")).alias("mid"))


def entries(t):
    name = F.when(F.col("variant") == "holofoil", "Holofoil").when(F.col("variant") == "normal", "Normal").otherwise("Reverse Holofoil")
    per = t.price_history.groupBy("card_id", "variant").agg(F.avg("market_price").alias("m"), F.avg("mid_price").alias("d"), F.min("low_price").alias("lo"), F.max("high_price").alias("hi"))
    gone = (F.col("card_id") % 4 == 0) & (F.col("variant") != "reverseHolofoil")
    return per.select(
        (F.col("card_id") + 5000).alias("productId"), name.alias("subTypeName"), F.when(~gone, F.col("m")).alias("marketPrice"), F.col("lo").alias("lowPrice"),
        F.col("d").alias("midPrice"), F.col("hi").alias("highPrice"), F.length("variant").alias("pos"),
    )


view("entry", """SELECT card_id + 5000 AS product_id, card_id, variant, CASE WHEN card_id % 4 <> 0 OR variant = 'reverseHolofoil' THEN avg(market_price) END AS m, avg(mid_price) AS dd, min(low_price) AS lo, max(high_price) AS hi FROM price_history GROUP BY 1, 2, 3""")
view("best_entry", """SELECT e.*, c.price_variant, c.current_price, c.is_tracked FROM entry e JOIN cards c USING (card_id)
  QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY CASE WHEN e.variant = c.price_variant AND m IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN m IS NULL THEN 1 ELSE 0 END, CASE e.variant WHEN 'holofoil' THEN 0 WHEN 'reverseHolofoil' THEN 1 ELSE 2 END) = 1""")


def mapped_cards(t):
    stale = (F.col("card_id") % 20).cast("int")
    return t.cards.withColumn("product_id", F.col("card_id") + 5000).withColumn("updated_at", F.when(F.col("card_id") % 6 != 0, F.date_sub(t.as_of, stale).cast("timestamp")))


@query("best_price_entry", "SELECT product_id, variant, R4(m) AS market_price FROM best_entry")
def best_price_entry(t):
    out = feeds.best_price_entry(entries(t), mapped_cards(t).select(F.col("product_id").alias("productId"), "price_variant"))
    return out.select(F.col("productId").alias("product_id"), "variant", rnd(F.col("marketPrice"), 4).alias("market_price"))


view("decided", """SELECT *, CASE WHEN current_price > 0 AND NOT (p / current_price BETWEEN CASE WHEN stale > 7 THEN 0.1 ELSE 0.33 END AND CASE WHEN stale > 7 THEN 10 ELSE 3 END) THEN 'skipped_sanity'
    WHEN price_variant IS NULL OR variant = price_variant THEN 'updated' ELSE 'history_only' END AS status FROM (
    SELECT *, coalesce(m, dd) AS p, CASE WHEN card_id % 6 = 0 THEN 999 ELSE card_id % 20 END AS stale FROM best_entry WHERE is_tracked)""")


@query("bulk_price_update", "SELECT card_id, status, R2(p) AS price, variant FROM decided")
def bulk_price_update(t):
    out = feeds.bulk_price_update(mapped_cards(t), entries(t), t.as_of)
    return out.select("card_id", "status", rnd(F.col("price")).alias("price"), "variant")


@query("bulk_history_rows", """SELECT x.card_id, d::VARCHAR AS date, variant, R2(p) AS market_price, R2(lo) AS low_price, R2(hi) AS high_price FROM decided x, as_of
  WHERE status <> 'skipped_sanity' AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.card_id = x.card_id AND h.date = d AND h.variant = x.variant AND h.condition = 'Near Mint')""")
def bulk_history_rows(t):
    decided = feeds.bulk_price_update(mapped_cards(t), entries(t), t.as_of)
    return feeds.bulk_history_rows(decided, t.price_history, t.as_of).select("card_id", "date", "variant", "market_price", "low_price", "high_price")


@query("upsert_catalogue", """
  WITH o AS (SELECT 'id-' || card_id AS tcg_id, name, rarity, price_variant, current_price, 'old' AS image FROM cards WHERE card_id % 4 <> 0),
  f AS (SELECT 'id-' || card_id AS n_id, CASE WHEN card_id % 3 = 0 THEN upper(name) ELSE name || ' new' END AS n_name, CASE WHEN card_id % 7 = 0 THEN NULL ELSE R2(current_price * 1.1e0) END AS mk FROM cards WHERE card_id % 2 = 0),
  j AS (SELECT *, CASE WHEN n_id IS NULL THEN 'kept' WHEN mk IS NULL THEN 'skipped_no_price' WHEN mk < 50 THEN 'skipped_cheap' WHEN tcg_id IS NOT NULL THEN 'updated' ELSE 'created' END AS status FROM o FULL JOIN f ON tcg_id = n_id)
  SELECT coalesce(tcg_id, n_id) AS tcg_id, CASE WHEN status IN ('updated', 'created') THEN n_name ELSE name END AS name, CASE WHEN status IN ('updated', 'created') THEN mk ELSE current_price END AS current_price,
    CASE WHEN status = 'created' OR (status = 'updated' AND lower(n_name) = lower(name)) THEN 'new' ELSE image END AS image, status FROM j WHERE tcg_id IS NOT NULL OR status = 'created'""")
def upsert_catalogue(t):
    return upserted(t).select("tcg_id", "name", "current_price", "image", "status")


def upserted(t):
    tcg = F.concat(F.lit("id-"), F.col("card_id").cast("string")).alias("tcg_id")
    sid = F.col("set_id").cast("string").alias("set_id")
    old = t.cards.filter("card_id % 4 <> 0").select(tcg, "name", sid, "set_name", "rarity", "price_variant", "current_price", F.lit("old").alias("image"))
    name = F.when(F.col("card_id") % 3 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" new"))).alias("name")
    market = F.when(F.col("card_id") % 7 != 0, rnd(F.col("current_price") * 1.1)).alias("market")
    feed = t.cards.filter("card_id % 2 = 0").select(tcg, name, sid, "set_name", "rarity", F.col("price_variant").alias("variant"), market, F.lit("new").alias("image"))
    return feeds.upsert_catalogue(old, feed, t.as_of, 50.0)


@query("feed_history_rows", """
  WITH x AS (SELECT 'id-' || card_id AS tcg_id, card_id, price_variant AS variant, R2(current_price * 1.1e0) AS market_price FROM cards WHERE card_id % 2 = 0 AND card_id % 7 <> 0)
  SELECT tcg_id, d::VARCHAR AS date, variant, 'Near Mint' AS condition, market_price FROM x, as_of
  WHERE market_price >= 50 AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.card_id = x.card_id AND h.date = d AND h.variant = x.variant AND h.card_id % 5 <> 0)""")
def feed_history_rows(t):
    """History rows of the feed's day; bars of every fifth card are not stored yet."""
    have = t.price_history.filter("card_id % 5 <> 0").select(F.concat(F.lit("id-"), F.col("card_id").cast("string")).alias("tcg_id"), "date", "variant")
    return feeds.feed_history_rows(upserted(t), have, t.as_of)


@query("ingest_history_buckets", """SELECT card_id AS product_id, date::VARCHAR AS date, R2(price) AS market_price, R2(low) AS low_price, R2(high) AS high_price FROM series WHERE NOT (card_id % 2 = 0 AND year(date) = 1998)""")
def ingest_history_buckets(t):
    def text(c):
        return F.col(c).cast("string")

    b = F.struct(F.date_format("date", "yyyy-MM-dd").alias("bucketStartDate"), text("price").alias("marketPrice"), text("low").alias("lowSalePrice"), text("high").alias("highSalePrice"), F.lit("3").alias("quantitySold"))
    per = t.series.groupBy(F.col("card_id").alias("product_id")).agg(F.collect_list(b).alias("b"))
    docs = per.select("product_id", F.to_json(F.struct(F.array(
        F.struct(F.lit("Lightly Played").alias("condition"), F.slice("b", 1, 1).alias("buckets")), F.struct(F.lit("Near Mint Holofoil").alias("condition"), F.col("b").alias("buckets")),
    ).alias("result"))).alias("content"))
    have = t.series.filter("card_id % 2 = 0 AND year(date) = 1998").select(F.col("card_id").alias("product_id"), "date")
    return feeds.ingest_history_buckets(docs, have).drop("quantity_sold")


@query("ingest_daily_sales", """SELECT 'tcg-hist-' || card_id || '-' || CAST(order_date AS DATE) || '-' || variant AS listing_id, card_id AS product_id, (CAST(order_date AS DATE) || ' 12:00:00') AS order_date, R4(avg(purchase_price)) AS purchase_price,
  sum(quantity)::INT AS quantity, 'Daily avg: ' || sum(quantity) || ' sales' AS listing_title FROM sales WHERE card_id % 10 <> 3 GROUP BY card_id, CAST(order_date AS DATE), variant""")
def ingest_daily_sales(t):
    per = t.sales.groupBy("card_id", F.to_date("order_date").alias("d"), "variant").agg(F.avg("purchase_price").alias("a"), F.sum("quantity").alias("q"))
    avg = F.when(F.col("card_id") % 10 == 3, "n/a").otherwise(F.col("a").cast("string"))
    v = F.struct("variant", avg.alias("averageSalesPrice"), F.col("q").cast("string").alias("quantity"), F.lit("0").alias("marketPrice"))
    days = per.groupBy("card_id", "d").agg(F.collect_list(v).alias("variants"))
    docs = days.groupBy(F.col("card_id").alias("product_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), "variants")).alias("result"))).alias("content"))
    return r4(feeds.ingest_daily_sales(docs), "listing_id", "product_id", "order_date", "purchase_price", "quantity", "listing_title")


@query("ingest_entries_flex", "SELECT card_id, date::VARCHAR AS date, coalesce(price_variant, 'normal') AS variant, R4(price) AS market_price, R4(low) AS low_price, R4(CASE WHEN card_id % 2 = 0 THEN high END) AS high_price FROM series JOIN catalogue USING (card_id)")
def ingest_entries_flex(t):
    return r4(feeds.ingest_entries_flex(flex_files(t)), "card_id", "date", "variant", "market_price", "low_price", "high_price")


@query("entries_latest_price", "SELECT card_id, R4(arg_max(price, date)) AS current_price FROM series GROUP BY 1")
def entries_latest_price(t):
    """Card prices that the entries imply, of the latest date in any envelope."""
    return r4(feeds.latest_of(feeds.ingest_entries_flex(flex_files(t))))


def flex_files(t):
    k = F.col("card_id") % 3
    price = F.col("price").cast("string")
    day = F.date_format("date", "yyyy-MM-dd")
    e = F.struct(
        F.when(k == 0, day).alias("date"), F.when(k != 0, F.concat(day, F.lit("T10:00:00Z"))).alias("updatedAt"), F.when(k == 0, price).alias("market"), F.when(k == 1, price).alias("price"),
        F.when(k == 2, price).alias("market_price"), F.col("low").cast("string").alias("low"), F.when(F.col("card_id") % 2 == 0, F.col("high")).otherwise(-F.col("high")).cast("string").alias("high"),
    )
    per = t.series.groupBy("card_id").agg(F.to_json(F.collect_list(e)).alias("a"))
    content = F.when(F.col("card_id") % 3 == 0, F.col("a")).when(F.col("card_id") % 3 == 1, F.concat(F.lit('{"data":'), F.col("a"), F.lit("}"))).otherwise(F.concat(F.lit('{"prices":'), F.col("a"), F.lit("}")))
    return per.join(t.catalogue.select("card_id", "price_variant"), "card_id").select("card_id", "price_variant", content.alias("content"))


def raw_sales(t):
    return t.sales.select(
        (F.col("seq") * 100000 + F.col("item_id")).alias("pos"), F.col("card_id").alias("product_id"), "seq",
        F.when(F.col("seq") % 97 == 0, "bad").otherwise(F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("orderDate"),
        F.col("purchase_price").alias("purchasePrice"), "condition", F.lit(None).cast("string").alias("customListingId"),
    )


@query("dedup_sales", """
  WITH r AS (SELECT *, seq * 100000 + item_id AS pos, CASE WHEN seq % 97 = 0 THEN 'bad' ELSE order_date::VARCHAR END AS od FROM sales),
  n AS (SELECT DISTINCT card_id, od, purchase_price, condition FROM r WHERE seq % 5 = 0), o AS (SELECT DISTINCT card_id, od, purchase_price FROM r WHERE seq % 11 = 0),
  t AS (SELECT r.*, n.card_id IS NOT NULL OR o.card_id IS NOT NULL AS known, pos = min(pos) OVER (PARTITION BY r.card_id, r.od, r.purchase_price, r.condition) AS first
    FROM r LEFT JOIN n ON n.card_id = r.card_id AND n.od = r.od AND n.purchase_price = r.purchase_price AND n.condition = r.condition LEFT JOIN o ON o.card_id = r.card_id AND o.od = r.od AND o.purchase_price = r.purchase_price)
  SELECT card_id AS product_id, CASE WHEN known THEN 'duplicate' WHEN od = 'bad' THEN 'error' WHEN NOT first THEN 'duplicate' ELSE 'new' END AS status, count(*) AS n FROM t GROUP BY 1, 2""")
def dedup_sales(t):
    raw = raw_sales(t)
    keyed = feeds.sale_keys(raw)
    have = keyed.filter("seq % 5 = 0").select("listing_id").unionByName(keyed.filter("seq % 11 = 0").select(F.col("old_key").alias("listing_id")))
    return feeds.dedup_sales(raw, have).groupBy("product_id", "status").agg(F.count("*").alias("n"))


@query("price_from_sales_batch", "SELECT item_id, R2(list_sort(list(purchase_price))[CAST(floor(count(*) / 2) AS INT) + 1]) AS current_price FROM sales GROUP BY 1")
def price_from_sales_batch(t):
    return feeds.price_from_sales_batch(t.sales.withColumnRenamed("purchase_price", "purchasePrice"), "item_id")


def product_feed(t):
    k = F.col("card_id")
    groups = t.read("nation").select(F.col("n_nationkey").cast("long").alias("groupId"), F.concat(F.lit("SV03: "), F.col("n_name")).alias("name"))
    # Padded, never cut: ids may have more than six digits.
    digits = F.lpad(k.cast("string"), F.greatest(F.lit(6), F.length(k.cast("string"))), "0")
    number = F.when(k % 9 != 0, F.concat(digits, F.lit("/200")))
    ext = F.array_compact(F.array(F.when(number.isNotNull(), F.struct(F.lit("Number").alias("name"), number.alias("value"))), F.struct(F.lit("Rarity").alias("name"), F.col("rarity").alias("value"))))
    products = t.catalogue.select((k + 5000).alias("productId"), F.col("set_id").alias("groupId"), F.concat("name", F.lit(" - 12/34")).alias("name"), ext.alias("extendedData"))
    cards = t.catalogue.select(
        "card_id", F.when(k % 11 == 0, "custom").otherwise("card").alias("kind"), F.concat(F.lit("id-"), k.cast("string")).alias("tcg_id"), "name", "set_id", "set_name", "is_tracked",
        F.when(k % 4 != 0, k.cast("string")).otherwise("x").alias("number"), F.when(k % 5 == 0, k + 5000).alias("product_id"),
    ).filter("card_id % 13 <> 0")
    return groups, products, cards


@query("map_products_to_cards", """SELECT k + 5000 AS product_id, CASE WHEN k % 13 <> 0 THEN k END AS card_id, CASE WHEN k % 13 = 0 THEN 'unmatched' WHEN k % 5 = 0 THEN 'already_mapped' ELSE 'mapped' END AS status FROM (SELECT card_id AS k FROM catalogue) WHERE k % 9 <> 0""")
def map_products_to_cards(t):
    out = feeds.map_products_to_cards(*product_feed(t))
    return out.withColumnRenamed("productId", "product_id")


@query("discover_products", """
  SELECT k + 5000 AS product_id, CASE WHEN k % 13 <> 0 AND k % 5 = 0 THEN CASE WHEN is_tracked THEN 'already_tracked' ELSE 're_track' END WHEN k % 13 <> 0 AND k % 4 <> 0 THEN 'map_existing' ELSE 'create' END AS action, price FROM (
    SELECT c.card_id AS k, is_tracked, (SELECT R2(coalesce(m, dd)) FROM entry e WHERE e.card_id = c.card_id ORDER BY CASE WHEN m IS NULL THEN 1 ELSE 0 END, CASE variant WHEN 'holofoil' THEN 0 WHEN 'reverseHolofoil' THEN 1 ELSE 2 END LIMIT 1) AS price FROM catalogue c)
  WHERE k % 9 <> 0 AND price >= 525""")
def discover_products(t):
    groups, products, cards = product_feed(t)
    return feeds.discover_products(groups, products, entries(t), cards, 525.0).select(F.col("productId").alias("product_id"), "action", "price")


@query("match_product_listing", """SELECT card_id, CASE WHEN card_id % 4 = 0 THEN 1 WHEN card_id % 4 = 1 THEN 2 WHEN card_id % 4 = 2 THEN 3 ELSE 5 END::INT AS tier, card_id * 10 + CASE WHEN card_id % 4 = 3 THEN 1 ELSE 2 END AS product_id FROM catalogue""")
def match_product_listing(t):
    return feeds.match_product_listing(*listings(t))


def listings(t):
    k = F.col("card_id")
    cards = t.catalogue.select("card_id", "name", "set_name", F.concat(F.lit("n"), k.cast("string")).alias("number"))
    title = F.when(k % 4 == 0, F.concat(F.lit("other #n"), k.cast("string"))).when(k % 4 == 1, F.col("name")).when(k % 4 == 2, F.concat(F.col("name"), F.lit(" foil"))).otherwise(F.lit("nothing"))
    offers = F.array(
        F.struct(F.lit(1).alias("pos"), (k * 10 + 1).alias("product_id"), F.concat(F.lit("a "), "name", F.lit(" promo")).alias("product_name"), F.lit("Elsewhere").alias("product_set"), F.lit("0").alias("product_number")),
        F.struct(F.lit(2).alias("pos"), (k * 10 + 2).alias("product_id"), title.alias("product_name"), F.concat(F.lit("SV1: "), "set_name").alias("product_set"), F.lit("0").alias("product_number")),
    )
    return cards, t.catalogue.select("card_id", F.inline(offers))


@query("resolve_products", """
  WITH own AS (SELECT card_id, arg_min(pid, (order_date, pid)) AS sold FROM (SELECT card_id, order_date, card_id * 10 + 7 + quantity * 100000 AS pid FROM sales WHERE card_id % 3 = 0 AND seq % 2 = 1) GROUP BY 1)
  SELECT card_id, CASE WHEN card_id % 5 = 0 THEN card_id * 1000 WHEN sold IS NOT NULL THEN sold WHEN card_id % 7 <> 0 THEN card_id * 10 + CASE WHEN card_id % 4 IN (0, 1) THEN 2 ELSE 1 END END AS product_id,
    CASE WHEN card_id % 5 = 0 THEN 'mapped' WHEN sold IS NOT NULL THEN 'sales' WHEN card_id % 7 <> 0 THEN 'search' END AS via FROM catalogue LEFT JOIN own USING (card_id)""")
def resolve_products(t):
    """Mapped ids, then ids of own sales, then the short chain of search tiers."""
    cards, found = listings(t)
    k = F.col("card_id")
    number = F.when(F.col("seq") % 2 == 1, (k * 10 + 7 + F.col("quantity") * 100000).cast("string")).otherwise("n/a")
    sold = t.sales.filter("card_id % 3 = 0").select("card_id", "order_date", number.alias("source_product_id"))
    return feeds.resolve_products(cards.withColumn("product_id", F.when(k % 5 == 0, k * 1000)), sold, found.filter("card_id % 7 <> 0"), "short")


@query("extract_articles")
def extract_articles(t):
    """Whole text of every page: no SQL twin, the fixture test checks the parsing."""
    return feeds.extract_articles(t.read("pages"), finance_only=False, max_chars=0).select("page_id", "title", "date", F.length("content").alias("n_chars"))


@query("decode_json_cols", "SELECT card_id, CASE WHEN card_id % 3 = 0 THEN '' WHEN card_id % 3 = 1 THEN rarity || '|' || set_name ELSE '' END AS subtypes, set_name AS types FROM catalogue")
def decode_json_cols(t):
    sub = F.when(F.col("card_id") % 3 == 1, F.to_json(F.array("rarity", "set_name"))).when(F.col("card_id") % 3 == 2, "not json")
    rows = t.catalogue.select("card_id", sub.alias("subtypes"), F.to_json(F.array("set_name")).alias("types"))
    out = feeds.decode_json_cols(rows, "subtypes", "types")
    return out.select("card_id", F.array_join("subtypes", "|").alias("subtypes"), F.array_join("types", "|").alias("types"))


@query("apply_pricepoints", """
  WITH x AS (SELECT card_id, price_variant, current_price, R2(hi) AS p, CASE WHEN card_id % 2 = 0 THEN 'holofoil' WHEN card_id % 2 = 1 THEN coalesce(price_variant, 'normal') END AS v FROM cards JOIN (SELECT card_id, max(high_price) AS hi FROM price_history GROUP BY 1) USING (card_id) WHERE card_id % 7 <> 0)
  SELECT card_id, CASE WHEN p IS NULL THEN current_price ELSE p END AS current_price, CASE WHEN p IS NULL THEN c.price_variant ELSE v END AS price_variant, p IS NOT NULL AS updated FROM (SELECT card_id, current_price, price_variant FROM cards) c LEFT JOIN (SELECT card_id, p, v FROM x) USING (card_id)""")
def apply_pricepoints(t):
    return pricepoints(t)[0].select("card_id", "current_price", "price_variant", "updated")


@query("pricepoint_history", """
  SELECT c.card_id, d::VARCHAR AS date, CASE WHEN c.card_id % 2 = 0 THEN 'holofoil' ELSE coalesce(price_variant, 'normal') END AS variant, 'Near Mint' AS condition, R2(hi) AS market_price
  FROM cards c JOIN (SELECT card_id, max(high_price) AS hi FROM price_history GROUP BY 1) h ON h.card_id = c.card_id, as_of WHERE c.card_id % 7 <> 0 AND c.card_id NOT IN (SELECT card_id FROM price_history WHERE date = d)""")
def pricepoint_history(t):
    """History rows of the price points: none for a card that has any row of the day."""
    return pricepoints(t)[1].select("card_id", "date", "variant", "condition", "market_price")


def pricepoints(t):
    top = t.price_history.groupBy("card_id").agg(F.max("high_price").alias("hi"))
    kind = F.when(F.col("card_id") % 2 == 0, "Foil").otherwise("Etched")
    pts = top.select("card_id", F.array(F.struct(F.lit("Normal").alias("printingType"), F.lit(0.0).alias("marketPrice")), F.struct(kind.alias("printingType"), F.when(F.col("card_id") % 7 != 0, F.col("hi")).alias("marketPrice"))).alias("points"))
    return feeds.apply_pricepoints(t.cards, pts, t.price_history, t.as_of)


@query("write_tables", "SELECT year(date) AS year, count(*) AS n_rows, R2(sum(market_price)) AS total FROM price_history GROUP BY 1")
def write_tables(t):
    """Bars written in two overlapping loads: the second load only adds what is missing."""
    path = f"{checkpoint_root(t.spark)}/bars-{uuid.uuid4().hex}"
    keys = ["card_id", "date", "variant", "condition"]
    bars = t.price_history.withColumn("year", F.year("date"))
    sinks.append_new(bars.filter("card_id % 2 = 0"), path, keys, ["year"])
    sinks.append_new(bars, path, keys, ["year"])
    saved = t.spark.read.parquet(path)
    return saved.groupBy("year").agg(F.count("*").alias("n_rows"), rnd(F.sum("market_price")).alias("total")).withColumn("year", F.col("year").cast("long"))


@query("overlay_tables", """
  SELECT year(date) AS year, count(*) AS n_rows, R2(sum(CASE WHEN card_id % 3 = 0 AND year(date) = year(d) THEN market_price * 2 ELSE market_price END)) AS total FROM price_history, as_of
  WHERE NOT (year(date) = year(d) - 1 AND card_id % 2 = 0) GROUP BY 1""")
def overlay_tables(t):
    """Stored bars, then corrected prices of the newest year laid over, then the year before written anew with half of its cards."""
    base = f"{checkpoint_root(t.spark)}/bars-{uuid.uuid4().hex}"
    keys = ["card_id", "date", "variant", "condition"]
    bars = t.price_history.withColumn("year", F.year("date"))
    sinks.append_new(bars, f"{base}/bars", keys, ["year"])
    fixed = bars.filter((F.col("card_id") % 3 == 0) & (F.col("year") == F.year(t.as_of)))
    # Each correction comes twice; the one with the smaller seq counts.
    twice = fixed.withColumn("market_price", F.col("market_price") * 2).unionByName(fixed.withColumns({"market_price": F.lit(0.0), "seq": F.col("seq") + 1}))
    sinks.overlay_partitions(twice, f"{base}/bars", keys, ["year"], f"{base}/staged", ["seq"])
    sinks.replace_partitions(bars.filter((F.col("year") == F.year(t.as_of) - 1) & (F.col("card_id") % 2 == 1)), f"{base}/bars", ["year"])
    saved = t.spark.read.parquet(f"{base}/bars")
    return saved.groupBy("year").agg(F.count("*").alias("n_rows"), rnd(F.sum("market_price")).alias("total")).withColumn("year", F.col("year").cast("long"))


@query("export_csv", """SELECT name AS "Name", set_name AS "Set", printf('%.2f', current_price) AS "Price", printf('%.1f', R1(least(100, appreciation_score / (1 + exp(-0.1e0 * (liq - 30))) + rarity_score * 0.15e0))) AS "Investment Score",
  printf('%.1f', liquidity_score::DOUBLE) AS "Liquidity", printf('%.1f', appreciation_score) AS "Appreciation", regime AS "Regime", printf('%.2f', est_profit) AS "Est Profit", printf('%.1f', R1(est_profit / current_price * 100)) AS "Return %",
  printf('%.2f', sales_per_day) AS "Velocity" FROM cand""")
def export_csv(t):
    rows = G.candidates(t.cards, G.batch_metrics(t.price_history, t.cards, t.sales, t.as_of))
    page, path = sinks.screener_export(rows), f"{checkpoint_root(t.spark)}/screener-{uuid.uuid4().hex}"
    sinks.export_csv(page, path)
    return t.spark.read.schema(page.schema).option("header", True).csv(path)
