"""The provided tables seen as the domain's tables, once for Spark and once for the oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinmarket.functions.numeric import rnd
from thinmarket.operators import series as S
from thinmarket.plans.registry import view
from thinmarket.session import reuse

# Fixed values of the binding.
RARITY_BY_REMAINDER = ("Illustration Rare", "Ultra Rare", "Rare Holo", "Common")
SUFFIX_BY_REMAINDER = (" ex", " V", " GX", "")


class Tables:
    """Lazily bound domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def sales(self) -> DataFrame:
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("card_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_shipdate").cast("timestamp").alias("order_date"),
            (F.col("l_extendedprice") / 100.0).alias("purchase_price"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(flag == "N", "holofoil").when(flag == "R", "reverseHolofoil").otherwise("normal").alias("variant"),
            F.when(status == "O", "Near Mint").otherwise("Lightly Played").alias("condition"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        )

    @cached_property
    def price_history(self) -> DataFrame:
        return reuse(S.bars_from_sales(self.sales))

    @cached_property
    def series(self) -> DataFrame:
        return S.dedup_by_date(self.price_history)

    @cached_property
    def as_of(self) -> Column:
        """Newest sale date as a scalar subquery: evaluated once, reused, never collected."""
        return self.sales.agg(F.max(F.to_date("order_date"))).scalar()

    @cached_property
    def first_day(self) -> Column:
        """Oldest sale date as a scalar subquery."""
        return self.sales.agg(F.min(F.to_date("order_date"))).scalar()

    @cached_property
    def n_cards(self) -> Column:
        """Number of cards as a scalar subquery; keys of other tables are folded onto all cards by it."""
        return self.read("supplier").agg(F.count("*")).scalar()

    @cached_property
    def catalogue(self) -> DataFrame:
        key = F.col("s_suppkey")
        rarity = F.element_at(F.array(*map(F.lit, RARITY_BY_REMAINDER)), (key % 4 + 1).cast("int"))
        return (
            self.read("supplier")
            .join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("card_id"),
                F.col("s_name").alias("name"),
                F.col("s_nationkey").cast("long").alias("set_id"),
                F.col("n_name").alias("set_name"),
                rarity.alias("rarity"),
                F.when(key % 3 == 0, "holofoil").when(key % 3 == 1, "normal").alias("price_variant"),
                (key % 5 != 0).alias("is_tracked"),
                F.col("s_acctbal").alias("acctbal"),
            )
        )

    @cached_property
    def cards(self) -> DataFrame:
        """Catalogue plus the newest Near Mint price of the card's variant."""
        return reuse(self.catalogue.join(S.latest_price(self.price_history, self.catalogue), "card_id", "left"), one_row_per=self.read("supplier"))

    @cached_property
    def card_sets(self) -> DataFrame:
        return self.read("nation").select(
            F.col("n_nationkey").cast("long").alias("set_id"),
            F.col("n_name").alias("set_name"),
            F.expr("date_add(DATE'1992-01-01', CAST(120 * n_nationkey AS INT))").alias("release_date"),
        )

    @cached_property
    def items(self) -> DataFrame:
        suffix = F.element_at(F.array(*map(F.lit, SUFFIX_BY_REMAINDER)), (F.col("p_size") % 4 + 1).cast("int"))
        return self.read("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.col("p_name"), suffix).alias("name"),
            F.col("p_brand").alias("set_name"),
            F.col("p_type").alias("rarity"),
            F.col("p_retailprice").alias("list_price"),
        )

    @cached_property
    def item_prices(self) -> DataFrame:
        """Daily mean price per item."""
        return reuse(self.sales.groupBy("item_id", F.to_date("order_date").alias("date")).agg(F.avg("purchase_price").alias("price")))

    @cached_property
    def item_last_prices(self) -> DataFrame:
        """Of the daily mean prices each item's last and its last up to a week before the newest sale."""
        return reuse(S.last_day_prices(self.sales, self.as_of, "item_id"))

    @cached_property
    def trades(self) -> DataFrame:
        """Orders as fills: a customer is a portfolio, sells are cut to what is held.

        Holdings are the running signed quantity reflected at zero, so no sell is uncovered.
        """
        status = F.col("o_orderstatus")
        raw = self.read("orders").select(
            F.col("o_orderkey").alias("trade_id"),
            F.col("o_custkey").alias("portfolio_id"),
            ((F.col("o_custkey") + F.col("o_orderkey") % 2) % self.n_cards).alias("card_id"),
            F.when(status == "F", "sell").otherwise("buy").alias("side"),
            (F.col("o_orderkey") % 5 + 1).cast("int").alias("quantity"),
            (F.col("o_totalprice") / 1000.0).alias("price"),
            F.col("o_orderpriority").alias("signal"),
            F.element_at(F.array(*map(F.lit, STRATEGY_BY_REMAINDER)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("strategy"),
            F.col("o_orderdate").cast("timestamp").alias("executed_at"),
        )
        w = Window.partitionBy("portfolio_id", "card_id").orderBy("executed_at", "trade_id")
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
        held = (
            raw.withColumn("s", F.sum(signed).over(run))
            .withColumn("held", F.col("s") - F.least(F.lit(0), F.min("s").over(run)))
            .withColumn("before", F.coalesce(F.lag("held").over(w), F.lit(0)))
        )
        done = held.withColumn("quantity", F.abs(F.col("held") - F.col("before")).cast("int")).filter("quantity > 0")
        pnl = F.when(F.col("side") == "sell", rnd(F.col("quantity") * (F.col("price") - 250)))
        return done.select(*raw.columns, pnl.alias("realized_pnl"))

    @cached_property
    def insights(self) -> DataFrame:
        """Events as insights of the card that the user id names."""
        value = F.col("value")
        return self.read("events").select(
            F.col("event_id").alias("insight_id"), F.col("event_type").alias("type"),
            F.when(value > 100, "urgent").when(value > 50, "notable").otherwise("info").alias("severity"),
            F.col("user_id").alias("card_id"), F.col("ts").cast("timestamp").alias("created_at"),
            (F.col("event_id") % 2 == 0).alias("acknowledged"), F.col("props").alias("metadata_json"), value.alias("value"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        bal, key = F.col("c_acctbal"), F.col("c_custkey")
        return self.read("customer").select(
            key.alias("alert_id"),
            (key % self.n_cards).alias("card_id"),
            F.col("c_name").alias("email"),
            F.when(key % 3 == 0, bal / 10.0).alias("threshold_above"),
            F.when(key % 3 == 1, bal / 20.0).alias("threshold_below"),
            F.when(key % 3 == 2, bal / 100.0).alias("spread_threshold"),
            (key % 7 != 0).alias("is_active"),
            F.when(key % 11 == 0, F.lit("2001-11-04 00:00:00").cast("timestamp"))
            .when(key % 13 == 0, F.lit("2001-10-01 00:00:00").cast("timestamp"))
            .alias("last_triggered_at"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Every order as a prediction, entered at the price of its day."""
        prio = F.substring("o_orderpriority", 1, 1)
        signal = F.when(prio == "1", "buy").when(prio == "2", "accumulate").when(prio == "3", "hold").when(prio == "4", "watch").otherwise("avoid")
        made = self.read("orders").select(
            F.col("o_orderkey").alias("prediction_id"),
            (F.col("o_custkey") % self.n_cards).alias("card_id"),
            signal.alias("signal"),
            F.when(F.col("o_custkey") % 3 == 0, "analyst").when(F.col("o_custkey") % 3 == 1, "trader").otherwise("scanner").alias("source"),
            F.col("o_orderdate").cast("date").alias("predicted_at"),
        )
        rising = F.col("signal").isin("buy", "accumulate")
        daily = S.daily_prices(self.series, ["card_id"], carried=True)
        entered = made.join(daily, "card_id", "left").select(*made.columns, S.price_carried(F.col("predicted_at")).alias("entry_price"))
        return entered.select(
            "*", F.when(rising, F.col("entry_price") * 1.25).alias("target_price"),
            F.when(rising, F.col("entry_price") * 0.88).alias("stop_loss"),
        )


STRATEGY_BY_REMAINDER = ("velocity_spike", "accumulation_phase", "mean_reversion_v2", "vintage_value_buy")


view("sales", """
  SELECT l_suppkey AS card_id, l_partkey AS item_id, l_shipdate AS order_date,
         l_extendedprice / 100.0 AS purchase_price, CAST(l_quantity AS INT) AS quantity,
         CASE l_returnflag WHEN 'N' THEN 'holofoil' WHEN 'R' THEN 'reverseHolofoil' ELSE 'normal' END AS variant,
         CASE l_linestatus WHEN 'O' THEN 'Near Mint' ELSE 'Lightly Played' END AS condition,
         l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem""")
view("price_history", """
  SELECT card_id, CAST(order_date AS DATE) AS date, variant, condition,
         avg(purchase_price) AS market_price, min(purchase_price) AS low_price,
         (min(purchase_price) + max(purchase_price)) / 2 AS mid_price, max(purchase_price) AS high_price,
         min(seq) AS seq
  FROM sales GROUP BY 1, 2, 3, 4""")
view("as_of", "SELECT max(CAST(order_date AS DATE)) AS d FROM sales")
view("series", """
  SELECT card_id, date, market_price AS price, low_price AS low, high_price AS high, mid_price AS mid
  FROM price_history
  QUALIFY row_number() OVER (PARTITION BY card_id, date ORDER BY seq DESC, variant DESC, condition DESC) = 1""")
view("ser", """
  SELECT card_id, date, price, low, high, mid,
         row_number() OVER (PARTITION BY card_id ORDER BY date) AS i,
         count(*) OVER (PARTITION BY card_id) AS n
  FROM series""")
view("catalogue", """
  SELECT s_suppkey AS card_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS set_id, n_name AS set_name,
         CASE s_suppkey % 4 WHEN 0 THEN 'Illustration Rare' WHEN 1 THEN 'Ultra Rare' WHEN 2 THEN 'Rare Holo' ELSE 'Common' END AS rarity,
         CASE s_suppkey % 3 WHEN 0 THEN 'holofoil' WHEN 1 THEN 'normal' END AS price_variant,
         s_suppkey % 5 <> 0 AS is_tracked, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
view("cards", """
  SELECT c.*, l.current_price FROM catalogue c LEFT JOIN (
    SELECT p.card_id, arg_max(round(p.market_price + 1e-9, 2), (p.date, p.seq, p.variant)) AS current_price
    FROM price_history p JOIN catalogue k ON p.card_id = k.card_id
    WHERE (k.price_variant IS NULL OR p.variant = k.price_variant) AND p.condition = 'Near Mint'
    GROUP BY 1) l USING (card_id)""")
view("card_sets", """
  SELECT CAST(n_nationkey AS BIGINT) AS set_id, n_name AS set_name,
         CAST(DATE '1992-01-01' + CAST(120 * n_nationkey AS INT) AS DATE) AS release_date FROM nation""")
view("items", """
  SELECT p_partkey AS item_id, p_name || CASE p_size % 4 WHEN 0 THEN ' ex' WHEN 1 THEN ' V' WHEN 2 THEN ' GX' ELSE '' END AS name,
         p_brand AS set_name, p_type AS rarity, p_retailprice AS list_price FROM part""")
view("item_prices", "SELECT item_id, CAST(order_date AS DATE) AS date, avg(purchase_price) AS price FROM sales GROUP BY 1, 2")
view("trades", """
  SELECT trade_id, portfolio_id, card_id, side, CAST(abs(held - before) AS INT) AS quantity, price, signal, strategy, executed_at,
         CASE WHEN side = 'sell' THEN R2(abs(held - before) * (price - 250)) END AS realized_pnl FROM (
    SELECT *, coalesce(lag(held) OVER (PARTITION BY portfolio_id, card_id ORDER BY executed_at, trade_id), 0) AS before FROM (
      SELECT *, s - least(0, min(s) OVER (PARTITION BY portfolio_id, card_id ORDER BY executed_at, trade_id)) AS held FROM (
        SELECT o_orderkey AS trade_id, o_custkey AS portfolio_id, card_id,
          CASE o_orderstatus WHEN 'F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice / 1000.0 AS price, o_orderpriority AS signal,
          CASE o_orderkey % 4 WHEN 0 THEN 'velocity_spike' WHEN 1 THEN 'accumulation_phase' WHEN 2 THEN 'mean_reversion_v2' ELSE 'vintage_value_buy' END AS strategy,
          o_orderdate AS executed_at,
          sum(CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END * (o_orderkey % 5 + 1)) OVER (PARTITION BY o_custkey, card_id ORDER BY o_orderdate, o_orderkey) AS s
        FROM (SELECT *, (o_custkey + o_orderkey % 2) % (SELECT count(*) FROM supplier) AS card_id FROM orders)))) WHERE held <> before""")
view("insights", """
  SELECT event_id AS insight_id, event_type AS type, CASE WHEN value > 100 THEN 'urgent' WHEN value > 50 THEN 'notable' ELSE 'info' END AS severity,
         user_id AS card_id, ts AS created_at, event_id % 2 = 0 AS acknowledged, props AS metadata_json, value FROM events""")
view("alerts", """
  SELECT c_custkey AS alert_id, c_custkey % (SELECT count(*) FROM supplier) AS card_id, c_name AS email,
         CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 10.0 END AS threshold_above,
         CASE WHEN c_custkey % 3 = 1 THEN c_acctbal / 20.0 END AS threshold_below,
         CASE WHEN c_custkey % 3 = 2 THEN c_acctbal / 100.0 END AS spread_threshold,
         c_custkey % 7 <> 0 AS is_active,
         CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2001-11-04 00:00:00'
              WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2001-10-01 00:00:00' END AS last_triggered_at
  FROM customer""")
view("predictions", """
  SELECT *, CASE WHEN signal IN ('buy', 'accumulate') THEN entry_price * 1.25e0 END AS target_price,
    CASE WHEN signal IN ('buy', 'accumulate') THEN entry_price * 0.88e0 END AS stop_loss FROM (SELECT q.*, (SELECT arg_max(s.price, s.date) FROM series s WHERE s.card_id = q.card_id AND s.date <= q.predicted_at) AS entry_price
  FROM (SELECT o_orderkey AS prediction_id, o_custkey % (SELECT count(*) FROM supplier) AS card_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'buy' WHEN '2' THEN 'accumulate' WHEN '3' THEN 'hold' WHEN '4' THEN 'watch' ELSE 'avoid' END AS signal,
               CASE o_custkey % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'trader' ELSE 'scanner' END AS source,
               CAST(o_orderdate AS DATE) AS predicted_at
        FROM orders) q)""")
