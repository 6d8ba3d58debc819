"""Product discovery: sets that hold a title, not only those that equal it, and prices on the limit."""

import datetime

from pyspark.sql import functions as F

from thinmarket.plans import ingest
from thinmarket.sources import feeds


class Feed:
    """Card 41 of a set whose name holds the feed's title; 42 of an equal one, 43 of one that holds no title."""

    def __init__(self, spark, price=600.0):
        rows = [(41, "Fox", 1, "N1 Deluxe", "Common", True), (42, "Owl", 2, "N2", "Common", True), (43, "Elk", 1, "Other", "Common", True)]
        self.catalogue = spark.createDataFrame(rows, "card_id long, name string, set_id long, set_name string, rarity string, is_tracked boolean")
        bars = [(r[0], "normal", datetime.date(2020, 1, 1), price, price, price, price) for r in rows]
        self.price_history = spark.createDataFrame(bars, "card_id long, variant string, date date, market_price double, low_price double, mid_price double, high_price double")
        self.nation = spark.createDataFrame([(1, "N1"), (2, "N2")], "n_nationkey int, n_name string")

    def read(self, name):
        return self.nation


def test_the_query_matches_sets_that_hold_the_title(spark):
    got = {r.product_id - 5000: r.action for r in ingest.discover_products(Feed(spark)).collect()}
    assert got == {41: "map_existing", 42: "map_existing", 43: "create"}


def test_a_title_matches_every_set_that_holds_it_and_an_empty_one_all(spark):
    cards = spark.createDataFrame(
        [(i, f"id-{i}", s, str(n), None, True) for i, s, n in [(1, "NATION_1", 7), (2, "NATION_10", 8), (3, "Nation_11 b", 9), (4, "NATION_2", 8), (5, None, 10), (6, "", 11)]],
        "card_id long, tcg_id string, set_name string, number string, product_id long, is_tracked boolean",
    )
    groups = spark.createDataFrame([(1, "SV03: NATION_1"), (2, "SV04: "), (3, None)], "groupId long, name string")
    asked = [(1, n) for n in (7, 8, 9, 10, 11)] + [(2, n) for n in (7, 8, 9, 10, 11, 12)] + [(3, 7)]
    products = spark.createDataFrame(
        [(g * 100 + n, g, "x", [("Number", f"0{n}/99")]) for g, n in asked], "productId long, groupId long, name string, extendedData array<struct<name: string, value: string>>"
    )
    entries = products.select("productId", F.lit("Normal").alias("subTypeName"), *[F.lit(20.0).alias(f"{p}Price") for p in ("market", "low", "mid", "high")], F.lit(1).alias("pos"))
    got = {r.productId: r.match_id for r in feeds.discover_products(groups, products, entries, cards).collect()}
    assert got == {107: 1, 108: 2, 109: 3, 110: None, 111: None, 207: 1, 208: 2, 209: 3, 210: None, 211: 6, 212: None, 307: None}


def test_prices_are_compared_in_cents(spark):
    assert {r.price for r in ingest.discover_products(Feed(spark, 524.996)).collect()} == {525.0}
    assert ingest.discover_products(Feed(spark, 524.994)).count() == 0
