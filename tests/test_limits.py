"""Values that lie exactly on a limit."""

from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.plans import ingest
from thinmarket.sources import feeds


def test_a_pace_on_the_limit_changes_no_days(spark):
    # 13 of 26 is 1.5 times the pace of 90 days, 7 of 42 half of it.
    rows = [(1, 250.0, 26, 13), (2, 250.0, 26, 14), (3, 250.0, 42, 7), (4, 250.0, 42, 6), (5, 250.0, 22, 11), (6, 250.0, 46, 23)]
    df = spark.createDataFrame(rows, "k int, p double, s90 long, s30 long")
    got = {r.k: r.d for r in df.select("k", E.time_to_sell(F.col("p"), F.col("s90"), F.col("s30"))["estimated_days"].alias("d")).collect()}
    assert got == {1: 9, 2: 5, 3: 8, 4: 12, 5: 9, 6: 8}


def test_products_keep_numbers_of_more_than_six_digits(spark):
    class Feed:
        catalogue = spark.createDataFrame(
            [(k, f"Card {k}", 1, "N1", "Common", True) for k in (41, 999999, 1000001, 12345679)],
            "card_id long, name string, set_id long, set_name string, rarity string, is_tracked boolean",
        )

        def read(self, name):
            return spark.createDataFrame([(1, "N1")], "n_nationkey int, n_name string")

    groups, products, cards = ingest.product_feed(Feed())
    entries = products.select("productId", F.lit("Normal").alias("subTypeName"), *[F.lit(20.0).alias(f"{p}Price") for p in ("market", "low", "mid", "high")], F.lit(1).alias("pos"))
    got = {r.productId - 5000: (r.number, r.action, r.match_id) for r in feeds.discover_products(groups, products, entries, cards).collect()}
    assert got == {k: (str(k), "map_existing", k) for k in (41, 999999, 1000001, 12345679) if k % 9}
