"""Medians by bands: order of the bands, equality with sorted lists, and a card that holds most sales."""

import math
import random
import statistics

from pyspark.sql import functions as F

from thinmarket.operators import sales as A


def test_bands_never_fall(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2)]
    values += [rng.choice([-1, 1]) * math.exp(rng.uniform(-700, 700)) for _ in range(2000)]
    for v in [rng.uniform(0.01, 1e5) for _ in range(500)]:
        values += [v, math.nextafter(v, math.inf), round(v, 2)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", A.value_band(F.col("v")).alias("b")).collect()
    rows = sorted((r.v, r.b) for r in rows)
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert A.BANDS_PER_E < len({b for _, b in rows})
    assert spark.createDataFrame([(float("nan"),)], "v double").select(A.value_band(F.col("v"))).first()[0] > rows[-1][1]


def test_equals_sorted_lists(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", None]), rng.choice([0.0, -3.5, 10.0, 10.001, 250.0, rng.uniform(9, 11), rng.uniform(-50, 500)]), rng.random() < 0.3) for _ in range(900)]
    rows += [(9, "a", 7.0, True), (9, "b", None, True), (10, "a", 1.0, False)]
    df = spark.createDataFrame(rows, "card_id long, condition string, price double, recent boolean")
    out = A.grouped_medians(df, ["card_id", "condition"], "price", {"all": F.lit(True), "recent": F.col("recent")}).collect()
    groups = {}
    for c, k, p, r in rows:
        if p is not None:
            groups.setdefault((c, k), []).append((p, r))
    assert {(r.card_id, r.condition) for r in out} == set(groups)
    for r in out:
        for name, own in (("all", [p for p, _ in groups[r.card_id, r.condition]]), ("recent", [p for p, x in groups[r.card_id, r.condition] if x])):
            assert r[f"{name}_count"] == len(own)
            if own:
                assert (r[f"{name}_median"], r[f"{name}_upper"]) == (statistics.median(own), statistics.median_high(own))
                assert (r[f"{name}_min"], r[f"{name}_max"]) == (min(own), max(own)) and abs(r[f"{name}_mean"] - statistics.fmean(own)) < 1e-9
            else:
                assert r[f"{name}_median"] is r[f"{name}_mean"] is r[f"{name}_min"] is None


def test_no_task_sorts_a_card_with_most_sales(spark):
    """One card with a third of all sales, each at a price of its own: what is sorted is one band of it."""
    n = 300_000
    price = F.exp(F.rand(5) * 5 + 1)
    sales = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("card_id"), price.alias("purchase_price")).cache()
    spread = sales.filter("card_id = 0").groupBy(A.value_band(F.col("purchase_price")).alias("b")).count()
    assert spread.agg(F.max("count")).first()[0] < n / 3 / 500
    got = {r.card_id: r for r in A.grouped_medians(sales, ["card_id"], "purchase_price", {"s": F.lit(True)}).collect()}
    own = sorted(r.purchase_price for r in sales.filter("card_id = 0").collect())
    assert len(got) == 501 and got[0].s_count == len(own) == n // 3 and (got[0].s_median, got[0].s_upper) == (statistics.median(own), statistics.median_high(own))
    sales.unpersist()
