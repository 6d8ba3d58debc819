"""Ranks of crowded groups against plain sorting, and how large the slots are."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from thinmarket.operators import ranking as K


def crowded(rng):
    rows = [("a", k, 5.25) for k in range(3000)] + [("a", 10_000 + k, round(rng.uniform(5, 5.6), 2)) for k in range(2000)]
    rows += [("b", k * 7, round(rng.uniform(0.05, 900), 2)) for k in range(800)] + [("c", 1, 2.0), ("a", 10_000, 5.3), ("a", 10_000, 5.3)]
    return rows


def test_ranks_equal_a_plain_sort(spark):
    rows = crowded(random.Random(8))
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(7)
    want = []
    for g, part in groupby(sorted(rows, key=lambda r: (r[0], -r[2], r[1])), key=lambda r: r[0]):
        part = list(part)
        want += [(g, i, v, n + 1, len(part)) for n, (_, i, v) in enumerate(part)]
    for most in (60, 1000, 100_000):
        got = K.ordered_rank(df, ["g"], "v", "id", most=most).select("g", "id", "v", "rank", "group_size").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_no_slot_holds_a_crowded_value(spark):
    df = spark.createDataFrame(crowded(random.Random(8)), "g string, id long, v double")
    sizes = K.slotted(df, ["g"], "v", "id", most=60).groupBy("g", "_b", "_v", "_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60 and sizes.count() > 80


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1, None), (None, 1, 2.0), ("a", None, 2.0), ("a", 3, -1.0), ("a", 2, 2.0)], "g string, id long, v double")
    assert [(r.id, r.rank, r.group_size) for r in K.ordered_rank(df, ["g"], "v", "id").collect()] == [(2, 1, 1)]
    assert K.ordered_rank(df.limit(0), ["g"], "v", "id").count() == 0
