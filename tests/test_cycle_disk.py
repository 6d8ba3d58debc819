"""The refresh cycle holds on disk its tables and the shuffles of one write; its leaner steps equal plain loops."""

import datetime as dt
import random
import time
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from thinmarket.operators import series as S
from thinmarket.plans import streams  # noqa: F401  registers the cycle
from thinmarket.plans.registry import QUERIES
from thinmarket.sources import feeds
from thinmarket.sources.versions import TableStore


def shuffled(spark):
    """Bytes of each shuffle file there is."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    all_files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in all_files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def left_over(spark, before, at_most):
    """Bytes shuffled since, once no more than so many are left; they are dropped in the background."""
    for _ in range(50):
        if (left := sum(n for name, n in shuffled(spark).items() if name not in before)) <= at_most:
            break
        time.sleep(0.1)
    return left


# What counting the rows of folders leaves.
COUNTS = 20_000


def test_a_write_drops_its_shuffles(spark, tmp_path):
    store, before = TableStore(spark, str(tmp_path)), shuffled(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert store.publish("r", "s", replace={"t": spark.range(200_000).groupBy(F.xxhash64("id").alias("k")).count()})
    assert left_over(spark, before, COUNTS) <= COUNTS and spark.conf.get(key, "false") == "false"
    assert store.read("t").agg(F.sum("count")).first()[0] == 200_000


def test_parts_are_one_folder_or_none(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    parts = [spark.range(3), spark.range(0), spark.range(5, 7)]
    assert store.publish("r", "s", append={"t": parts})
    assert sorted(r.id for r in store.added("r", "s", "t").collect()) == [0, 1, 2, 5, 6]
    with pytest.raises(Exception, match="lost"):
        store.publish("r", "more", append={"t": [spark.range(3), spark.range(1).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))]})
    assert store.version == 1 and store.read("t").count() == 5


def test_a_round_leaves_no_kept_tables_and_no_shuffles(spark, tmp_path):
    rng = random.Random(5)
    day = dt.datetime(2001, 1, 1)
    sales = [(i, rng.randrange(6), rng.randrange(8), i % 4, float(rng.randrange(1, 50)), 5000.0 + rng.randrange(40000), "NRA"[i % 3], "OF"[i % 2], day + dt.timedelta(days=rng.randrange(200))) for i in range(600)]
    tables = {
        "nation": ([(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"S{k}", 0, 1.0) for k in range(8)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(k, f"C{k}", 0, 100.0 * k, "m") for k in range(9)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(k, k % 9, "FOP"[k % 3], 100.0, day + dt.timedelta(days=k), f"{k % 5 + 1}-X") for k in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (sales, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept, before = set(spark.sparkContext._jsc.getPersistentRDDs()), shuffled(spark)
    told = QUERIES["refresh_cycle"](spark, str(tmp_path))
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == kept and left_over(spark, before, COUNTS) <= COUNTS
    counts = {r.step: r.n_rows for r in told.collect()}
    have = defaultdict(int)
    seq = lambda r: r[0] * 8 + r[3]
    key = lambda r: (r[2], r[8], r[5], r[7])
    stored = {key(r) for r in sales if seq(r) % 5}
    for r in sales:
        if seq(r) % 2 == 0 and seq(r) % 97 and key(r) not in stored:
            have[key(r)] += 1
    assert counts["sales"] == len(have) > 20 and counts["current_prices"] == 8


RAW = "pos long, product_id long, orderDate string, purchasePrice double, condition string, customListingId string"


def judged(rows, known):
    """Each row's status as one loop over the rows tells it."""
    def keys(r):
        head = "-".join(["tcg", *([str(r[1])] if r[1] is not None else []), (r[2] or "")[:19], *([str(r[3])] if r[3] is not None else [])])
        return f"{head}-{r[4] or ''}-{r[5] or ''}", f"{head}-{r[5] or ''}"

    first = {}
    for r in rows:
        first[keys(r)[0]] = min(first.get(keys(r)[0], r[0]), r[0])
    out = []
    for r in rows:
        new, old = keys(r)
        broken = r[2] is None or not r[2].startswith("20")
        out.append((*r, "duplicate" if new in known or old in known else "error" if broken else "duplicate" if r[0] != first[new] else "new"))
    return out


@pytest.mark.parametrize("n", [1, 4])
def test_sales_in_parts_equal_a_loop(spark, n):
    rng = random.Random(n)
    # Conditions and ids with dashes, so that different heads give equal keys; broken and absent dates, products and prices.
    rows = [
        (rng.randrange(300), rng.choice([1, 2, -3, None]), rng.choice(["2001-02-03T04:05:06Z", "2001-02-03", "bad", "", None, "1-2"]), rng.choice([1.5, 2.0, None]), rng.choice(["A", "A-B", "", None]), rng.choice(["", "B", "x-y", None]))
        for _ in range(700)
    ]
    keyed = feeds.sale_keys(spark.createDataFrame(rows, RAW)).collect()
    known = [k for r in keyed for k in ((r.listing_id,) if rng.random() < 0.05 else (r.old_key,) if rng.random() < 0.05 else ())] + [None, "other", "a-b"]
    existing = spark.createDataFrame([(k,) for k in known], "listing_id string")
    got = []
    for raw, have in feeds.sale_parts(spark.createDataFrame(rows, RAW), existing, n):
        got += [tuple(r) for r in feeds.dedup_sales(raw, have).select(*[c.split()[0] for c in RAW.split(", ")], "status").collect()]
    want = judged(rows, set(known) - {None})
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r[-1] for r in want} == {"new", "duplicate", "error"}


def test_weeks_of_one_two_and_many_sales(spark):
    rng = random.Random(3)
    start = dt.datetime(2001, 1, 1)  # a Monday
    sales = [(k, start + dt.timedelta(days=rng.randrange(70)), "normal", rng.choice(["Near Mint", "Played", None]), float(rng.choice([3, 3, 4, 5, 7, 11, 0]))) for k in range(40) for _ in range(k)]
    sales += [(39, None, "normal", None, p) for p in (1.0, 2.0, 9.0)]
    cards = [(k, None) for k in range(40)]
    bars = [(k, (start + dt.timedelta(days=d)).date() if d < 50 else None, "normal", rng.choice(["Near Mint", "Played", None])) for k in range(40) for d in rng.sample(range(51), 12 if k % 3 else 6)]
    got = S.weekly_bars_from_sales(
        spark.createDataFrame(sales, "card_id long, order_date timestamp, variant string, condition string, purchase_price double"), spark.createDataFrame(cards, "card_id long, price_variant string"),
        spark.createDataFrame(bars, "card_id long, date date, variant string, condition string"), min_days=12,
    ).collect()
    weeks = defaultdict(list)
    for k, at, _, condition, price in sales:
        if price > 0:
            weeks[k, at and (at - dt.timedelta(days=at.weekday())).date(), condition or "Near Mint"].append(price)
    have = {(k, d, c or "Near Mint") for k, d, _, c in bars if d}
    want = {
        (k, d, c): (round(median(p) + 1e-9, 2), min(p), max(p), len(p)) for (k, d, c), p in weeks.items()
        if len(p) >= 2 and (k, d, c) not in have and len({b[1] for b in bars if b[0] == k}) < 12 and sum(s[0] == k for s in sales) >= 2
    }
    assert {(r.card_id, r.date, r.condition): (r.market_price, r.low_price, r.high_price, r.n_sales) for r in got} == want
    assert len(got) == len(want) and {len(p) for p in weeks.values()} >= {1, 2, 3, 4} and (39, None, "Near Mint") in want
