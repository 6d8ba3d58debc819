"""Heavy steps are run once: what is read several times is kept, and no filter repeats the folds or the parsing."""

import datetime as dt

from pyspark.sql import functions as F

from thinmarket import session
from thinmarket.operators import desk as D
from thinmarket.operators import market as M
from thinmarket.operators import sales as A
from thinmarket.sources import feeds


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_hot_cards_do_not_repeat_the_folds(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    bars = spark.createDataFrame(
        [(c, d, "normal", "Near Mint", 10.0 + c * i, 9.0, 11.0, i) for c in (1, 2, 3) for i, d in enumerate(days)],
        "card_id long, date date, variant string, condition string, market_price double, low_price double, high_price double, seq long",
    )
    cards = spark.createDataFrame([(c, f"C{c}", "S", "R", "normal", True, 10.0 + c) for c in (1, 2, 3)],
                                  "card_id long, name string, set_name string, rarity string, price_variant string, is_tracked boolean, current_price double")
    hot = M.hot_cards(bars, cards)
    some = hot.filter("signal <> 'hold'").select("card_id", "signal")
    assert plan(some).count("aggregate(") <= plan(hot).count("aggregate(")
    assert {tuple(r) for r in some.collect()} == {(r.card_id, r.signal) for r in hot.collect() if r.signal != "hold"} != set()


def test_a_row_per_card_is_kept_although_joins_look_large(spark, monkeypatch):
    cards = spark.range(1000).withColumnRenamed("id", "card_id")
    joined = cards.join(spark.range(1000).selectExpr("id AS card_id", "id AS x"), "card_id", "left")
    monkeypatch.setattr(session, "REUSE_LIMIT_BYTES", 1 << 20)
    assert not session.reuse(joined).storageLevel.useMemory
    kept = session.reuse(joined, one_row_per=cards)
    assert kept.storageLevel.useMemory
    kept.unpersist()
    monkeypatch.setattr(session, "REUSE_LIMIT_BYTES", 1 << 10)
    assert not session.reuse(joined, one_row_per=cards).storageLevel.useMemory


DATES = {
    "2024-02-03": "2024-02-03", "20240203": "2024-02-03", "2/3/2024": "2024-02-03", "02/03/24": "2024-02-03", "2024-02-03T10:11:12": "2024-02-03", "2024-02-03t10:11:12z": "2024-02-03",
    "3-feb-2024": "2024-02-03", "February 3, 2024": "2024-02-03", "february 13, 2024": "2024-02-13", " 2024-02-03 ": "2024-02-03", "2024-02-03T23:30:00.5-07:00": "2024-02-03",
    "2024-02-30": None, "13/13/2024": None, "1/2/3/4": None, "soon": None, "": None, None: None,
}


def test_dates_by_shape_are_those_of_all_formats(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "t string")
    t = F.trim("t")
    every = F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in feeds.DATE_FORMATS], F.try_to_date(F.concat_ws("-", *[F.regexp_extract(t, feeds.ISO_DATE, i) for i in (1, 3, 4)]), "yyyy-MM-dd"))
    rows = df.select("t", feeds.parse_date(F.col("t")).cast("string").alias("got"), every.cast("string").alias("all")).collect()
    assert {r.t: r.got for r in rows} == {r.t: r.all for r in rows} == DATES


def test_a_csv_is_parsed_once(spark):
    rows = spark.createDataFrame(
        [(1, "Mew", "A", "2024-01-02", "$5"), (2, "MEW", "A", "1/2/2024", "$6"), (3, "Mew", "A", "January 3, 2024", "$7"), (4, "Mew", "A", "2024-01-04", ""), (5, "Mew", "A", "never", "$1"),
         (6, "Who", "A", "2024-01-02", "$5"), (7, "Who", "A", "2024-01-02", "$5"), (8, "Mew", "Z", "2024-01-05", "$8"), (9, "Mew", "A", "2024-01-05", "$9"), (10, "Mew", "A", "2024-01-04", "$2")],
        "line long, name string, set string, date string, price string",
    )
    cards = spark.createDataFrame([(7, "Mew", "A", None)], "card_id long, name string, set_name string, price_variant string")
    have = spark.createDataFrame([(7, dt.date(2024, 1, 3), "normal")] * 2 + [(7, dt.date(2024, 1, 9), "normal"), (None, dt.date(2024, 1, 2), "normal")], "card_id long, date date, variant string")
    out = feeds.ingest_price_csv(rows, cards, have)
    assert {r.line: r.status for r in out.collect()} == {
        1: "new", 2: "duplicate", 3: "duplicate", 4: "skipped", 5: "skipped", 6: "unmatched", 7: "unmatched", 8: "new", 9: "duplicate", 10: "new",
    }
    assert out.count() == 10
    assert plan(out).count("MMMM d, yyyy") == 1


def test_price_files_are_parsed_once(spark):
    doc = '{"normal-nearmint":{"history":{"2024-01-01":{"avg":200},"2024-01-02":{"avg":300}}},"holofoil-good":{"history":{"2024-01-01":{"avg":900}}},"normal-odd":{"history":{"2024-01-01":{"avg":1}}}}'
    files = spark.createDataFrame([(f"/x/en/s/{n}.tcgplayer.json", d) for n, d in (("1", doc), ("2", doc), ("3", doc.replace("300", "30")))], "path string, content string")
    tracked = spark.createDataFrame([("s-1",), ("s-1",), ("s-3",)], "tcg_id string")
    out = feeds.ingest_price_json(files, 250, tracked)
    assert {(r.tcg_id, str(r.date), r.variant, r.market_price) for r in out.collect()} == {("s-1", "2024-01-01", "normal", 2.0), ("s-1", "2024-01-02", "normal", 3.0)}
    assert plan(out).lower().count("generate posexplode") == 1


def test_the_scan_of_a_summary_runs_once(spark):
    scan = spark.range(5).select(F.expr("CASE WHEN id > 3 THEN 'a' ELSE 'b' END AS strategy"))
    metrics = spark.createDataFrame([("markup",), (None,), ("markup",)], "regime string")
    out = D.signal_summary(scan, metrics)
    assert {tuple(r) for r in out.collect()} == {("strategy", "a", 1), ("strategy", "b", 4), ("total", "signals", 5), ("regime", "markup", 2)}
    assert plan(out).count("Range (") == 1
    assert [tuple(r) for r in D.signal_summary(scan.filter("strategy = 'c'"), metrics.limit(0)).collect()] == [("total", "signals", 0)]


def test_sales_are_counted_before_they_meet_their_median(spark):
    prices = {(1, "Near Mint"): [100.0, 100.0, 120.0], (1, "Damaged"): [5.0, 50.0, 60.0, 60.0], (2, None): [3.0, 4.0], (3, "Damaged"): [1.0], (3, "Near Mint"): [9.0]}
    sales = spark.createDataFrame([(c, k, p) for (c, k), ps in prices.items() for p in ps], "card_id long, condition string, purchase_price double")
    out = A.condition_pricing(sales)
    assert {(r.card_id, r.condition, r.median_price, r.n_sales, r.is_outlier) for r in out.collect()} == {
        (1, "Near Mint", 100.0, 3, False), (1, "Damaged", 60.0, 3, False), (2, "Unknown", 3.5, 2, False), (3, "Damaged", 1.0, 1, False), (3, "Near Mint", 9.0, 1, False),
    }
    lines = [x.lstrip(" :+-") for x in plan(out).splitlines()]
    below = [next(y for y in lines[i + 1:] if not y.startswith(("Project", "Filter"))) for i, x in enumerate(lines) if x.startswith("Join LeftOuter, (card_id")]
    assert below and all(x.startswith("Aggregate") for x in below)
