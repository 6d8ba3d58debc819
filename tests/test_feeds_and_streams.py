import datetime as dt
import random

from pyspark.sql import functions as F

from thinmarket.sources import feeds, sinks
from thinmarket.streaming import streams as Z

PAGE = """<html><head><script type="application/ld+json">{"@type":"Article","datePublished":"2025-03-11T08:00"}</script></head>
<body><p>outside</p><article><h1>Big &amp; bold</h1><p>First <b>paragraph</b> of text here.</p><p>12/13 to 12/15$250.78</p><p>only $4</p>
<h2>A heading that stays</h2><p>Buy Product</p><p>Last words &lt;here&gt; stay too, all of them.</p></article></body></html>"""


def test_articles(spark):
    pages = spark.createDataFrame([(1, "https://x/pok-price-spike-03-12-2025", PAGE), (2, "https://x/japanese-pok-price-spike", PAGE), (3, "https://x/other", PAGE)], "page_id long, url string, html string")
    (row,) = feeds.extract_articles(pages, limit=4).collect()
    assert row["page_id"] == 1 and row["title"] == "Big & bold" and row["date"] == dt.date(2025, 3, 11)
    assert row["content"] == "First paragraph of text here.\nA heading that stays\nLast words <here> stay too, all of them."


def test_price_files_from_disk(spark, tmp_path):
    folder = tmp_path / "en" / "base1"
    folder.mkdir(parents=True)
    (folder / "4.tcgplayer.json").write_text('{"data":{"normal-nearmint":{"history":{"2024-01-01":{"avg":150,"min":100,"max":null,"count":2},"bad":{"avg":1}}},"holofoil-nearmint":{"history":{"2024-01-01":{"avg":300}}},"holofoil-damaged":{"history":{"2024-01-02":{"avg":9},"2024-01-03":{"avg":9}}}}}')
    (folder / "5.tcgplayer.json").write_text("not json")
    got = feeds.ingest_price_json(feeds.read_text_files(spark, str(tmp_path)), 100).collect()
    assert [(r["tcg_id"], r["variant"], r["market_price"], r["low_price"]) for r in got] == [("base1-4", "holofoil", 3.0, None)]


def test_csv_dates_and_prices(spark):
    texts = ["2024-03-05", "03/05/2024", "3/5/24", "2024-03-05T10:00:00", "2024-03-05T10:00:00Z", "5-Mar-2024", "March 5, 2024"]
    df = spark.createDataFrame([(t,) for t in texts + ["soon"]], "t string")
    days = [r[0] for r in df.select(feeds.parse_date(F.col("t"))).collect()]
    assert days == [dt.date(2024, 3, 5)] * 7 + [None]
    prices = spark.createDataFrame([("$1,005.50",), ("N/A",), ("-",), ("0",), (None,)], "t string").select(feeds.parse_price(F.col("t"))).collect()
    assert [r[0] for r in prices] == [1005.5, None, None, None, None]


def test_append_new_keeps_first(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df.union(spark.createDataFrame([(3, "c")], "k long, v string")), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_overlay_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    shape = "k int, year int, v string, seq int"
    sinks.append_new(spark.createDataFrame([(1, 2000, "b", 2), (1, 2000, "a", 1), (2, 2001, "c", 1), (3, 2001, "d", 1), (None, 2001, "n", 1)], shape), path, ["k", "year"], ["year"], ["seq"])
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "year=2000").iterdir()}
    sinks.overlay_partitions(spark.createDataFrame([(2, 2001, "late", 9), (2, 2001, "new", 5), (None, 2001, "m", 1), (7, 2002, "e", 1)], shape), path, ["k", "year"], ["year"], f"{tmp_path}/s", ["seq"])
    got = sorted(((r.k or 0, r.year, r.v) for r in spark.read.parquet(path).collect()))
    assert got == [(0, 2001, "m"), (1, 2000, "a"), (2, 2001, "new"), (3, 2001, "d"), (7, 2002, "e")]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "year=2000").iterdir()} == untouched


def test_gate_widens_after_a_week():
    at = dt.datetime(2024, 1, 1)
    rows = [(10.0, at), (40.0, at + dt.timedelta(days=1)), (25.0, at + dt.timedelta(days=2)), (90.0, at + dt.timedelta(days=12))]
    assert Z.gate_steps(rows, None)[0] == [True, False, True, True]


def test_gate_state_survives_micro_batches(spark, tmp_path):
    schema = "card_id long, event_id long, ts timestamp, price double"
    for k, (price, d) in enumerate([(10.0, 1), (40.0, 2), (20.0, 3)]):
        df = spark.createDataFrame([(1, k, dt.datetime(2024, 1, d), price)], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.read_folder(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    got = {r["event_id"]: r["accepted"] for r in Z.run_available(Z.price_gate_stream(stream)).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_gate_judges_in_order_of_time_whatever_the_files(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(c, 100 * c + k, start + dt.timedelta(hours=5 * k + c), round(rng.choice([10, 20, 45, 100]) * rng.uniform(0.5, 1.5), 2)) for c in (1, 2) for k in range(40)]
    schema = "card_id long, event_id long, ts timestamp, price double"
    rows.append((9, 999, start + dt.timedelta(days=30), 1.0))  # moves the watermark past all others
    want = {}
    for c in (1, 2):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))
        want |= dict(zip([r[1] for r in own], Z.gate_steps([(r[3], r[2]) for r in own], None)[0]))
    by_time = sorted(rows, key=lambda r: (r[2], r[1]))
    late = [r for i in range(0, len(by_time), 6) for r in by_time[i : i + 6][::-1]]  # up to 15 hours late
    for n, (order, size) in enumerate([(by_time, 100), (by_time, 30), (late, 4)]):
        folder = str(tmp_path / f"in{n}")
        for i in range(0, len(order), size):
            spark.createDataFrame(order[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = Z.read_folder(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        got = {r["event_id"]: r["accepted"] for r in Z.run_available(Z.price_gate_stream(stream, delay="2 days")).collect()}
        assert got == want and not all(got.values())


def insight_files(spark, folder, layout):
    days = [(1, 1, 0), (2, 1, 20), (3, 2, 0), (4, 2, 1), (5, 5, 0)]  # id, day, hour; 24 h after the first is still its day
    for ids in layout:
        rows = [(i, 7, "spike", dt.datetime(2024, 1, d, h)) for i, d, h in days if i in ids]
        spark.createDataFrame(rows, "insight_id long, card_id long, type string, created_at timestamp").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def test_insights_open_alike_from_one_file_or_many(spark, tmp_path):
    for n, layout in enumerate([[{1, 2, 3, 4, 5}], [{1}, {2}, {3}, {4}, {5}], [{1, 2}, {3, 4, 5}]]):
        folder = str(tmp_path / f"in{n}")
        schema = insight_files(spark, folder, layout)
        out = Z.run_available(Z.insight_dedup_stream(Z.read_folder(spark, folder, schema, files_per_trigger=1)))
        assert sorted((r["insight_id"], r["open_id"], r["action"]) for r in out.collect()) == [(1, 1, "insert"), (2, 1, "update"), (3, 1, "update"), (4, 4, "insert"), (5, 5, "insert")]


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "job")
    schema = insight_files(spark, folder, [{1}])
    run = lambda: Z.run_available(Z.insight_dedup_stream(Z.read_folder(spark, folder, schema)), path=path).collect()
    assert [r["action"] for r in run()] == ["insert"]
    insight_files(spark, folder, [{2}])
    assert sorted((r["insight_id"], r["open_id"], r["action"]) for r in run()) == [(1, 1, "insert"), (2, 1, "update")]
    assert len(run()) == 2


def test_stream_without_files_is_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = "event_id long, card_id long, ts timestamp, price double"
    stream = Z.read_folder(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema)
    assert Z.run_available(Z.price_gate_stream(stream)).collect() == []


def test_alerts_fire_once_by_the_first_rule(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    prices = spark.createDataFrame([(1, 1, at(1), 50.0), (1, 2, at(2), 104.0), (1, 3, at(3), 0.0), (1, 4, at(4), 200.0)], "card_id long, event_id long, ts timestamp, price double")
    prices.coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = "alert_id long, card_id long, threshold_above double, threshold_below double, spread_threshold double, is_active boolean, last_triggered_at timestamp"
    alerts = spark.createDataFrame([(1, 1, 150.0, None, None, True, None), (2, 1, 0.0, None, 5.0, True, None), (3, 1, None, 60.0, None, True, at(1)), (4, 1, 1.0, None, None, False, None)], rules)
    medians = spark.createDataFrame([(1, 100.0)], "card_id long, median_sold double")
    got = Z.run_available(Z.alerts_stream(Z.read_folder(spark, str(tmp_path / "in"), prices.schema), alerts, medians)).collect()
    assert sorted((r["alert_id"], r["event_id"], r["fired"]) for r in got) == [(1, 4, "above"), (2, 2, "spread_below")]
