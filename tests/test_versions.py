"""Committed versions: whole steps or none, and a round that goes on where it was stopped."""

import pytest
from pyspark.sql import functions as F

from thinmarket.operators import alerts as N
from thinmarket.plans.binding import Tables
from thinmarket.plans.ingest import entries, mapped_cards
from thinmarket.plans.streams import feed_sales
from thinmarket.sources import feeds
from thinmarket.sources.versions import TableStore
from thinmarket.streaming import cycle

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_steps_are_whole_or_absent(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert store.version == 0 and not store.done("r", "s")
    assert store.publish("r", "s", replace={"t": one, "u": two})
    assert store.version == 1 and store.done("r", "s") and rows(store.read("t")) == [(1, "a")]
    # written but never listed: a step that was stopped before its manifest
    two.write.parquet(f"{tmp_path}/t/stopped")
    assert rows(store.read("t")) == [(1, "a")]
    assert store.publish("r", "more", append={"t": two}) and rows(store.read("t")) == [(1, "a"), (2, "b")] and rows(store.read("u")) == [(2, "b")]
    assert rows(store.added("r", "more", "t")) == [(2, "b")]
    assert not store.publish("r", "more", append={"t": two}) and store.version == 2 and store.read("t").count() == 2
    assert store.publish("q", "more", replace={"t": two}) and rows(TableStore(spark, str(tmp_path)).read("t")) == [(2, "b")]
    broken = one.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.publish("q", "next", replace={"t": two, "u": broken})
    assert store.version == 3 and rows(store.read("u")) == [(2, "b")]
    assert store.publish("q", "empty", append={"t": one.limit(0)}) and rows(store.read("t")) == [(2, "b")]


def test_round_resumes_and_repeats_nothing(spark, tmp_path, monkeypatch):
    t = Tables(spark, SF)
    stored = feeds.sale_keys(feed_sales(t.sales.filter("seq % 5 <> 0"))).select(*t.sales.columns, "listing_id")
    fed = feed_sales(t.sales.filter("seq % 2 = 0")).drop("order_date", "purchase_price")
    whole, stopped = TableStore(spark, f"{tmp_path}/whole"), TableStore(spark, f"{tmp_path}/stopped")
    for store in (whole, stopped):
        cycle.begin(store, mapped_cards(t), t.price_history, stored, t.alerts, t.predictions)
    cycle.run_round(whole, entries(t), fed, t.as_of, "one", min_days=1_000_000)

    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(N, "fire_alerts", lost)
    with pytest.raises(RuntimeError):
        cycle.run_round(stopped, entries(t), fed, t.as_of, "one", min_days=1_000_000)
    assert stopped.version == 6 and stopped.done("one", "metrics") and not stopped.done("one", "alerts")
    monkeypatch.undo()
    cycle.run_round(stopped, entries(t), fed, t.as_of, "one", min_days=1_000_000)
    tables = ("cards", "price_history", "sales", "card_metrics", "alerts", "fired_alerts", "predictions", "anomalies")
    before = {name: rows(whole.read(name).select([F.col(c).cast("string") for c in whole.read(name).columns]).fillna("")) for name in tables}
    for name in tables:
        assert before[name] == rows(stopped.read(name).select([F.col(c).cast("string") for c in stopped.read(name).columns]).fillna(""))
    version = whole.version
    cycle.run_round(whole, entries(t), fed, t.as_of, "one", min_days=1_000_000)
    assert whole.version == version == 10


def test_stream_of_landed_sales(spark, tmp_path):
    t = Tables(spark, SF)
    some = t.sales.filter("card_id < 4")
    store = TableStore(spark, f"{tmp_path}/store")
    stored = feeds.sale_keys(feed_sales(some.filter("seq % 5 = 0"))).select(*t.sales.columns, "listing_id")
    cycle.begin(store, mapped_cards(t), t.price_history, stored, t.alerts, t.predictions)
    landed = feed_sales(some).drop("order_date", "purchase_price")
    landed.coalesce(1).write.parquet(f"{tmp_path}/landing")
    stream = spark.readStream.schema(landed.schema).parquet(f"{tmp_path}/landing")
    for _ in range(2):  # the second start finds nothing new
        cycle.refresh_stream(store, stream, lambda: entries(t), lambda: F.lit("1998-12-01").cast("date"), f"{tmp_path}/job").awaitTermination()
        assert store.version == 10
    keys = store.read("sales").groupBy("listing_id").count()
    assert keys.filter("count > 1").join(stored.select("listing_id"), "listing_id", "left_anti").isEmpty()
    assert keys.count() == feeds.sale_keys(feed_sales(some)).select("listing_id").distinct().count()
