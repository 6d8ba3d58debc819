"""Structured Streaming forms of the polling loop.

Sources are folders of landed files, read with ``availableNow`` or continuously; the number of
files per trigger bounds a micro-batch. State lives under the cluster's checkpoint folder. Sinks
are Parquet folders: nothing is kept on the driver.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thinmarket.session import checkpoint_root
from thinmarket.sources.sinks import read_or_empty

DAY = pd.Timedelta(hours=24)


def read_folder(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def run_available(stream: DataFrame, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None, path: str | None = None) -> DataFrame:
    """Drains a stream into a Parquet folder and returns that table.

    ``path`` holds the checkpoint and the output: a later call with the same path goes on where the
    last one stopped, with its state, and reads new files only. Without it a new folder is made below
    the cluster's shared one. Every micro-batch overwrites its own subfolder, so a batch repeated
    after a failure leaves the table as it was; a stream without any file gives an empty table.
    """
    spark = stream.sparkSession
    base = path or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return read_or_empty(spark, out, spark.createDataFrame([], stream.schema)).select(*stream.columns)


def dedup_sales_stream(sales: DataFrame, key: str = "listing_id", time: str = "order_date", delay: str = "7 days") -> DataFrame:
    """Each sale key once within the watermark."""
    return sales.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def velocity_stream(sales: DataFrame, time: str = "order_date", span: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sales per card in sliding weeks."""
    return (
        sales.withWatermark(time, delay).groupBy(F.window(time, span, slide), "card_id").agg(F.count("*").alias("n_sales"))
        .select("card_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_sales", (F.col("n_sales") / 7.0).alias("velocity"))
    )


def daily_bars_stream(sales: DataFrame, time: str = "order_date", delay: str = "1 day") -> DataFrame:
    """Daily price bars per card. The exact median needs all values: use the batch job for it."""
    price = F.col("purchase_price")
    return (
        sales.withWatermark(time, delay).groupBy(F.window(time, "1 day"), "card_id")
        .agg(F.avg(price).alias("market_price"), F.min(price).alias("low_price"), F.max(price).alias("high_price"), F.count("*").alias("n_sales"))
        .select("card_id", F.col("window.start").alias("start"), "market_price", "low_price", "high_price", "n_sales")
    )


GATE_OUTPUT = T.StructType(
    [
        T.StructField("card_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("price", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
    ]
)
GATE_STATE = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("at", T.TimestampType())])


def gate_steps(rows: list[tuple], last: tuple | None) -> tuple[list[bool], tuple | None]:
    """Accepts prices within reach of the last accepted one; after a week the reach is wider."""
    accepted = []
    for price, at in rows:
        ok = True
        if last is not None and last[0] > 0:
            wide = (at - last[1]).days > 7
            low, high = (0.1, 10.0) if wide else (0.33, 3.0)
            ok = low <= price / last[0] <= high
        accepted.append(ok)
        if ok:
            last = (price, at)
    return accepted, last


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one card's share of one micro-batch
    last = state.get if state.exists else None
    accepted, last = gate_steps(list(zip(rows["price"], rows["ts"].tolist())), last)
    state.update(last)
    yield pd.DataFrame({"card_id": key[0], "event_id": rows["event_id"].to_numpy(), "price": rows["price"].to_numpy(), "accepted": accepted})


WAITING_STATE = T.StructType(
    [
        T.StructField("price", T.DoubleType()), T.StructField("at", T.LongType()), T.StructField("waiting_us", T.ArrayType(T.LongType())),
        T.StructField("waiting_id", T.ArrayType(T.LongType())), T.StructField("waiting_price", T.ArrayType(T.DoubleType())),
    ]
)


def _gate_in_order(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Prices wait in the state until the watermark has passed them and are then judged by time, whatever batch brought them."""
    price, at, us, ids, prices = state.get if state.exists else (None, None, [], [], [])
    waiting = list(zip(us, ids, prices))
    for f in batches:
        waiting += zip(f["ts"].astype("datetime64[us]").astype("int64").tolist(), f["event_id"].tolist(), f["price"].tolist())
    waiting.sort()
    watermark = state.getCurrentWatermarkMs()
    n = bisect.bisect_left(waiting, watermark, key=lambda w: w[0] // 1000)
    last = None if price is None else (price, pd.Timestamp(at, unit="us"))
    accepted, last = gate_steps([(p, pd.Timestamp(t, unit="us")) for t, _, p in waiting[:n]], last)
    left = waiting[n:]
    state.update((last and last[0], last and last[1].value // 1000, [t for t, _, _ in left], [i for _, i, _ in left], [p for _, _, p in left]))
    if left:
        state.setTimeoutTimestamp(max(left[0][0] // 1000, watermark + 1))
    if n:
        yield pd.DataFrame({"card_id": [key[0]] * n, "event_id": [i for _, i, _ in waiting[:n]], "price": [p for _, _, p in waiting[:n]], "accepted": accepted})


def price_gate_stream(prices: DataFrame, delay: str | None = None) -> DataFrame:
    """Every price with whether the gate lets it pass (card_id, event_id, ts, price).

    With a ``delay`` a price is judged when the watermark, so far behind the newest time, has passed it:
    prices that come late by less are judged in their order, and how files are split changes nothing. A card's state
    holds its prices of one delay. A price that comes later than that is dropped, as by every watermark. Without a
    delay each micro-batch is judged as it comes.
    """
    if delay is None:
        return prices.groupBy("card_id").applyInPandasWithState(_gate, GATE_OUTPUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout)
    timed = prices.withWatermark("ts", delay)
    return timed.groupBy("card_id").applyInPandasWithState(_gate_in_order, GATE_OUTPUT, WAITING_STATE, "append", GroupStateTimeout.EventTimeTimeout)


ALERT_OUTPUT = T.StructType(
    [
        T.StructField("alert_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("price", T.DoubleType()), T.StructField("fired", T.StringType()),
    ]
)
ALERT_STATE = T.StructType([T.StructField("done", T.BooleanType())])


def _first_fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = None
    for pdf in batches:
        # Keys are many and their rows few: plain arrays, no sort of a frame.
        ts, ids = pdf["ts"].to_numpy(), pdf["event_id"].to_numpy()
        at = np.lexsort((ids, ts))[0]
        row = (ts[at], ids[at], pdf["price"].to_numpy()[at], pdf["fired"].to_numpy()[at])
        if best is None or row[:2] < best[:2]:
            best = row
    if not state.exists and best is not None:
        state.update((True,))
        yield pd.DataFrame({"alert_id": [key[0]], "event_id": [best[1]], "price": [best[2]], "fired": [best[3]]})


def alerts_stream(prices: DataFrame, alerts: DataFrame, medians: DataFrame) -> DataFrame:
    """Rules that fire, each once, not within a day of its last firing.

    The first that holds of: at or above, at or below (a threshold of 0 is none), distance from the
    card's median sale of ``medians`` (card_id, median_sold) in percent. Rows that fire nothing are
    dropped before the state, so only hits are shuffled.
    """
    price, median = F.col("price"), F.col("median_sold")
    above = (F.col("threshold_above") != 0) & (price >= F.col("threshold_above"))
    below = (F.col("threshold_below") != 0) & (price <= F.col("threshold_below"))
    close = (median > 0) & (F.abs(price - median) / median * 100 <= F.col("spread_threshold"))
    hit = F.when(above, "above").when(below, "below").when(close, "spread_below")
    quiet = F.col("last_triggered_at").isNull() | (F.col("ts") >= F.col("last_triggered_at") + F.expr("INTERVAL 24 HOURS"))
    rules = alerts.filter("is_active").join(medians, "card_id", "left")
    hits = prices.filter("price > 0").join(rules, "card_id").filter(quiet).withColumn("fired", hit).filter("fired IS NOT NULL")
    return hits.select("alert_id", "event_id", "ts", "price", "fired").groupBy("alert_id").applyInPandasWithState(
        _first_fire, ALERT_OUTPUT, ALERT_STATE, "append", GroupStateTimeout.NoTimeout
    )


def viable_stream(prices: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Sticky flag per card: true from the first price at the threshold on (update mode)."""
    return prices.groupBy("card_id").agg((F.max("price") >= threshold).alias("is_viable"))


INSIGHT_OUTPUT = T.StructType(
    [
        T.StructField("insight_id", T.LongType()), T.StructField("card_id", T.LongType()), T.StructField("type", T.StringType()),
        T.StructField("open_id", T.LongType()), T.StructField("action", T.StringType()),
    ]
)
INSIGHT_STATE = T.StructType([T.StructField("open_id", T.LongType()), T.StructField("at", T.TimestampType())])


def open_insights(times: pd.Series, ids: pd.Series, last: tuple | None) -> tuple[list, tuple | None]:
    """The open insight that each of some insights in order of time belongs to, and the last one.

    One opens at the first insight and at the first one more than a day after the last opening. A
    late insight, older than the open one, belongs to it.
    """
    out, i, days, ids = [], 0, times.to_numpy(), ids.to_numpy()
    while i < len(days):
        if last is None or days[i] > (last[1] + DAY).to_datetime64():
            last = (int(ids[i]), pd.Timestamp(days[i]))
        end = int(np.searchsorted(days, (last[1] + DAY).to_datetime64(), side="right"))
        out += [last[0]] * (end - i)
        i = end
    return out, last


def _opened(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # One key's share of one micro-batch. Keys are many and their rows few: plain arrays, one frame at the end.
    parts = [(f["created_at"].to_numpy(), f["insight_id"].to_numpy()) for f in batches]
    times, ids = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((ids, times))
    last = (state.get[0], pd.Timestamp(state.get[1])) if state.exists else None
    ids = ids[order]
    open_id, last = open_insights(pd.Series(times[order]), pd.Series(ids), last)
    state.update((last[0], last[1].to_pydatetime()))
    action = np.where(ids == np.array(open_id), "insert", "update")
    yield pd.DataFrame({"insight_id": ids, "card_id": key[0], "type": key[1], "open_id": open_id, "action": action})


def insight_dedup_stream(insights: DataFrame) -> DataFrame:
    """Each insight (insight_id, card_id, type, created_at) as an insert, or as an update of the open one of its card and type.

    An insight stays open for a day from its creation, not from its last update. Insights are taken in
    the order of time within a micro-batch; the state holds the open one only.
    """
    rows = insights.select("insight_id", "card_id", "type", "created_at")
    return rows.groupBy("card_id", "type").applyInPandasWithState(_opened, INSIGHT_OUTPUT, INSIGHT_STATE, "append", GroupStateTimeout.NoTimeout)
