"""The refresh cycle: the steps of one round, each reading the version that the step before has published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thinmarket.operators import alerts as N
from thinmarket.operators import market as M
from thinmarket.operators import predictions as R
from thinmarket.operators import screener as G
from thinmarket.operators import series as S
from thinmarket.sources import feeds
from thinmarket.sources.versions import TableStore

#: ``seq`` of bars that a round adds, beyond those of any feed, so that of one day's bars these are the newest.
BULK_SEQ, WEEKLY_SEQ = 1 << 40, (1 << 40) + 1
#: Parts in which a round's sales are judged, one after the other: they shuffle more than any other step.
SALE_PARTS = 4


def begin(store: TableStore, cards: DataFrame, price_history: DataFrame | None, sales: DataFrame, alerts: DataFrame, predictions: DataFrame) -> None:
    """The first version: the tables that the rounds go on from.

    ``cards`` carries product_id and updated_at, ``sales`` listing_id; predictions get the columns that back-filling adds.
    Without ``price_history`` the store keeps the one that it has.
    """
    made = {**{f"price_{h}d": "double" for h in R.HORIZONS}, **{f"return_pct_{h}d": "double" for h in R.RETURN_HORIZONS}, "outcome": "string"}
    filled = predictions.withColumns({c: F.lit(None).cast(kind) for c, kind in made.items() if c not in predictions.columns})
    bars = {} if price_history is None else {"price_history": price_history}
    store.publish("begin", "begin", replace={"cards": cards, **bars, "sales": sales, "alerts": alerts, "predictions": filled})


def _like(rows: DataFrame, table: DataFrame, **added: Column) -> DataFrame:
    """The rows with the columns of the table, those they lack as given or null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else added.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ])


def run_round(store: TableStore, entries: DataFrame, raw_sales: DataFrame, as_of: Column, round_id: str, min_days: int = 30) -> None:
    """One whole round: prices, sales, weekly bars, current prices, metrics, alerts, predictions, anomalies.

    Every step reads tables from the store, where the step before has published its result, and
    publishes its own. A round that was stopped goes on after its last published step; a round that
    is done changes nothing. ``raw_sales`` has the feed's columns and those of sales.
    """

    def bulk_prices() -> None:
        cards, history = store.read("cards"), store.read("price_history")
        decided = feeds.bulk_price_update(cards, entries, as_of)
        rows = _like(feeds.bulk_history_rows(decided, history, as_of), history, seq=F.lit(BULK_SEQ))
        store.publish(round_id, "bulk_prices", replace={"cards": feeds.apply_bulk_prices(cards, decided, as_of).select(*cards.columns)}, append={"price_history": rows})

    def new_sales() -> None:
        sales = store.read("sales")
        fresh = []
        for raw, known in feeds.sale_parts(raw_sales, sales.select("listing_id"), SALE_PARTS):
            judged = feeds.dedup_sales(raw, known)
            fresh.append(_like(judged.filter("status = 'new'").withColumnRenamed("purchasePrice", "purchase_price"), sales))
        store.publish(round_id, "sales", append={"sales": fresh})

    def weekly_bars() -> None:
        history = store.read("price_history")
        bars = S.weekly_bars_from_sales(store.read("sales"), store.read("cards"), history, min_days=min_days)
        store.publish(round_id, "weekly_bars", append={"price_history": _like(bars, history, seq=F.lit(WEEKLY_SEQ))})

    def current_prices() -> None:
        cards = store.read("cards")
        newest = S.latest_price(store.read("price_history"), cards)
        priced = cards.drop("current_price").join(newest, "card_id", "left").select(*cards.columns)
        store.publish(round_id, "current_prices", replace={"cards": priced})

    def metrics() -> None:
        store.publish(round_id, "metrics", replace={"card_metrics": G.batch_metrics(store.read("price_history"), store.read("cards"), store.read("sales"), as_of)})

    def fired_alerts() -> None:
        alerts = store.read("alerts")
        fired = N.fire_alerts(alerts, store.read("cards"), store.read("sales"), as_of).withColumn("fired_at", as_of.cast("timestamp"))
        marked = alerts.join(fired.select("alert_id", "fired_at"), "alert_id", "left").withColumn("last_triggered_at", F.coalesce("fired_at", "last_triggered_at"))
        store.publish(round_id, "alerts", replace={"alerts": marked.select(*alerts.columns)}, append={"fired_alerts": fired})

    def filled_predictions() -> None:
        filled = R.backfill_predictions(store.read("predictions"), S.dedup_by_date(store.read("price_history")), store.read("cards"), as_of)
        store.publish(round_id, "predictions", replace={"predictions": filled})

    def auto_predictions() -> None:
        table = store.read("predictions")
        rows = R.auto_predictions(M.hot_cards(store.read("price_history"), store.read("cards"), 20), table, as_of)
        store.publish(round_id, "auto_predictions", append={"predictions": _like(rows, table, outcome=F.lit("pending"))})

    def anomalies() -> None:
        store.publish(round_id, "anomalies", replace={"anomalies": M.price_anomalies(store.read("price_history"), store.read("cards"), as_of, days=90)})

    steps: dict[str, Callable[[], None]] = {
        "bulk_prices": bulk_prices, "sales": new_sales, "weekly_bars": weekly_bars, "current_prices": current_prices, "metrics": metrics,
        "alerts": fired_alerts, "predictions": filled_predictions, "auto_predictions": auto_predictions, "anomalies": anomalies,
    }
    for name, step in steps.items():
        if not store.done(round_id, name):
            step()


def refresh_stream(store: TableStore, raw_sales: DataFrame, entries: Callable[[], DataFrame], as_of: Callable[[], Column], path: str) -> StreamingQuery:
    """Rounds driven by landed sales: each micro-batch is a round named by its number.

    A batch that is run again after a failure finds its published steps in the store and only does the
    rest, so the tables are as if it had run once.
    """
    def batch(rows: DataFrame, number: int) -> None:
        run_round(store, entries(), rows, as_of(), f"batch-{number}")

    return raw_sales.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
