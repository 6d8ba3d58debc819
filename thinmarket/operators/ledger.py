"""Portfolio analytics over a ledger of fills."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions.numeric import pct_change, rnd

# Value of a condition relative to Near Mint, as two places use it.
CONDITION_MULTIPLIERS = {
    "holdings": {"NM": 1.0, "LP": 0.87, "MP": 0.75, "HP": 0.55, "DMG": 0.35},
    "collection": {"NM": 1.0, "LP": 0.85, "MP": 0.7, "HP": 0.5, "DMG": 0.3},
}
TRADING_DAYS = 252


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills in order, key by key, to one position a key; only the position in hand is kept.

    A row with side ``state`` is a position of an earlier run; fills up to its last one are in it already.
    """
    schema = None
    key, q, avg, entry, strategy, last = None, 0, 0.0, None, None, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        if schema is None:
            kinds = {f.name: f.type for f in batch.schema}
            schema = pa.schema([
                ("portfolio_id", kinds["portfolio_id"]), ("card_id", kinds["card_id"]), ("quantity", pa.int64()), ("avg_entry_price", pa.float64()),
                ("entry_us", pa.int64()), ("strategy", pa.string()), ("last_us", pa.int64()), ("last_trade_id", kinds["trade_id"]),
            ])
        done = []
        for portfolio, card, at, trade, side, quantity, price, by, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (portfolio, card) != key:
                if key is not None:
                    done.append((*key, q, avg, entry, strategy, *(last or (None, None))))
                key, q, avg, entry, strategy, last = (portfolio, card), 0, 0.0, None, None, None
            if side == "state":
                q, avg, entry, strategy, last = quantity, price, opened, by, (at, trade)
                continue
            if last is not None and (at, trade) <= last:
                continue
            if q == 0:
                avg, entry, strategy = 0.0, at, by
            if side == "buy":
                avg = round((avg * q + price * quantity) / (q + quantity) + 1e-9, 2) if q + quantity else 0.0
                q += quantity
            else:
                q -= quantity
            last = (at, trade)
        if done:
            yield told(done)
    if key is not None:
        yield told([(*key, q, avg, entry, strategy, *(last or (None, None)))])


def position_snapshot(trades: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The state of every (portfolio, card) after all its fills, flat ones too, from which a later run goes on.

    Fills meet by key and are sorted by time on disk if need be; one pass folds them, a buy averages in, a
    sell keeps the average, and a flat position starts over. Memory holds one position, however many
    fills it has. ``before`` is an earlier snapshot: its states come first and fills that it covers are
    passed over, so new fills alone, or some of the old ones again, give what all fills give. The average is rounded at each
    fill, so a position's fills have to be taken in turn. Columns: portfolio_id, card_id, quantity, avg_entry_price, entry_us
    and strategy of the first fill since it was flat, last_us and last_trade_id; times in microseconds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in trades.schema.fields}
    fills = trades.select(
        "portfolio_id", "card_id", F.unix_micros("executed_at").alias("us"), "trade_id", "side", F.col("quantity").cast("long").alias("quantity"), F.col("price").cast("double").alias("price"),
        F.col("strategy").cast("string").alias("strategy"), F.lit(None).cast("long").alias("opened"),
    )
    if before is not None:
        fills = fills.unionByName(before.select(
            "portfolio_id", "card_id", F.col("last_us").alias("us"), F.col("last_trade_id").alias("trade_id"), F.lit("state").alias("side"), "quantity", F.col("avg_entry_price").alias("price"), "strategy", F.col("entry_us").alias("opened"),
        ))
    placed = fills.repartition("portfolio_id", "card_id").sortWithinPartitions("portfolio_id", "card_id", F.col("side") != "state", "us", "trade_id")
    shape = f"portfolio_id {kinds['portfolio_id']}, card_id {kinds['card_id']}, quantity long, avg_entry_price double, entry_us long, strategy string, last_us long, last_trade_id {kinds['trade_id']}"
    return placed.mapInArrow(_fold, shape)


def positions_from_trades(trades: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Open positions: fills folded in time order, a buy averages in, a sell keeps the average."""
    held = position_snapshot(trades, before).filter("quantity > 0")
    return held.select("portfolio_id", "card_id", "quantity", "avg_entry_price", F.timestamp_micros("entry_us").alias("entry_date"), "strategy")


def fill_costs(orders: DataFrame, cards: DataFrame, liquidity: DataFrame, positions: DataFrame) -> DataFrame:
    """Execution price, slippage, fee, net and realised result of orders at current prices.

    Slippage is in percent here; buyers pay more and sellers get less.
    """
    rows = (
        orders.join(cards.filter("current_price > 0").select("card_id", F.col("current_price").alias("market")), "card_id")
        .join(liquidity.select("card_id", "sales_per_day"), "card_id", "left")
        .join(positions.select("portfolio_id", "card_id", "avg_entry_price"), ["portfolio_id", "card_id"], "left")
    )
    buy = F.col("side") == "buy"
    slip = E.slippage_pct(F.col("market"), F.coalesce("sales_per_day", F.lit(0.0)))
    rows = rows.withColumn("slippage_pct", rnd(slip)).withColumn(
        "execution_price", rnd(F.col("market") * F.when(buy, 1 + slip / 100).otherwise(1 - slip / 100))
    )
    gross = rnd(F.col("execution_price") * F.col("quantity"))
    rows = rows.withColumn("gross", gross).withColumn(
        "slippage_cost", rnd(F.abs(F.col("execution_price") - F.col("market")) * F.col("quantity"))
    ).withColumn("fee_cost", F.when(buy, 0.0).otherwise(rnd(F.col("gross") * E.LEDGER_FEE_RATE)))
    net = F.when(buy, F.col("gross")).otherwise(rnd(F.col("gross") - F.col("fee_cost")))
    basis = rnd(F.col("avg_entry_price") * F.col("quantity"))
    rows = rows.withColumn("total_cost", net).withColumn("basis", F.when(~buy, basis))
    pnl = rnd(F.col("total_cost") - F.col("basis"))
    return rows.withColumn("new_pnl", pnl).withColumn(
        "new_pnl_pct", F.when(F.col("basis") > 0, rnd(F.col("new_pnl") / F.col("basis") * 100))
    )


def mark_to_market(portfolios: DataFrame, positions: DataFrame, cards: DataFrame) -> DataFrame:
    """Value, unrealised result and high-water mark per portfolio at current prices."""
    price = F.col("current_price")
    held = positions.join(cards.filter("current_price > 0").select("card_id", "current_price"), "card_id")
    value, cost = price * F.col("quantity"), F.col("avg_entry_price") * F.col("quantity")
    sums = held.groupBy("portfolio_id").agg(
        F.sum(value).alias("v"), F.sum(rnd(value - cost)).alias("u"), F.count("*").alias("num_positions")
    )
    rows = portfolios.join(sums, "portfolio_id", "left")
    total = rnd(F.col("cash") + F.coalesce("v", F.lit(0.0)))
    return rows.select(
        "portfolio_id", "cash", rnd(F.coalesce("v", F.lit(0.0))).alias("positions_value"), rnd(F.coalesce("u", F.lit(0.0))).alias("unrealized_pnl"),
        total.alias("total_value"), F.greatest(F.col("high_water_mark"), total).alias("high_water_mark"),
        F.coalesce("num_positions", F.lit(0)).alias("num_positions"),
    )


def daily_snapshots(marks: DataFrame, capital: float) -> DataFrame:
    """One row per portfolio and day from timed marks; the last mark of a day wins.

    Of ``cash``, ``positions_value`` and ``num_positions`` those that the marks have come along, from the same mark.
    """
    carried = [c for c in ("cash", "positions_value", "num_positions") if c in marks.columns]
    w = Window.partitionBy("portfolio_id").orderBy("date")
    total = F.col("total_value")
    daily = marks.groupBy("portfolio_id", F.to_date("marked_at").alias("date")).agg(
        F.max_by(F.struct("total_value", *carried), F.struct("marked_at", "mark_id")).alias("mark")
    ).select("portfolio_id", "date", "mark.*")
    peak = F.greatest(F.lit(capital), F.max("total_value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = daily.withColumn("prev", F.coalesce(F.lag("total_value").over(w), F.lit(capital))).withColumn("high_water_mark", peak)
    return rows.select(
        "portfolio_id", "date", rnd(total).alias("total_value"), rnd(total - F.col("prev")).alias("daily_pnl"),
        F.when(F.col("prev") > 0, rnd((total - F.col("prev")) / F.col("prev") * 100)).alias("daily_pnl_pct"),
        rnd(total - capital).alias("cumulative_pnl"), rnd((total - capital) / capital * 100).alias("cumulative_pnl_pct"),
        rnd(F.col("high_water_mark")).alias("high_water_mark"),
        rnd((F.col("high_water_mark") - total) / F.col("high_water_mark") * 100).alias("drawdown_pct"),
        *[F.col(c) if c == "num_positions" else rnd(F.col(c)).alias(c) for c in carried],
    )


def _sell_stats() -> list[Column]:
    pnl = F.col("realized_pnl")
    win, loss = pnl > 0, pnl <= 0
    won, lost = F.coalesce(F.sum(F.when(win, pnl)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(loss, pnl)), F.lit(0.0)))
    return [
        F.count("*").alias("total_sells"), F.count_if(win).alias("winning_trades"), F.count_if(loss).alias("losing_trades"),
        rnd(F.count_if(win) / F.count("*") * 100, 1).alias("win_rate"),
        rnd(F.coalesce(F.avg(F.when(win, pnl)), F.lit(0.0))).alias("avg_win"), rnd(F.coalesce(F.avg(F.when(loss, pnl)), F.lit(0.0))).alias("avg_loss"),
        F.when(lost > 0, rnd(won / lost)).alias("profit_factor"), F.max(pnl).alias("best_trade"), F.min(pnl).alias("worst_trade"),
    ]


def portfolio_summary(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Closed-trade statistics with the drawdown and the last value of each portfolio."""
    sells = trades.filter("side = 'sell' AND realized_pnl IS NOT NULL").groupBy("portfolio_id").agg(*_sell_stats())
    curve = snapshots.groupBy("portfolio_id").agg(
        F.max("drawdown_pct").alias("max_drawdown_pct"), F.max_by("total_value", "date").alias("total_value"),
        F.max_by("cumulative_pnl_pct", "date").alias("total_return_pct"),
    )
    return curve.join(sells, "portfolio_id", "left")


def recent_trades(trades: DataFrame, cards: DataFrame, limit: int = 20) -> DataFrame:
    """The newest trades of each portfolio with the card's name; trades of one moment by falling id.

    The rank filter cuts every portfolio's rows before the shuffle, so one with most of all trades is no hot key.
    """
    w = Window.partitionBy("portfolio_id").orderBy(F.desc("executed_at"), F.desc("trade_id"))
    newest = trades.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return newest.join(cards.select("card_id", F.col("name").alias("card_name")), "card_id", "left").withColumn("card_name", F.coalesce("card_name", F.lit("Unknown")))


def sharpe(snapshots: DataFrame) -> DataFrame:
    r = F.col("daily_pnl_pct")
    return snapshots.groupBy("portfolio_id").agg(
        F.when((F.count(r) > 1) & (F.stddev_samp(r) > 0), rnd(F.avg(r) / F.stddev_samp(r) * (TRADING_DAYS**0.5))).otherwise(0.0).alias("sharpe_ratio")
    )


def performance_analytics(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    return portfolio_summary(trades, snapshots).join(sharpe(snapshots), "portfolio_id")


def performance_breakdown(trades: DataFrame) -> DataFrame:
    """Closed trades by strategy and by signal over all portfolios, in one grouping-sets pass."""
    pnl = F.col("realized_pnl")
    sells = trades.filter("side = 'sell' AND realized_pnl IS NOT NULL")
    return sells.groupingSets([["strategy"], ["signal"]], "strategy", "signal").agg(
        F.count("*").alias("count"), F.count_if(pnl > 0).alias("wins"), rnd(F.sum(pnl)).alias("total_pnl"),
        rnd(F.count_if(pnl > 0) / F.count("*") * 100, 1).alias("win_rate"), rnd(F.avg(pnl)).alias("avg_pnl"),
    )


def leaderboard(portfolios: DataFrame, limit: int = 100) -> DataFrame:
    return portfolios.filter("is_active").orderBy(F.desc("total_return_pct"), "portfolio_id").limit(limit)


def equity_curve(snapshots: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return snapshots.filter(F.col("date") >= F.date_sub(as_of, days)).orderBy("portfolio_id", "date")


def concentration(positions: DataFrame, cards: DataFrame) -> DataFrame:
    """Market value per portfolio by set and by the first word of the name, with its share."""
    held = positions.join(cards.filter("current_price > 0").select("card_id", "name", "set_name", "current_price"), "card_id")
    value = F.col("current_price") * F.col("quantity")
    by = F.inline(
        F.array(
            F.struct(F.lit("set").alias("dimension"), F.col("set_name").alias("key")),
            F.struct(F.lit("name").alias("dimension"), F.get(F.split("name", r"\s+"), F.lit(0)).alias("key")),
        )
    )
    sums = held.select("portfolio_id", value.alias("v"), by).groupBy("portfolio_id", "dimension", "key").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("portfolio_id", "dimension")
    return sums.select("portfolio_id", "dimension", "key", rnd(F.col("v")).alias("market_value"), rnd(F.col("v") / F.sum("v").over(w) * 100).alias("share_pct"))


def condition_multiplier(condition: Column, table: str = "holdings") -> Column:
    pairs = [F.lit(x) for kv in CONDITION_MULTIPLIERS[table].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), condition), F.lit(1.0))


def holdings_valuation(lots: DataFrame, cards: DataFrame, table: str = "holdings") -> DataFrame:
    """Lots of (owner, card, condition) valued at current prices, with the share of the whole."""
    sums = lots.groupBy("portfolio_id", "card_id", "condition").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("cost")
    )
    rows = sums.join(cards.filter("current_price > 0").select("card_id", "current_price"), "card_id").withColumn(
        "value", F.col("current_price") * condition_multiplier(F.col("condition"), table) * F.col("quantity")
    )
    w = Window.partitionBy("portfolio_id")
    return rows.select(
        "portfolio_id", "card_id", "condition", "quantity", rnd(F.col("cost") / F.col("quantity")).alias("avg_cost"), rnd(F.col("value")).alias("value"),
        rnd(F.col("value") - F.col("cost")).alias("pnl"), F.when(F.col("cost") > 0, rnd((F.col("value") - F.col("cost")) / F.col("cost") * 100)).alias("pnl_pct"),
        rnd(F.col("value") / F.sum("value").over(w) * 100).alias("share_pct"),
    )


def holdings_summary(valued: DataFrame) -> DataFrame:
    """Totals of each owner's valued lots with the best, worst and largest holding; the smallest (card, condition) wins ties."""
    value, pct, key = F.col("value"), F.col("pnl_pct"), F.struct("card_id", "condition")
    cost = value - F.col("pnl")
    # Ranks by aggregation, so that an owner with most of all lots meets in no window.
    best, worst, most = (F.struct(by.alias("by"), key.alias("of")) for by in (-pct, pct, -value))
    known = pct.isNotNull()
    sums = valued.groupBy("portfolio_id").agg(
        F.count("*").alias("holdings"), F.sum(value).alias("v"), F.sum(cost).alias("c"), F.max(value).alias("largest"),
        F.min(F.when(known, best)).alias("b"), F.min(F.when(known, worst)).alias("w"), F.min(most).alias("m"),
    )
    total, paid = F.col("v"), F.col("c")
    return sums.select(
        "portfolio_id", "holdings", rnd(total).alias("total_value"), rnd(paid).alias("total_cost"), F.when(paid > 0, rnd(total - paid)).alias("total_pnl"),
        F.col("b.of.card_id").alias("best_card_id"), F.negative("b.by").alias("best_pct"), F.col("w.of.card_id").alias("worst_card_id"), F.col("w.by").alias("worst_pct"),
        F.when(total > 0, F.col("m.of.card_id")).alias("largest_card_id"), F.when(total > 0, rnd(F.col("largest") / total * 100)).otherwise(0.0).alias("largest_pct"),
    )


def sold_summary(sold: DataFrame) -> DataFrame:
    """Total profit, mean return and win rate of sold lots (break-even counts as a win)."""
    profit = (F.col("sold_price") - F.col("cost")) * F.col("quantity")
    roi = F.coalesce(pct_change(F.col("sold_price"), F.col("cost")), F.lit(0.0))
    return sold.groupBy("portfolio_id").agg(
        F.count("*").alias("sold"), rnd(F.sum(profit)).alias("total_profit"), rnd(F.avg(roi)).alias("avg_roi"),
        rnd(F.count_if(profit >= 0) / F.count("*") * 100, 1).alias("win_rate"),
    )


def vs_benchmark(values: DataFrame, index: DataFrame) -> DataFrame:
    """Portfolio value and a market index as % from the portfolio's first day, and their gap.

    The index is carried forward over the distinct days (a calendar, whatever the number of
    portfolios) and starts from its first level.
    """
    calendar = (
        values.select("date", F.lit(None).cast("double").alias("level")).distinct()
        .unionByName(index.select("date", F.col("avg_price").alias("level")))
        .groupBy("date").agg(F.max("level").alias("level"))
    )
    days = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    opening = index.agg(F.min_by("avg_price", "date")).scalar()
    levels = calendar.withColumn("level", F.coalesce(F.last("level", ignorenulls=True).over(days), opening))
    w = Window.partitionBy("portfolio_id").orderBy("date")
    rows = values.join(levels, "date").withColumn("base_value", F.first("value").over(w)).withColumn("base_level", F.first("level").over(w))
    mine, market = pct_change(F.col("value"), F.col("base_value")), pct_change(F.col("level"), F.col("base_level"))
    return rows.select(
        "portfolio_id", "date", rnd(mine).alias("portfolio_pct"), rnd(market).alias("index_pct"), rnd(mine - market).alias("difference"),
        rnd(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("peak"),
    )


def timeframe_changes(values: DataFrame, as_of: Column) -> DataFrame:
    """Change of each portfolio over 7 days, 30 days and all time, from the first day in range."""
    last = F.max_by("value", "date")

    def change(days: int | None) -> Column:
        inside = F.lit(True) if days is None else F.col("date") >= F.date_sub(as_of, days)
        return rnd(pct_change(last, F.min_by(F.when(inside, F.col("value")), F.when(inside, F.col("date")))))

    return values.groupBy("portfolio_id").agg(
        change(7).alias("week_pct"), change(30).alias("month_pct"), change(None).alias("all_pct"), rnd(F.max("value")).alias("peak")
    )
