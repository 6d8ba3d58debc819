"""Back-tests as windows over all series and strategies: no loop, no mutable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import economics as E
from thinmarket.functions.numeric import clamp, pct_change, rnd
from thinmarket.operators import series as S
from thinmarket.operators import strategies as H

MAX_RETURN_PCT = 10_000.0
YEAR = 365
TRADING_DAYS = 252


def backtest_series_of(bars: DataFrame, min_points: int = 35) -> DataFrame:
    """Dominant variant, enough bars, last record per date."""
    chosen = S.dominant_variant(bars.filter(F.col("market_price").isNotNull()))
    big = chosen.withColumn("rows", F.count("*").over(Window.partitionBy("card_id"))).filter(F.col("rows") >= min_points)
    return S.dedup_by_date(big)


def _positions(rows: DataFrame) -> DataFrame:
    """Adds whether the strategy holds after each point and the trades it makes there."""
    w = Window.partitionBy("card_id", "strategy").orderBy("i")
    side = F.last("signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("long", F.coalesce(side == "buy", F.lit(False)))
    before = F.coalesce(F.lag("long").over(w), F.lit(False))
    return rows.withColumn("was_long", before).withColumn(
        "action", F.when(F.col("long") & ~before, "buy").when(~F.col("long") & before, "sell")
    )


def _results(rows: DataFrame, capital: float, *extra: Column) -> DataFrame:
    """Collapses (value, ret, action, entry) rows to one result per card and strategy."""
    last_value = F.max_by("value", "i")
    raw = (last_value - capital) / capital * 100
    strategy_return = rnd(clamp(raw, -100.0, MAX_RETURN_PCT))
    moves = F.when(F.col("ret") != 0, F.col("ret"))
    ratio = F.when((F.count(moves) > 1) & (F.stddev_samp(moves) > 0), F.avg(moves) / F.stddev_samp(moves) * (YEAR**0.5))
    sell = F.col("action") == "sell"
    wins, losses = F.count_if(sell & (F.col("price") > F.col("entry"))), F.count_if(sell & (F.col("price") <= F.col("entry")))
    out = rows.groupBy("card_id", "strategy").agg(
        F.min("start_date").alias("start_date"), F.max("date").alias("end_date"),
        F.first("first_price").alias("initial_price"), F.max_by("price", "i").alias("final_price"),
        strategy_return.alias("strategy_return_pct"), ratio.alias("raw_sharpe"),
        F.count("action").alias("total_trades"), wins.alias("winning_trades"), losses.alias("losing_trades"),
        F.greatest(F.lit(0.0), rnd(F.max("drawdown"))).alias("max_drawdown_pct"), *extra,
    )
    done = F.col("winning_trades") + F.col("losing_trades")
    return out.withColumn("win_rate", F.when(done > 0, rnd(F.col("winning_trades") / done * 100, 1)).otherwise(0.0)).withColumn(
        "sharpe_ratio", rnd(F.when(F.col("strategy_return_pct") < 0, F.least(F.col("raw_sharpe"), F.lit(-0.01))).otherwise(F.col("raw_sharpe")))
    ).drop("raw_sharpe")


def evaluated(series: DataFrame, strategies: tuple[str, ...]) -> DataFrame:
    """Signals, positions and trades from the first evaluated point on."""
    return _positions(H.signal_rows(H.indicator_panel(series), strategies))


def equity(series: DataFrame, strategies: tuple[str, ...] = tuple(H.STRATEGIES), capital: float = 1000.0) -> DataFrame:
    """Portfolio value at every point without fees.

    Value grows by the price ratio while held: capital times exp of the running sum of logs.
    """
    w = Window.partitionBy("card_id", "strategy").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = evaluated(series, strategies).withColumn("prev_price", F.lag("price").over(w))
    growth = F.when(F.col("was_long") & (F.col("prev_price") > 0), F.col("price") / F.col("prev_price")).otherwise(1.0)
    rows = rows.withColumn("growth", growth).withColumn("value", capital * F.exp(F.sum(F.log("growth")).over(upto)))
    peak = F.greatest(F.lit(capital), F.max("value").over(upto))
    entry = F.last(F.when(F.col("action") == "buy", F.col("price")), ignorenulls=True).over(upto)
    return (
        rows.withColumn("ret", F.col("growth") - 1).withColumn("drawdown", (peak - F.col("value")) / peak * 100)
        .withColumn("entry", entry)
    )


def backtest_all(series: DataFrame, strategies: tuple[str, ...] = tuple(H.STRATEGIES), capital: float = 1000.0) -> DataFrame:
    """Every strategy on every series without fees."""
    rows = equity(series, strategies, capital)
    out = _results(rows, capital)
    hold = F.when(F.col("initial_price") > 0, rnd(pct_change(F.col("final_price"), F.col("initial_price")))).otherwise(0.0)
    return out.withColumn("buy_hold_return_pct", hold)


def backtest_fees(
    series: DataFrame, strategies: tuple[str, ...] = tuple(H.STRATEGIES), capital: float = 1000.0, platform: str = "tcgplayer"
) -> DataFrame:
    """Every strategy with buyer shipping, commission, processing and seller shipping.

    Each round trip maps cash c to g * c - k. The running solution is
    G_t * (capital - k * sum(1 / G)), with G the running product of the g. Where that is not
    positive the account is empty and no later buy happens.
    """
    f = E.platform_fees(platform)
    keep, fixed = 1 - f.rate, f.flat + f.shipping
    w = Window.partitionBy("card_id", "strategy").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = evaluated(series, strategies)
    rows = rows.withColumn("entry", F.last(F.when(F.col("action") == "buy", F.col("price")), ignorenulls=True).over(upto))
    sold = F.col("action") == "sell"
    rows = rows.withColumn("g", F.when(sold, F.col("price") / (F.col("entry") + f.buyer_shipping) * keep).otherwise(1.0))
    rows = rows.withColumn("G", F.exp(F.sum(F.log("g")).over(upto)))
    rows = rows.withColumn("left", capital - fixed * F.sum(F.when(sold, 1 / F.col("G")).otherwise(0.0)).over(upto))
    rows = rows.withColumn("alive", F.min("left").over(upto) > 0)
    rows = rows.withColumn("cash_if_flat", F.when(F.col("alive"), F.col("G") * F.col("left")).otherwise(0.0))
    # Cash put in at the last buy: what was there before that row's round trips, which a buy leaves alone.
    stake = F.when(F.col("long"), F.col("cash_if_flat"))
    units = stake / (F.col("entry") + f.buyer_shipping)
    rows = rows.withColumn("value", F.when(F.col("long"), units * F.col("price")).otherwise(F.col("cash_if_flat")))
    # An emptied account makes no further trades.
    was_alive = F.coalesce(F.lag("alive").over(w), F.lit(True))
    rows = rows.withColumn("action", F.when(was_alive, F.col("action")))
    prev = F.coalesce(F.lag("value").over(w), F.lit(capital))
    peak = F.greatest(F.lit(capital), F.max("value").over(upto))
    gross = F.lag("cash_if_flat").over(w) / (F.col("entry") + f.buyer_shipping) * F.col("price")
    # A buy that opens or a day in cash moves nothing; floating noise there must not count as a return.
    moved = F.col("was_long")
    rows = (
        rows.withColumn("ret", F.when(moved & (prev > 0), (F.col("value") - prev) / prev).otherwise(0.0))
        .withColumn("drawdown", (peak - F.col("value")) / peak * 100)
        .withColumn("fee", F.when(F.col("action") == "sell", gross - F.col("cash_if_flat")))
    )
    fees = rnd(F.coalesce(F.sum("fee"), F.lit(0.0))).alias("total_fees_paid")
    out = _results(rows, capital, fees)
    trip = E.roundtrip_pnl(F.col("initial_price"), F.col("final_price"), platform)["net_return_pct"]
    return out.withColumn("buy_hold_return_pct", F.when(F.col("initial_price") > 0, trip).otherwise(0.0)).withColumn(
        "breakeven_pct", E.breakeven(F.col("initial_price"), platform)
    )


def gross_vs_net(series: DataFrame, strategies: tuple[str, ...] = tuple(H.STRATEGIES)) -> DataFrame:
    """The same strategies with and without fees; the difference is what fees destroy."""
    gross = backtest_all(series, strategies).select("card_id", "strategy", F.col("strategy_return_pct").alias("gross_return_pct"), "total_trades")
    net = backtest_fees(series, strategies).select("card_id", "strategy", F.col("strategy_return_pct").alias("net_return_pct"), "total_fees_paid")
    return gross.join(net, ["card_id", "strategy"]).withColumn("fee_drag_pct", rnd(F.col("gross_return_pct") - F.col("net_return_pct")))


def portfolio_backtest(
    bars: DataFrame, cards: DataFrame, strategy: str = "combined", top_n: int = 10, capital: float = 10_000.0
) -> DataFrame:
    """Equal capital on the tracked cards with the longest history."""
    top = (
        bars.filter(F.col("market_price").isNotNull()).join(cards.filter("is_tracked").select("card_id"), "card_id", "left_semi")
        .groupBy("card_id").agg(F.count("*").alias("c")).filter("c >= 35").orderBy(F.desc("c"), "card_id").limit(top_n).select("card_id")
    )
    ids = F.broadcast(top)  # at most top_n ids
    results = backtest_all(backtest_series_of(bars.join(ids, "card_id", "left_semi")), (strategy,))
    rows = top.join(results, "card_id", "left")
    done = F.col("strategy_return_pct").isNotNull()
    agg = rows.agg(
        F.count("*").alias("chosen"), F.count_if(done).alias("cards_count"),
        F.sum(1 + F.coalesce("strategy_return_pct", F.lit(0.0)) / 100).alias("units"),
        F.sum(F.when(done, 1 + F.col("buy_hold_return_pct") / 100)).alias("hold_units"),
        F.coalesce(F.sum("total_trades"), F.lit(0)).alias("total_trades"),
    )
    per = F.lit(capital) / F.col("chosen")
    mine = (per * F.col("units") - capital) / capital * 100
    hold = (per * F.col("hold_units") - capital) / capital * 100
    return agg.select(
        "cards_count", rnd(per * F.col("units")).alias("final_value"), rnd(mine).alias("portfolio_return_pct"),
        rnd(hold).alias("buy_hold_return_pct"), rnd(mine - hold).alias("alpha"), "total_trades",
    )


def ensemble_signal(results: DataFrame) -> DataFrame:
    """Strategies vote per card by their back-test; a negative ratio turns the vote around."""
    r, ratio = F.col("strategy_return_pct"), F.coalesce("sharpe_ratio", F.lit(0.0))
    rising = r > 0
    buy = F.when(ratio < 0, ~rising).otherwise(rising)
    weight = F.when(ratio < 0, F.least(F.abs(ratio), F.lit(2.0))).otherwise(F.greatest(F.lit(0.1), ratio))
    votes = results.filter("total_trades > 0").groupBy("card_id").agg(
        F.sum(F.when(buy, weight).otherwise(0.0)).alias("b"), F.sum(F.when(~buy, weight).otherwise(0.0)).alias("s"), F.count("*").alias("n_votes")
    )
    total = F.col("b") + F.col("s")
    return votes.select(
        "card_id", F.when(total == 0, "HOLD").when(F.col("b") > F.col("s"), "BUY").otherwise("SELL").alias("signal"),
        F.when(total == 0, 0.0).otherwise(rnd(F.abs(F.col("b") - F.col("s")) / total)).alias("confidence"),
        rnd(F.col("b")).alias("buy_weight"), rnd(F.col("s")).alias("sell_weight"), "n_votes",
    )


def strategy_comparison(series: DataFrame, ids: DataFrame, strategies: tuple[str, ...] = ("sma_crossover", "bollinger_bounce", "combined")) -> DataFrame:
    """Three strategies on a handful of cards; the ids cut the series before anything else."""
    few = series.join(F.broadcast(ids), "card_id", "left_semi")
    return backtest_all(few, strategies).select(
        "card_id", "strategy", "strategy_return_pct", "win_rate", "total_trades", "max_drawdown_pct", "sharpe_ratio"
    )


def buy_hold_picks(bars: DataFrame, ids: DataFrame | None = None, min_rows: int = 35, platform: str = "tcgplayer") -> DataFrame:
    """Raw and fee-aware buy-and-hold per card with the running-peak drawdown over all its bars."""
    rows = bars.filter(F.col("market_price").isNotNull())
    if ids is not None:
        rows = rows.join(ids, "card_id", "left_semi")
    order = F.struct("date", "seq", "variant", "condition")
    w = Window.partitionBy("card_id").orderBy("date", "seq", "variant", "condition").rowsBetween(Window.unboundedPreceding, 0)
    peaked = rows.withColumn("peak", F.max("market_price").over(w)).withColumn("o", order)
    agg = peaked.groupBy("card_id").agg(
        F.count("*").alias("n_rows"), F.min_by("market_price", "o").alias("first"), F.max_by("market_price", "o").alias("last"),
        F.max((F.col("peak") - F.col("market_price")) / F.col("peak") * 100).alias("dd"),
    ).filter(F.col("n_rows") >= min_rows)
    trip = E.roundtrip_pnl(F.col("first"), F.col("last"), platform)
    return agg.select(
        "card_id", "n_rows", rnd(pct_change(F.col("last"), F.col("first"))).alias("buy_hold_return_pct"), trip["net_return_pct"].alias("fee_adjusted_return_pct"),
        trip["total_fees"].alias("total_fees"), rnd(F.col("dd")).alias("max_drawdown_pct"), (trip["net_return_pct"] > 0).alias("profitable_after_fees"),
    )


def rebase_equity(rows: DataFrame, cap: float = 500.0) -> DataFrame:
    """Strategy value and price as % from the first point, clamped."""
    w = Window.partitionBy("card_id", "strategy").orderBy("i")
    mine = pct_change(F.col("value"), F.first("value").over(w))
    hold = pct_change(F.col("price"), F.first("price").over(w))
    return rows.select(
        "card_id", "strategy", "i", "date", rnd(clamp(mine, -100.0, cap), 4).alias("strategy_pct"), rnd(clamp(hold, -100.0, cap), 4).alias("hold_pct")
    )


def equity_metrics(curve: DataFrame, sells: DataFrame, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Return, risk and trade statistics of each equity curve (key ``card_id``).

    ``curve`` has one row per date; ``sells`` has pnl and hold_days per closed trade.
    """
    w = Window.partitionBy("card_id").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("prev", F.lag("value").over(w)).withColumn("peak", F.max("value").over(upto))
    rows = rows.withColumn("ret", F.when(F.col("prev") > 0, (F.col("value") - F.col("prev")) / F.col("prev")))
    ret = F.col("ret")
    down = F.when(ret < 0, ret * ret)
    stats = rows.groupBy("card_id").agg(
        F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.max((F.col("peak") - F.col("value")) / F.col("peak") * 100).alias("dd"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"),
        F.count(ret).alias("k"), F.sqrt(F.avg(down)).alias("ds"),
    )
    pnl = F.col("pnl")
    won, lost = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)))
    trades = sells.groupBy("card_id").agg(
        F.count("*").alias("closed"), rnd(F.count_if(pnl > 0) / F.count("*") * 100, 1).alias("win_rate"),
        F.when(lost > 0, rnd(won / lost, 3)).when(won == 0, 0.0).alias("profit_factor"), rnd(F.avg("hold_days"), 1).alias("avg_hold_days"),
        rnd(F.max(pnl)).alias("best_trade"), rnd(F.min(pnl)).alias("worst_trade"),
    )
    root = float(periods_per_year) ** 0.5
    grown = F.col("v1") / F.col("v0")
    return stats.join(trades, "card_id", "left").select(
        "card_id", rnd((grown - 1) * 100).alias("total_return_pct"),
        F.when((F.col("days") > 0) & (grown > 0), rnd((F.pow(grown, F.lit(float(YEAR)) / F.col("days")) - 1) * 100)).otherwise(0.0).alias("annualized_return_pct"),
        rnd(F.col("dd")).alias("max_drawdown_pct"),
        F.when((F.col("k") > 1) & (F.col("s") > 0), rnd(F.col("m") / F.col("s") * root, 3)).otherwise(0.0).alias("sharpe_ratio"),
        F.when((F.col("k") > 1) & (F.col("ds") > 0), rnd(F.col("m") / F.col("ds") * root, 3)).otherwise(0.0).alias("sortino_ratio"),
        "closed", "win_rate", "profit_factor", "avg_hold_days", "best_trade", "worst_trade",
    )


def equity_by_strategy(sells: DataFrame) -> DataFrame:
    """Closed trades of each strategy: how many, how many won, their rate, total and mean profit. Break-even is not won."""
    pnl = F.col("pnl")
    return sells.groupBy("strategy").agg(
        F.count("*").alias("count"), F.count_if(pnl > 0).alias("wins"), rnd(F.count_if(pnl > 0) / F.count("*") * 100, 1).alias("win_rate"),
        rnd(F.sum(pnl)).alias("total_pnl"), rnd(F.avg(pnl)).alias("avg_pnl"),
    )


def monthly_returns(curve: DataFrame, trades: DataFrame) -> DataFrame:
    """First to last value of each month with the trades made in it."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    per = curve.groupBy("card_id", month).agg(F.min_by("value", "date").alias("a"), F.max_by("value", "date").alias("b"))
    made = trades.groupBy("card_id", month).agg(F.count("*").alias("n_trades"))
    return per.join(made, ["card_id", "month"], "left").select(
        "card_id", "month", rnd(pct_change(F.col("b"), F.col("a"))).alias("return_pct"), F.coalesce("n_trades", F.lit(0)).alias("n_trades")
    )
