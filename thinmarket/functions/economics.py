"""Fees, liquidity, holding economics and slippage as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from thinmarket.functions.numeric import clamp, rnd, safe_div


@dataclass(frozen=True)
class Fees:
    name: str
    commission: float
    processing: float
    flat: float
    shipping: float
    buyer_shipping: float

    @property
    def rate(self) -> float:
        return self.commission + self.processing


# Fee schedules by platform.
PLATFORMS = {
    "tcgplayer": Fees("tcgplayer", commission=0.1075, processing=0.025, flat=0.30, shipping=4.50, buyer_shipping=0.0),
    "ebay": Fees("ebay", commission=0.13, processing=0.029, flat=0.30, shipping=4.50, buyer_shipping=0.0),
}
# The flat seller rate of the ledger and the mark-up of the screener.
LEDGER_FEE_RATE = 0.1255
SCREENER_COST_FACTOR = 1.1255
MIN_VIABLE_PRICE = 20.0


def platform_fees(platform: str) -> Fees:
    return PLATFORMS.get(platform, PLATFORMS["tcgplayer"])


def sell_proceeds(price: Column, platform: str = "tcgplayer") -> dict[str, Column]:
    f = platform_fees(platform)
    commission = price * f.commission
    processing = price * f.processing + f.flat
    total = commission + processing + f.shipping
    return {
        "commission": rnd(commission),
        "processing": rnd(processing),
        "shipping": F.lit(f.shipping),
        "net_proceeds": rnd(price - total),
        "total_fees": rnd(total),
        "total_fee_pct": rnd(F.when(price > 0, total / price * 100).otherwise(100.0), 1),
    }


def acquisition_cost(price: Column, platform: str = "tcgplayer") -> Column:
    return rnd(price + platform_fees(platform).buyer_shipping)


def roundtrip_pnl(buy: Column, sell: Column, platform: str = "tcgplayer") -> dict[str, Column]:
    cost = acquisition_cost(buy, platform)
    sold = sell_proceeds(sell, platform)
    net = sold["net_proceeds"] - cost
    return {
        "acquisition_cost": cost,
        "gross_pnl": rnd(sell - buy),
        "net_pnl": rnd(net),
        "total_fees": sold["total_fees"],
        "net_return_pct": rnd(F.when(cost > 0, net / cost * 100).otherwise(0.0), 1),
    }


def breakeven(buy: Column, platform: str = "tcgplayer") -> Column:
    """Appreciation in percent that pays all fees; 999 where no price does."""
    f = platform_fees(platform)
    keep = 1 - f.rate
    if keep <= 0:
        return F.lit(999.0)
    needed = (buy + f.buyer_shipping + f.flat + f.shipping) / keep
    return F.when(buy > 0, rnd((needed - buy) / buy * 100, 1)).otherwise(999.0)


def viable_trade(price: Column) -> Column:
    return price >= MIN_VIABLE_PRICE


def time_to_sell(price: Column, sales_90d: Column, sales_30d: Column) -> dict[str, Column]:
    base = F.when(price < 5, 1.0).when(price < 20, 3.0).when(price < 100, 7.0).when(price < 500, 21.0).otherwise(45.0)
    tier = F.when(price < 5, "bulk").when(price < 20, "low").when(price < 100, "mid").when(price < 500, "high").otherwise("premium")
    days = F.when(sales_90d > 0, base * 0.3 + F.lit(90.0) / sales_90d * 0.7).otherwise(base * 3)
    both = (sales_30d > 0) & (sales_90d > 0)
    # Counts times whole numbers: a pace of exactly 1.5 or 0.5 is on the limit, not beyond it.
    pace = safe_div(sales_30d * 3.0, sales_90d)
    days = days * F.when(both & (pace > 1.5), 0.6).when(both & (pace < 0.5), 1.5).otherwise(1.0)
    confidence = (
        F.when(sales_90d >= 10, "high").when(sales_90d >= 3, "medium").when(sales_90d > 0, "low").otherwise("none")
    )
    return {
        "estimated_days": F.round(F.greatest(F.lit(1.0), days)).cast("long"),
        "confidence": confidence,
        "price_tier": tier,
    }


def liquidity_score(sales_90d: Column, sales_30d: Column, price: Column, spread_pct: Column) -> Column:
    """0 to 100: volume 40, velocity 30, spread 20, price band 10."""
    volume = (
        F.when(sales_90d >= 50, 40).when(sales_90d >= 20, 30).when(sales_90d >= 10, 25)
        .when(sales_90d >= 5, 15).when(sales_90d >= 1, 5).otherwise(0)
    )
    pace = safe_div(sales_30d * 3.0, sales_90d)
    velocity = (
        F.when((sales_90d > 0) & (sales_30d > 0), F.when(pace >= 1.5, 30).when(pace >= 1.0, 20).when(pace >= 0.5, 10).otherwise(0))
        .when(sales_30d > 0, 15).otherwise(0)
    )
    gap = F.abs(spread_pct)
    spread = F.when(gap < 5, 20).when(gap < 10, 15).when(gap < 20, 10).when(gap < 30, 5).otherwise(0)
    band = (
        F.when(price.between(20, 100), 10)
        .when(price.between(10, 250), 7)
        .when(price.between(5, 500), 4)
        .when(price > 500, 2).otherwise(0)
    )
    return clamp(volume + velocity + spread + band, 0, 100).cast("int")


def hold_period(days: Column) -> Column:
    return F.when(days < 30, "short").when(days <= 180, "medium").otherwise("long")


def hold_economics(buy: Column, now: Column, days: Column, platform: str = "tcgplayer") -> dict[str, Column]:
    trip = roundtrip_pnl(buy, now, platform)
    usable = (days > 0) & (buy > 0)

    def annualised(r: Column) -> Column:
        grown = F.when(r > -1, (F.pow(1 + r, F.lit(365.0) / days) - 1) * 100).otherwise(-100.0)
        return rnd(F.when(usable, grown).otherwise(0.0), 1)

    gain = F.when(buy > 0, (now - buy) / buy * 100).otherwise(0.0)
    hurdle = breakeven(buy, platform)
    return {
        "hold_period": hold_period(days),
        "gross_appreciation_pct": rnd(gain, 1),
        "net_return_pct": trip["net_return_pct"],
        "annualized_gross_pct": annualised(safe_div(now - buy, buy)),
        "annualized_net_pct": annualised(safe_div(trip["net_pnl"], buy)),
        "breakeven_pct": hurdle,
        "clears_hurdle": gain > hurdle,
    }


def slippage_pct(price: Column, sales_per_day: Column) -> Column:
    """Expected slippage in percent: 8 for dead markets down to 0.5 for busy ones."""
    v = sales_per_day
    curve = (
        F.when(v >= 3.0, 0.5)
        .when(v >= 1.0, 1.5 - (v - 1.0) / 2.0 * 1.0)
        .when(v >= 0.3, 3.0 - (v - 0.3) / 0.7 * 1.5)
        .when(v >= 0.1, 5.0 - (v - 0.1) / 0.2 * 2.0)
        .otherwise(8.0 - v / 0.1 * 3.0)
    )
    return F.when(price <= 0, 8.0).otherwise(curve)


def appreciation_score(r2: Column, slope_pct: Column, win_rate: Column) -> Column:
    consistency = F.when(r2 >= 0.5, r2 * 40).when(r2 >= 0.3, (r2 - 0.3) / 0.2 * 20).otherwise(0.0)
    trend = F.when(slope_pct > 0, F.least(F.lit(35.0), slope_pct * 175)).otherwise(0.0)
    wins = F.when(win_rate >= 55, F.least(F.lit(25.0), (win_rate - 50) * 2.5)).when(win_rate >= 45, 5.0).otherwise(0.0)
    return rnd(clamp(consistency + trend + wins, 0.0, 100.0), 1)


def price_tier(price: Column) -> Column:
    return F.when(price >= 100, "premium").when(price >= 50, "mid_high").when(price >= 20, "mid").otherwise("budget")


def flip_metrics(price: Column, median: Column, fee: float = LEDGER_FEE_RATE) -> dict[str, Column]:
    profit = median - price * (1 + fee)
    return {"flip_profit": profit, "flip_roi": F.when(price > 0, profit / price * 100)}


def flip_badge(score: Column, adj_slope: Column) -> Column:
    return (
        F.when((score >= 70) & (adj_slope > 0), "Good Value")
        .when((score < 30) | (adj_slope < -0.1), "Overpriced").otherwise("Fair")
    )


def price_zone(price: Column, median: Column) -> Column:
    spread = F.when(median > 0, (price - median) / median * 100)
    return (
        F.when(median * (1 - LEDGER_FEE_RATE) > price, "BUY ZONE").when(spread > 50, "OVERPRICED")
        .when(spread > 20, "FAIR VALUE").otherwise("TIGHT SPREAD")
    )
