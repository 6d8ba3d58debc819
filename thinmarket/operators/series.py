"""Price series: building bars, choosing and cleaning a card's series, as-of lookups.

Two sizes matter. Sales are unbounded per card, so every operator reduces them by (card, day) or
by (card, price) with partial aggregation before it groups by card. Bars are bounded per card by
the calendar (days x variants x conditions), so windows and arrays per card are safe on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thinmarket.functions.folds import let
from thinmarket.functions.numeric import pct_change, rnd

NEAR_MINT = "Near Mint"

# Names under which a variant also appears.
VARIANT_ALIASES = {
    "holo": ("holo", "holofoil"),
    "holofoil": ("holo", "holofoil"),
    "reverse": ("reverse", "reverseHolofoil"),
    "reverseHolofoil": ("reverse", "reverseHolofoil"),
    "normal": (
        "normal", "holofoil", "holo", "1stEditionHolofoil", "1stEditionNormal", "unlimitedHolofoil", "unlimited",
    ),
}
SALE_VARIANT_ALIASES = {
    "1st Edition Holofoil": "holofoil",
    "Reverse Holofoil": "reverseHolofoil",
    "Holofoil": "holofoil",
    "Normal": "normal",
}


def bars_from_sales(sales: DataFrame) -> DataFrame:
    """Daily bars per (card, date, variant, condition)."""
    price = F.col("purchase_price")
    return sales.groupBy("card_id", F.to_date("order_date").alias("date"), "variant", "condition").agg(
        F.avg(price).alias("market_price"),
        F.min(price).alias("low_price"),
        ((F.min(price) + F.max(price)) / 2).alias("mid_price"),
        F.max(price).alias("high_price"),
        F.min("seq").alias("seq"),
    )


def last_day_prices(sales: DataFrame, as_of: Column, key: str, days: int = 7) -> DataFrame:
    """Mean price of each key's last day and of its last day up to ``days`` before ``as_of``, as (key, date, price).

    Of all daily means these are what a current price and its change need. Hardly two sales share a key and
    a day, so daily means of all days reduce nothing; ranks do, and the engine cuts them before the exchange
    too: a task sorts its rows and hands on the last days among them. The sales of a key's last day meet in one task.
    """
    date = F.to_date("order_date")
    rows = sales.select(key, date.alias("date"), "purchase_price", (date <= F.date_sub(as_of, days)).alias("early"))
    newest = Window.partitionBy(key, "early").orderBy(F.desc("date"))
    last = rows.withColumn("rank", F.rank().over(newest)).filter("rank = 1")
    return last.groupBy(key, "early").agg(F.max("date").alias("date"), F.avg("purchase_price").alias("price")).drop("early")


def is_near_mint(col: str = "condition") -> Column:
    return F.col(col).isNull() | (F.col(col) == NEAR_MINT)


def dedup_by_date(bars: DataFrame) -> DataFrame:
    """One bar per (card, date): the last record wins.

    Bars meet by card, are sorted once and each looks at the next one: nothing is summed up before the
    exchange, where almost no two bars share a day, and what goes on by card needs no other exchange.
    """
    w = Window.partitionBy("card_id").orderBy("date", "seq", "variant", "condition")
    is_last = F.lead(F.lit(False), 1, True).over(w) | ~F.lead("date").over(w).eqNullSafe(F.col("date"))
    return (
        bars.filter(F.col("market_price").isNotNull())
        .withColumn("is_last", is_last)
        .filter("is_last")
        .select(
            "card_id", "date",
            F.col("market_price").alias("price"), F.col("low_price").alias("low"),
            F.col("high_price").alias("high"), F.col("mid_price").alias("mid"),
        )
    )


def numbered(series: DataFrame) -> DataFrame:
    """Adds the 1-based position ``i`` and the length ``n``."""
    w = Window.partitionBy("card_id").orderBy("date")
    return series.withColumn("i", F.row_number().over(w)).withColumn(
        "n", F.count("*").over(Window.partitionBy("card_id"))
    )


def series_arrays(series: DataFrame) -> DataFrame:
    """One row per card with its bars ascending by date. Bounded by the calendar, see above."""
    bar = F.struct("date", "price", "low", "high", "mid")
    return series.groupBy("card_id").agg(F.sort_array(F.collect_list(bar)).alias("bars"))


def select_series(bars: DataFrame, cards: DataFrame, condition: str = NEAR_MINT) -> DataFrame:
    """Per card the narrowest non-empty choice: variant and condition, variant, anything."""
    w = Window.partitionBy("card_id")
    joined = bars.filter(F.col("market_price").isNotNull()).join(
        cards.select("card_id", "price_variant"), "card_id"
    )
    variant_ok = F.col("price_variant").isNull() | (F.col("variant") == F.col("price_variant"))
    condition_ok = F.col("condition").isNull() | (F.col("condition") == condition)
    tier = F.when(variant_ok & condition_ok, 1).when(variant_ok, 2).otherwise(3)
    return (
        joined.withColumn("row_tier", tier)
        .withColumn("tier", F.min("row_tier").over(w))
        .filter(F.col("row_tier") <= F.col("tier"))
        .drop("row_tier", "price_variant")
    )


def select_series_alias(bars: DataFrame, cards: DataFrame, condition: str = NEAR_MINT) -> DataFrame:
    """As ``select_series`` with alias sets for the variant, then the last bar per date.

    Also gives the conditions that exist for the card.
    """
    alias_map = F.create_map(
        *[x for k, v in VARIANT_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    w = Window.partitionBy("card_id")
    wanted = F.coalesce(F.try_element_at(alias_map, F.col("price_variant")), F.array("price_variant"))
    variant_ok = F.col("price_variant").isNull() | F.array_contains(wanted, F.col("variant"))
    condition_ok = F.col("condition").isNull() | (F.col("condition") == condition)
    tier = F.when(variant_ok & condition_ok, 1).when(variant_ok, 2).otherwise(3)
    chosen = (
        bars.filter(F.col("market_price").isNotNull())
        .join(cards.select("card_id", "price_variant"), "card_id")
        .withColumn("row_tier", tier)
        .withColumn("tier", F.min("row_tier").over(w))
        .withColumn("conditions", F.sort_array(F.collect_set("condition").over(w)))
        .filter(F.col("row_tier") <= F.col("tier"))
    )
    # Mixed variants only remain where the card names none or its own is missing.
    single = dominant_variant(chosen, F.col("price_variant").isNull() | (F.col("tier") == 3))
    return single.groupBy("card_id", "date").agg(
        F.max_by("market_price", F.struct("seq", "variant", "condition")).alias("price"),
        F.max("tier").alias("tier"),
        F.first("conditions").alias("conditions"),
    )


def dominant_variant(bars: DataFrame, applies: Column | None = None) -> DataFrame:
    """Keeps the commonest variant of each card, or everything where it holds under 30%.

    Rows for which ``applies`` is false are kept as they are.
    """
    skip = F.lit(False) if applies is None else ~applies
    card = Window.partitionBy("card_id")
    per_variant = Window.partitionBy("card_id", "v")
    place = F.struct("date", "seq", "variant", "condition")
    return (
        bars.withColumn("v", F.coalesce("variant", F.lit("")))
        .withColumn("v_rows", F.count("*").over(per_variant))
        .withColumn("v_first", F.min(place).over(per_variant))
        .withColumn("total", F.count("*").over(card))
        .withColumn("top", F.min(F.struct((-F.col("v_rows")).alias("neg"), "v_first", "v")).over(card))
        .filter(skip | (F.col("v") == F.col("top.v")) | (-F.col("top.neg") < F.col("total") * 0.3))
        .drop("v", "v_rows", "v_first", "total", "top")
    )


def upper_median(prices: Column) -> Column:
    """Element n//2 of the sorted array; null when empty."""
    return F.get(F.sort_array(prices), (F.size(prices) / 2).cast("int"))


def drop_spikes(bars: Column) -> Column:
    """Drops bars outside [0.05, 10] times the upper median when at least three remain."""

    def within(median: Column) -> Column:
        return F.filter(bars, lambda b: (b["price"] <= median * 10) & (b["price"] >= median * 0.05))

    kept = let(upper_median(F.transform(bars, lambda b: b["price"])), within)
    return let(kept, lambda k: F.when((F.size(bars) >= 5) & (F.size(k) >= 3), k).otherwise(bars))


def spike_filter(series: DataFrame) -> DataFrame:
    kept = series_arrays(series).withColumn("bars", drop_spikes(F.col("bars")))
    return kept.select("card_id", F.inline("bars"))


def latest_price(bars: DataFrame, cards: DataFrame) -> DataFrame:
    """Newest Near Mint price of the card's variant, of any variant where the card names none."""
    return (
        bars.filter(is_near_mint() & F.col("market_price").isNotNull())
        .join(cards.select("card_id", "price_variant"), "card_id")
        .filter(F.col("price_variant").isNull() | (F.col("variant") == F.col("price_variant")))
        .groupBy("card_id")
        .agg(rnd(F.max_by("market_price", F.struct("date", "seq", "variant")), 2).alias("current_price"))
    )


def _bracket(targets: DataFrame, series: DataFrame, by: list[str], day: str) -> DataFrame:
    """For every distinct (key, day): the nearest observation at or before it and at or after it.

    Works on distinct days, so a key asked for a billion times costs one row per day. The single
    window per key is bounded by the calendar.
    """
    asked = targets.select(*by, F.col(day).alias("date")).distinct().withColumn("price", F.lit(None).cast("double"))
    both = series.select(*by, "date", "price", F.lit(0).alias("asked")).unionByName(
        asked.withColumn("asked", F.lit(1))
    )
    seen = F.when(F.col("asked") == 0, F.struct("date", "price"))
    before = Window.partitionBy(*by).orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc("date"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("prior", F.last(seen, ignorenulls=True).over(before))
        .withColumn("next", F.last(seen, ignorenulls=True).over(after))
        .filter("asked = 1")
        .select(*by, F.col("date").alias(day), "prior", "next")
    )


def daily_prices(series: DataFrame, by: list[str], carried: bool = False) -> DataFrame:
    """One row per key: ``first``, the day of its first bar, and ``prices``, one entry a day up to the last bar.

    Days without a bar are null or, with ``carried``, repeat the bar before; a bar without a price is NaN. A row
    is bounded by the calendar, and a day is found by its number, so that what asks for prices meets its key
    once and is neither sorted by day nor exploded.
    """
    bars = F.sort_array(F.collect_list(F.struct("date", "price")))
    held = series.filter(F.col("date").isNotNull()).groupBy(*by).agg(bars.alias("bars"))

    def days(bar: Column, i: Column) -> Column:
        n = F.coalesce(F.datediff(F.get("bars", i + 1)["date"], bar["date"]), F.lit(1))
        price = F.coalesce(bar["price"].cast("double"), F.lit(float("nan")))
        if carried:
            return F.array_repeat(price, n)
        return F.concat(F.array_repeat(price, F.least(n, F.lit(1))), F.array_repeat(F.lit(None).cast("double"), n - 1))

    return held.select(*by, F.get("bars", F.lit(0))["date"].alias("first"), F.flatten(F.transform("bars", days)).alias("prices"))


def price_near(day: Column, tolerance: int) -> Column:
    """Price of the closest day within so many days in a row of ``daily_prices``; the earlier day wins ties."""
    k = F.datediff(day, "first")
    steps = sorted(range(-tolerance, tolerance + 1), key=lambda j: (abs(j), j))
    return F.nanvl(F.coalesce(*[F.get("prices", k + j) for j in steps]), F.lit(None).cast("double"))


def price_carried(day: Column) -> Column:
    """Price at or before a day in a row of carried ``daily_prices``."""
    k, last = F.datediff(day, "first"), F.size("prices") - 1
    return F.nanvl(F.get("prices", F.when(k > last, last).otherwise(k)), F.lit(None).cast("double"))


def asof_price(targets: DataFrame, series: DataFrame, by: list[str], day: str, *carry: str) -> DataFrame:
    """Latest price dated at or before ``day``."""
    hits = _bracket(targets, series, by, day)
    return targets.join(hits, [*by, day], "left").select(
        *by, day, *carry, F.col("prior.price").alias("asof_price"), F.col("prior.date").alias("asof_date")
    )


def nearest_price(
    targets: DataFrame, series: DataFrame, by: list[str], day: str, tolerance: Column | int, *carry: str
) -> DataFrame:
    """Price of the closest date within ``tolerance`` days; the earlier date wins ties."""
    tol = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    back = F.datediff(F.col(day), F.col("prior.date"))
    ahead = F.datediff(F.col("next.date"), F.col(day))
    pick = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("prior")).otherwise(F.col("next"))
    hits = _bracket(targets, series, by, day)
    joined = targets.join(hits, [*by, day], "left").withColumn("pick", pick)
    ok = F.abs(F.datediff(F.col(day), F.col("pick.date"))) <= tol
    return joined.select(
        *by, day, *carry,
        F.when(ok, F.col("pick.price")).alias("near_price"), F.when(ok, F.col("pick.date")).alias("near_date"),
    )


def weekly_bars_from_sales(
    sales: DataFrame, cards: DataFrame, bars: DataFrame, key: str = "card_id", min_days: int = 30
) -> DataFrame:
    """Weekly bars for thinly covered cards that have at least two sales.

    Most weeks of a card have a sale or two, so all are counted with their lowest and highest price first.
    The median of two lies between these; only weeks with more prices are looked at again, and their true
    median comes from counted values, so a hot week never gathers in one task.
    """
    from thinmarket.operators.sales import grouped_medians

    canonical = F.create_map(*[x for k, v in SALE_VARIANT_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    # Days are bounded by the calendar, so a card's set of them is; a bar without a day counts as one more.
    n_days = F.size(F.collect_set("date")) + F.max(F.col("date").isNull().cast("int"))
    thin = bars.groupBy(key).agg(n_days.alias("n_days")).filter(F.col("n_days") >= min_days).select(key)
    busy = sales.groupBy(key).count().filter("count >= 2").select(key)
    wanted = (
        cards.select(key, F.coalesce("price_variant", F.lit("normal")).alias("want"))
        .join(busy, key, "left_semi")
        .join(thin, key, "left_anti")
    )
    hits = (
        sales.join(wanted, key)
        .filter(F.coalesce(F.try_element_at(canonical, F.col("variant")), F.col("variant")) == F.col("want"))
        .filter("purchase_price > 0")
        .select(
            key, F.to_date(F.date_trunc("week", "order_date")).alias("date"),
            F.coalesce("condition", F.lit(NEAR_MINT)).alias("condition"), F.col("want").alias("variant"),
            "purchase_price",
        )
    )
    keys = [key, "date", "condition", "variant"]
    price = F.col("purchase_price")
    weeks = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.min(price).alias("low"), F.max(price).alias("high"))
    crowded = weeks.filter("n > 2 AND low < high").select(*keys)
    more = hits.alias("l").join(crowded.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left_semi")
    middle = grouped_medians(more, keys, "purchase_price", {"w": F.lit(True)})
    weekly = (
        weeks.filter("n >= 2").alias("l")
        .join(middle.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
        .select("l.*", F.coalesce("r.w_median", (F.col("l.low") + F.col("l.high")) / 2).alias("median"))
    )
    # Weeks are named by their Monday, so bars of other days are in nothing's way.
    have = bars.filter(F.weekday("date") == 0).select(key, "date", F.coalesce("condition", F.lit(NEAR_MINT)).alias("condition"), "variant")
    return (
        weekly.join(have, keys, "left_anti")
        .select(
            *keys, rnd(F.col("median")).alias("market_price"), rnd(F.col("low")).alias("low_price"),
            rnd(F.col("median")).alias("mid_price"), rnd(F.col("high")).alias("high_price"),
            F.col("n").alias("n_sales"),
        )
    )


def fill_current_prices(cards: DataFrame, bars: DataFrame, key: str = "card_id") -> DataFrame:
    """Cards whose price is null or zero get their newest Near Mint price, of whatever variant; all others stay.

    A bar without a condition counts as Near Mint. Of several on the newest day that of the last variant counts.
    """
    newest = (
        bars.filter((is_near_mint() | F.col("condition").isNull()) & F.col("market_price").isNotNull())
        .groupBy(key).agg(F.max_by("market_price", F.struct("date", "variant", "market_price")).alias("newest"))
    )
    price = F.coalesce(F.nullif(F.col("current_price"), F.lit(0.0)), "newest", "current_price")
    return cards.join(newest, key, "left").withColumn("current_price", price).drop("newest")


def variant_switch_trim(series: DataFrame) -> DataFrame:
    """Where the last price is off the older median fivefold, keeps the rows from the first jump on."""
    packed = series_arrays(series).withColumn("prices", F.transform("bars", lambda b: b["price"]))
    prices = F.col("prices")
    older = F.slice(prices, 1, F.greatest(F.size(prices) - 3, F.lit(0)))
    ratio = F.element_at(prices, -1) / upper_median(older)
    steps = F.transform(prices, lambda x, k: F.when(k > 0, x / F.get(prices, k - 1)))
    jumps = F.filter(
        F.transform(steps, lambda r, k: F.when((r > 5) | (r < 0.2), k + 1)), lambda k: k.isNotNull()
    )
    switched = (F.size(prices) >= 3) & (F.size(older) > 0) & ((ratio > 5) | (ratio < 0.2)) & (F.size(jumps) > 0)
    start = F.when(switched, F.get(jumps, 0)).otherwise(1)
    return packed.select("card_id", F.inline(F.slice("bars", start, F.size("bars"))))


def forward_fill_calendar(
    holdings: DataFrame, series: DataFrame, as_of: Column, days: int = 180
) -> DataFrame:
    """Daily portfolio value: each held card carried forward over the calendar, then summed.

    A card's grid starts from its last price at or before the start, else its first price, else
    its current price. Days before the first positive value are dropped.
    """
    start = F.date_sub(as_of, days - 1)
    held = holdings.groupBy("card_id").agg(
        F.sum(F.col("quantity") * F.col("multiplier")).alias("weight"), F.first("current_price").alias("current_price")
    )
    seed = series.groupBy("card_id").agg(
        F.max_by(F.when(F.col("date") <= start, F.col("price")), F.when(F.col("date") <= start, F.col("date"))).alias("opening"),
        F.min_by("price", "date").alias("first_price"),
    )
    grid = held.join(seed, "card_id", "left").withColumn("date", F.explode(F.sequence(start, as_of)))
    w = Window.partitionBy("card_id").orderBy("date")
    daily = (
        grid.join(series.select("card_id", "date", "price"), ["card_id", "date"], "left")
        .withColumn("carried", F.last("price", ignorenulls=True).over(w))
        .withColumn("value", F.col("weight") * F.coalesce("carried", "opening", "first_price", "current_price"))
        .groupBy("date").agg(F.sum("value").alias("value"))
    )
    first_day = daily.filter("value > 0").agg(F.min("date")).scalar()
    return daily.filter(F.col("date") >= first_day)


def daily_median_sma(daily: DataFrame, days: int) -> DataFrame:
    """Mean of the daily upper medians over the last ``days`` days; null under two points."""
    secs = F.unix_date("date")
    w = Window.partitionBy("card_id").orderBy(secs).rangeBetween(-(days - 1), 0)
    return daily.withColumn(
        f"sma_{days}", F.when(F.count("daily_median").over(w) >= 2, F.avg("daily_median").over(w))
    )


def series_overlay(series: DataFrame) -> DataFrame:
    """Chart overlays: SMA30, a long SMA sized by the series, population Bollinger bands."""
    rows = numbered(series)
    w = Window.partitionBy("card_id").orderBy("date")
    last20, last30 = w.rowsBetween(-19, 0), w.rowsBetween(-29, 0)
    long_k = F.least(F.lit(90), F.greatest(F.lit(60), F.floor(F.col("n") * 0.6).cast("int")))
    running = F.sum("price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("running", running).withColumn("long_k", long_k)
    # A window of per-card width: the difference of two running sums, looked up by position.
    sums = F.collect_list("running").over(w.rowsBetween(-90, 0))
    rows = rows.withColumn("sums", sums)
    left = F.when(F.col("i") == F.col("long_k"), F.lit(0.0)).otherwise(
        F.get(F.col("sums"), F.size("sums") - 1 - F.col("long_k"))
    )
    mid, dev = F.avg("price").over(last20), F.stddev_pop("price").over(last20)
    full = F.col("i") >= 20
    return rows.select(
        "card_id", "date", "price",
        F.when(F.col("i") >= 30, F.avg("price").over(last30)).alias("sma_30"),
        F.when(F.col("i") >= F.col("long_k"), (F.col("running") - left) / F.col("long_k")).alias("sma_long"),
        F.when(full, mid + 2 * dev).alias("bb_upper"),
        F.when(full, mid).alias("bb_middle"),
        F.when(full, F.greatest(F.lit(0.0), mid - 2 * dev)).alias("bb_lower"),
    )


def rebase_compare(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """Both series of each (card_a, card_b) as % from the first day on which both have a price."""
    a = pairs.join(series.select(F.col("card_id").alias("card_a"), "date", F.col("price").alias("price_a")), "card_a")
    b = pairs.join(series.select(F.col("card_id").alias("card_b"), "date", F.col("price").alias("price_b")), "card_b")
    both = a.join(b, ["card_a", "card_b", "date"], "full")
    w = Window.partitionBy("card_a", "card_b")
    common = F.when(F.col("price_a").isNotNull() & F.col("price_b").isNotNull(), F.struct("date", "price_a", "price_b"))
    base = F.min(common).over(w)
    return both.withColumn("base", base).select(
        "card_a", "card_b", "date",
        pct_change(F.col("price_a"), F.col("base.price_a")).alias("change_a"),
        pct_change(F.col("price_b"), F.col("base.price_b")).alias("change_b"),
    )


def _thinned(series: DataFrame, as_of: Column, days: int, points: int) -> DataFrame:
    """The last days' rows, each with whether it is one of the evenly spaced points of a sparkline."""
    w = Window.partitionBy("card_id").orderBy("date")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("card_id")) / points))
    return series.filter(F.col("date") >= F.date_sub(as_of, days)).withColumn("sampled", (F.row_number().over(w) - 1) % step == 0)


def price_samples(series: DataFrame, as_of: Column, days: int = 90, points: int = 12) -> DataFrame:
    """Every max(1, n // points)-th price of each card's last ``days`` days, oldest first."""
    rows = _thinned(series, as_of, days, points).filter("sampled")
    return rows.select("card_id", "date", rnd(F.col("price"), 2).alias("price"))


def price_summary(series: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Ends, extremes and change of the last ``days`` days; ``price_samples`` has the points between."""
    rows = _thinned(series, as_of, days, 12)
    sampled = F.col("sampled")
    return rows.groupBy("card_id").agg(
        F.count("*").alias("n_points"),
        F.min_by("price", "date").alias("first_price"), F.max_by("price", "date").alias("last_price"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        pct_change(F.max_by("price", "date"), F.min_by("price", "date")).alias("change_pct"),
        F.count_if(sampled).alias("sample_points"),
        F.sum(F.when(sampled, F.col("price"))).alias("sample_sum"),
    )


def outlier_bounds(series: DataFrame) -> DataFrame:
    """Plausible price range per card: capped when the maximum towers over the median, and the
    interquartile upper fence."""
    prices = F.sort_array(F.transform("bars", lambda b: b["price"]))
    n = F.size("prices")
    rows = series_arrays(series).select("card_id", prices.alias("prices"))
    median = (F.get("prices", (n / 2).cast("int")) + F.get("prices", ((n - 1) / 2).cast("int"))) / 2
    top = F.element_at("prices", -1)
    spiky = (n >= 5) & (top > median * 5)
    q1, q3 = F.get("prices", F.floor(n * 0.25).cast("int")), F.get("prices", F.floor(n * 0.75).cast("int"))
    return rows.select(
        "card_id",
        F.when(spiky, F.get("prices", F.floor(n * 0.9).cast("int")) * 1.1).otherwise(top).alias("cap"),
        F.when(spiky, F.get("prices", 0) * 0.95).otherwise(F.get("prices", 0)).alias("floor"),
        (q3 + 2 * (q3 - q1)).alias("upper_fence"),
    )


SERIES_SCHEMA = T.StructType(
    [
        T.StructField("card_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("price", T.DoubleType()),
    ]
)
