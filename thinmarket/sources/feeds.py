"""Landed feed files to rows: JSON, CSV and HTML already on storage, parsed by Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thinmarket.functions import text as X
from thinmarket.functions.numeric import rnd
from thinmarket.operators.containment import containing

# Names of printings in the bulk feed and in the price-point feed.
SUBTYPE_TO_VARIANT = {
    "Normal": "normal",
    "Holofoil": "holofoil",
    "Reverse Holofoil": "reverseHolofoil",
    "1st Edition Holofoil": "1stEditionHolofoil",
    "1st Edition Normal": "1stEditionNormal",
    "1st Edition": "1stEditionNormal",
    "Unlimited Holofoil": "unlimitedHolofoil",
    "Unlimited Normal": "unlimited",
    "Unlimited": "unlimited",
}
VARIANT_PRIORITY = {
    "holofoil": 6,
    "1stEditionHolofoil": 5,
    "unlimitedHolofoil": 4,
    "reverseHolofoil": 3,
    "normal": 2,
    "1stEditionNormal": 1,
    "unlimited": 0,
}
PRINTING_TO_VARIANT = {
    "normal": "normal",
    "foil": "holofoil",
    "holofoil": "holofoil",
    "1st edition holofoil": "1stEditionHolofoil",
    "1st edition normal": "1stEditionNormal",
    "reverse holofoil": "reverseHolofoil",
}
# Priorities among equally long histories, and the conditions that are kept.
HISTORY_VARIANT_PRIORITY = {"holofoil": 3, "reverseHolofoil": 2, "normal": 1}
HISTORY_CONDITION_PRIORITY = {"nearmint": 2, "good": 1, "": 0}
# Header aliases of the history CSV in order of preference.
CSV_ALIASES = {
    "name": ("name", "product-name", "card_name", "Name"),
    "date": ("date", "Date", "price_date"),
    "set": ("console", "set", "Set"),
    "market": ("loose_price", "Loose Price", "market_price", "price"),
    "low": ("low_price",),
    "high": ("cib_price", "CIB Price", "high_price"),
    "graded": ("graded_price", "new_price"),
}
# Each date format with a shape that all its texts have: a failed parse costs an exception, a shape does not.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^[+-]?\d{4,}-\d+-\d+$",
    "M/d/yyyy": r"^[^/]+/[^/]+/[^/]{4,}$",
    "M/d/yy": r"^[^/]+/[^/]+/\d+$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^[+-]?\d{4,}-\d+-\d+[Tt]\d+:\d+:\d+$",
    "yyyy-MM-dd'T'HH:mm:ss'Z'": r"^[+-]?\d{4,}-\d+-\d+[Tt]\d+:\d+:\d+[Zz]$",
    "d-MMM-yyyy": r"^[+-]?\d+-\D+-[+-]?\d{4,}$",
    "MMMM d, yyyy": r"^\D+ [+-]?\d+, [+-]?\d{4,}$",
}
ISO_DATE = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}){0,2})?)?$"
)
# Words of a finance article's address.
ARTICLE_WORDS = (
    "price-spike", "biggest-price", "most-expensive", "movers-and-shakers",
    "buyer-s-guide", "price-shift", "price-drop",
)
BUTTON_LABELS = ("Buy Product", "Copy Link")

HISTORY_SCHEMA = "map<string, struct<history: map<string, struct<avg: double, min: double, max: double, count: int>>>>"
BUCKETS_SCHEMA = (
    "struct<result: array<struct<condition: string, buckets: array<struct<bucketStartDate: string, marketPrice: string,"
    " lowSalePrice: string, highSalePrice: string, quantitySold: string>>>>>"
)
DAILY_SCHEMA = (
    "struct<result: array<struct<date: string, variants: array<struct<variant: string, averageSalesPrice: string,"
    " quantity: string, marketPrice: string>>>>>"
)
FLEX_ENTRY = "struct<date: string, updatedAt: string, variant: string, market: string, price: string, market_price: string, low: string, mid: string, high: string>"


def lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per file: its path and its whole content."""
    return (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def parse_price_json(files: DataFrame) -> DataFrame:
    """Dated prices of every variant and condition of every file, cents to units."""
    path = r"(?:^|/)en/([^/]+)/([^/]+)\.tcgplayer\.json$"
    body = F.coalesce(F.get_json_object("content", "$.data"), F.col("content"))
    rows = files.filter(F.col("path").rlike(path)).select(
        F.regexp_extract("path", path, 1).alias("set_code"), F.regexp_extract("path", path, 2).alias("number"),
        F.posexplode(F.from_json(body, HISTORY_SCHEMA)).alias("pos", "key", "v"),
    )
    parts = F.split("key", "-")
    days = rows.withColumn("variant", F.get(parts, F.lit(0))).withColumn("condition", F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    days = days.filter(F.col("condition").isin("nearmint", "good", "")).select(
        F.concat_ws("-", "set_code", "number").alias("tcg_id"), "pos", "variant", "condition", F.explode("v.history").alias("day", "p")
    )
    return days.withColumn("date", F.try_to_date("day", "yyyy-MM-dd")).filter("date IS NOT NULL AND p.avg IS NOT NULL").select(
        "tcg_id", "pos", "variant", "condition", "date", (F.col("p.avg") / 100).alias("market_price"),
        (F.col("p.min") / 100).alias("low_price"), (F.col("p.max") / 100).alias("high_price"),
    )


def pick_variant_condition(records: DataFrame, key: str = "tcg_id") -> DataFrame:
    """Per card the (variant, condition) with most rows, then the first row per date.

    One exchange by card: combinations are counted and compared in windows on it, so the records are
    made once. A card's records come from one file and are bounded by the calendar.
    """
    rank = lookup(HISTORY_CONDITION_PRIORITY, F.col("condition"), F.lit(0)) * 10 + lookup(HISTORY_VARIANT_PRIORITY, F.col("variant"), F.lit(0))
    counted = records.repartition(key).withColumn("c", F.count("*").over(Window.partitionBy(key, "variant", "condition")))
    place = F.struct("c", rank.alias("r"), "variant", "condition")
    best = counted.withColumn("place", place).withColumn("best", F.max("place").over(Window.partitionBy(key)))
    chosen = best.filter("place = best AND variant IS NOT NULL AND condition IS NOT NULL")
    rest = [c for c in records.columns if c not in (key, "date", "pos")]
    return chosen.groupBy(key, "date").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(key, "date", "r.*")


def ingest_price_json(
    files: DataFrame, min_price_cents: float = 0, tracked: DataFrame | None = None, existing: DataFrame | None = None
) -> DataFrame:
    """New price history of the files: chosen, cheap cards dropped, known (date, variant) skipped."""
    picked = pick_variant_condition(parse_price_json(files))
    if tracked is not None:
        picked = picked.join(tracked.select("tcg_id"), "tcg_id", "left_semi")
    top = F.max("market_price").over(Window.partitionBy("tcg_id"))
    out = picked.withColumn("top", top).filter(F.col("top") * 100 >= min_price_cents).drop("top")
    return out if existing is None else out.join(existing.select("tcg_id", "date", "variant"), ["tcg_id", "date", "variant"], "left_anti")


def _alias(df: DataFrame, name: str) -> Column:
    there = [F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")) for c in CSV_ALIASES[name] if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def parse_price(text: Column) -> Column:
    value = F.regexp_replace(F.trim(text), "[$,]", "").try_cast("double")
    return F.when(value > 0, value)


def parse_date(text: Column) -> Column:
    """The day of a text in one of the fixed formats, else of an ISO date or time: with or without signs,
    with fractions and offset, the day as written. Null where neither fits."""
    t = F.trim(text)
    iso = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(t, ISO_DATE, i) for i in (1, 3, 4)]), "yyyy-MM-dd")
    return F.coalesce(*[F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(f)))) for f, shape in DATE_FORMATS.items()], F.when(t.rlike(ISO_DATE), iso))


def ingest_price_csv(rows: DataFrame, cards: DataFrame, existing: DataFrame) -> DataFrame:
    """History rows of a CSV with a status each: new, duplicate, unmatched or skipped.

    ``rows`` has strings and a ``line`` number. The first row per (card, date, variant) wins. Known bars
    meet the rows of their key in the one window that finds it, so the texts are parsed once. Rows that
    can't be stored are spread by their line: none of them needs its key.
    """
    name = X.normalize_name(F.col("name"))
    named = cards.select("card_id", "price_variant", name.alias("k1"), X.name_key(F.col("name"), F.col("set_name")).alias("k2"))
    by_both = named.groupBy("k2").agg(F.max_by(F.struct("card_id", "price_variant"), "card_id").alias("c2"))
    by_name = named.groupBy("k1").agg(F.min_by(F.struct("card_id", "price_variant"), "card_id").alias("c1"))
    parsed = rows.select(
        "line", X.normalize_name(_alias(rows, "name")).alias("k1"), X.name_key(_alias(rows, "name"), _alias(rows, "set")).alias("k2"),
        parse_date(_alias(rows, "date")).alias("date"), *[parse_price(_alias(rows, c)).alias(c) for c in ("market", "low", "high", "graded")],
    )
    hit = parsed.join(by_both, "k2", "left").join(by_name, "k1", "left").withColumn("c", F.coalesce("c2", "c1"))
    priced = F.coalesce("market", "high", "graded").isNotNull()
    full = hit.select(
        "line", "date", "low", F.col("c.card_id").alias("card_id"), F.coalesce("c.price_variant", F.lit("normal")).alias("variant"),
        F.coalesce("market", "high").alias("market_price"), F.col("high").alias("h"), F.coalesce("high", "graded").alias("high_price"), priced.alias("priced"),
    )
    usable = F.col("card_id").isNotNull() & F.col("date").isNotNull() & F.col("priced")
    known = existing.select("card_id", "date", "variant", F.lit(True).alias("is_known")).filter("card_id IS NOT NULL AND date IS NOT NULL AND variant IS NOT NULL")
    marked = full.withColumns({"is_known": F.lit(False), "apart": F.when(~usable, F.col("line"))}).unionByName(known, allowMissingColumns=True)
    key = Window.partitionBy("card_id", "date", "variant", "apart")
    tagged = marked.withColumns({"known": F.max("is_known").over(key), "first_line": F.min("line").over(key)}).filter("NOT is_known")
    status = (
        F.when(F.col("date").isNull(), "skipped").when(F.col("card_id").isNull(), "unmatched").when(~F.col("priced"), "skipped")
        .when(F.col("known") | (F.col("line") != F.col("first_line")), "duplicate").otherwise("new")
    )
    return tagged.select(
        "line", "card_id", "date", "variant", "market_price", F.col("low").alias("low_price"),
        F.when(F.col("h").isNotNull(), rnd((F.col("market_price") + F.col("h")) / 2)).alias("mid_price"), "high_price", status.alias("status"),
    )


def best_price_entry(entries: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """One entry per product: the card's own printing if it has a market price, else by priority.

    ``entries`` has productId, subTypeName, marketPrice, lowPrice, midPrice, highPrice, pos.
    """
    rows = entries.withColumn("variant", lookup(SUBTYPE_TO_VARIANT, F.col("subTypeName"), F.lit("normal")))
    if preferred is not None:
        names = {v: k for k, v in SUBTYPE_TO_VARIANT.items()}
        want = lookup(names, F.col("price_variant"), F.lit(""))
        rows = rows.join(preferred.select("productId", "price_variant"), "productId").withColumn(
            "own", (F.col("subTypeName") == want) & F.col("marketPrice").isNotNull()
        )
    else:
        rows = rows.withColumn("own", F.lit(False))
    rank = F.struct(
        F.coalesce("own", F.lit(False)).alias("own"),
        F.when(F.col("own"), 0).otherwise(F.when(F.col("marketPrice").isNotNull(), 1).otherwise(0)).alias("m"),
        F.when(F.col("own"), 0).otherwise(lookup(VARIANT_PRIORITY, F.col("variant"), F.lit(0))).alias("p"), (-F.col("pos")).alias("o"),
    )
    keep = F.struct("subTypeName", "variant", "marketPrice", "lowPrice", "midPrice", "highPrice")
    return rows.groupBy("productId").agg(F.max_by(keep, rank).alias("e")).select("productId", "e.*")


def price_gate(price: Column, current: Column, days_stale: Column) -> Column:
    """Whether a new price is within reach of the current one; stale prices get a wider gate."""
    ratio = price / current
    wide = F.coalesce(days_stale, F.lit(999)) > 7
    inside = ratio.between(F.when(wide, 0.1).otherwise(0.33), F.when(wide, 10.0).otherwise(3.0))
    return F.when(current > 0, inside).otherwise(True)


def bulk_price_update(cards: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Tracked, mapped cards with the price to take and what to do with it.

    Status: no_price, skipped_sanity, updated, history_only (other printing).
    """
    mapped = cards.filter("is_tracked AND product_id IS NOT NULL")
    best = best_price_entry(entries, mapped.select(F.col("product_id").alias("productId"), "price_variant"))
    price = F.when(F.col("marketPrice") > 0, F.col("marketPrice")).when(F.col("midPrice") > 0, F.col("midPrice"))
    rows = mapped.join(best.withColumnRenamed("productId", "product_id"), "product_id").withColumn("price", price)
    stale = F.datediff(as_of, F.to_date("updated_at"))
    ok = price_gate(F.col("price"), F.col("current_price"), stale)
    status = (
        F.when(F.col("price").isNull(), "no_price").when(~ok, "skipped_sanity")
        .when(F.col("price_variant").isNull() | (F.col("variant") == F.col("price_variant")), "updated").otherwise("history_only")
    )
    return rows.withColumn("status", status)


def apply_bulk_prices(cards: DataFrame, decided: DataFrame, as_of: Column) -> DataFrame:
    """The catalogue with accepted prices written over the old ones."""
    new = decided.filter("status = 'updated'").select("card_id", rnd(F.col("price")).alias("p"), F.col("variant").alias("v"))
    return cards.join(new, "card_id", "left").select(
        *[c for c in cards.columns if c not in ("current_price", "price_variant", "updated_at")],
        F.coalesce("p", "current_price").alias("current_price"), F.coalesce("v", "price_variant").alias("price_variant"),
        F.when(F.col("p").isNotNull(), as_of.cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def bulk_history_rows(decided: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    rows = decided.filter("status IN ('updated', 'history_only')").select(
        "card_id", as_of.alias("date"), "variant", F.lit("Near Mint").alias("condition"), rnd(F.col("price")).alias("market_price"),
        *[rnd(F.nullif(F.col(a), F.lit(0.0))).alias(b) for a, b in (("lowPrice", "low_price"), ("midPrice", "mid_price"), ("highPrice", "high_price"))],
    )
    keys = ["card_id", "date", "variant", "condition"]
    return rows.join(existing.select(*keys), keys, "left_anti")


def upsert_catalogue(cards: DataFrame, feed: DataFrame, as_of: Column, min_price: float = 2.0) -> DataFrame:
    """Catalogue after a feed: non-empty fields laid over, new cards added, with a status.

    ``feed`` has tcg_id, name, set_id, set_name, rarity, variant, market, image. The image only
    changes where the names agree.
    """
    new = feed.select(*[F.col(c).alias(f"n_{c}") for c in feed.columns])
    old, fresh = F.col("tcg_id").isNotNull(), F.col("n_tcg_id").isNotNull()
    status = (
        F.when(~fresh, "kept").when(F.col("n_market").isNull() | (F.col("n_market") == 0), "skipped_no_price")
        .when(F.col("n_market") < min_price, "skipped_cheap").when(old, "updated").otherwise("created")
    )
    joined = cards.join(new, F.col("tcg_id") == F.col("n_tcg_id"), "full").withColumn("status", status)
    take = F.col("status").isin("updated", "created")

    def laid(name: str, source: str, when: Column | None = None) -> Column:
        cond = take if when is None else take & when
        value = F.col(f"n_{source}")
        there = value.isNotNull() if source == "market" else (value.isNotNull() & (value.cast("string") != ""))
        return F.when(cond & there, value).otherwise(F.col(name)).alias(name)

    created = F.col("status") == "created"
    same = created | (F.lower("n_name") == F.lower("name"))
    return joined.filter(old | created).select(
        F.coalesce("tcg_id", "n_tcg_id").alias("tcg_id"), laid("name", "name"), laid("set_id", "set_id", created), laid("set_name", "set_name", created),
        laid("rarity", "rarity", created), laid("price_variant", "variant"), laid("current_price", "market"), laid("image", "image", same), "status",
    )


def feed_history_rows(upserted: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    """One Near Mint row per card touched by the feed, unless (card, date, variant) exists."""
    rows = upserted.filter("status IN ('updated', 'created')").select(
        "tcg_id", as_of.alias("date"), F.col("price_variant").alias("variant"), F.lit("Near Mint").alias("condition"), F.col("current_price").alias("market_price")
    )
    return rows.join(existing.select("tcg_id", "date", "variant"), ["tcg_id", "date", "variant"], "left_anti")


def overlay_non_empty(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key with the new table's non-empty values over the old ones."""
    renamed = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    joined = old.join(renamed, F.col(key) == F.col(f"n_{key}"), "full")
    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        v = F.col(f"n_{c}")
        return F.coalesce(F.when(v.cast("string") != "", v), F.col(c)).alias(c)

    return joined.select(*[pick(c) for c in old.columns])


def ingest_history_buckets(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Weekly buckets of the first Near Mint entry of each product (product_id, content)."""
    j = F.from_json("content", BUCKETS_SCHEMA)["result"]
    nm = F.get(F.filter(j, lambda v: F.lower(v["condition"]).contains("near mint")), F.lit(0))
    b = files.select("product_id", F.explode(nm["buckets"]).alias("b"))

    def num(c: str) -> Column:
        return F.col(f"b.{c}").try_cast("double")

    rows = b.select(
        "product_id", F.try_to_date(F.substring("b.bucketStartDate", 1, 10), "yyyy-MM-dd").alias("date"), rnd(num("marketPrice")).alias("market_price"),
        rnd(F.nullif(num("lowSalePrice"), F.lit(0.0))).alias("low_price"), rnd(F.nullif(num("highSalePrice"), F.lit(0.0))).alias("high_price"),
        F.coalesce(F.col("b.quantitySold").try_cast("int"), F.lit(0)).alias("quantity_sold"),
    ).filter("market_price > 0 AND date IS NOT NULL")
    return rows if existing is None else rows.join(existing.select("product_id", "date"), ["product_id", "date"], "left_anti")


def ingest_daily_sales(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Daily aggregates as sales at noon, one per (product, date, variant)."""
    items = files.select("product_id", F.explode(F.from_json("content", DAILY_SCHEMA)["result"]).alias("d"))
    rows = items.filter("d.date IS NOT NULL AND d.date <> ''").select("product_id", F.col("d.date").alias("date"), F.explode("d.variants").alias("v")).select(
        "product_id", "date", F.coalesce("v.variant", F.lit("Unknown")).alias("variant"),
        F.col("v.averageSalesPrice").try_cast("double").alias("purchase_price"), F.col("v.quantity").try_cast("int").alias("quantity"),
    ).filter("purchase_price > 0 AND quantity > 0")
    keyed = rows.select(
        F.concat_ws("-", F.lit("tcg-hist"), F.col("product_id").cast("string"), "date", "variant").alias("listing_id"), "product_id",
        F.try_to_timestamp(F.concat(F.substring("date", 1, 10), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("order_date"),
        "purchase_price", "quantity", "variant",
        F.concat(F.lit("Daily avg: "), F.col("quantity").cast("string"), F.lit(" sales")).alias("listing_title"), F.lit("tcgplayer_history").alias("source"),
    ).filter("order_date IS NOT NULL").dropDuplicates(["listing_id"])
    return keyed if existing is None else keyed.join(existing.select("listing_id"), "listing_id", "left_anti")


def ingest_entries_flex(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Price entries under several envelopes and field names (card_id, price_variant, content)."""
    arr = f"array<{FLEX_ENTRY}>"
    body = F.when(F.ltrim("content").startswith("["), F.col("content")).otherwise(F.coalesce(F.get_json_object("content", "$.data"), F.get_json_object("content", "$.prices")))
    e = files.select("card_id", "price_variant", F.posexplode(F.from_json(body, arr)).alias("pos", "e"))

    def num(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"e.{n}").try_cast("double"), F.lit(0.0)) for n in names])

    def positive(name: str) -> Column:
        v = F.col(f"e.{name}").try_cast("double")
        return F.when(v >= 0, v)

    day = F.coalesce(F.nullif(F.col("e.date"), F.lit("")), F.col("e.updatedAt"))
    rows = e.select(
        "card_id", F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd").alias("date"),
        F.coalesce("e.variant", "price_variant", F.lit("normal")).alias("variant"), num("market", "price", "market_price").alias("market_price"),
        positive("low").alias("low_price"), positive("mid").alias("mid_price"), positive("high").alias("high_price"), "pos",
    ).filter("date IS NOT NULL AND market_price IS NOT NULL")
    keep = F.struct("market_price", "low_price", "mid_price", "high_price")
    first = rows.groupBy("card_id", "date", "variant").agg(F.min_by(keep, "pos").alias("r")).select("card_id", "date", "variant", "r.*")
    return first if existing is None else first.join(existing.select("card_id", "date", "variant"), ["card_id", "date", "variant"], "left_anti")


def latest_of(rows: DataFrame) -> DataFrame:
    """The current price that a batch of history rows implies."""
    return rows.groupBy("card_id").agg(F.max_by("market_price", F.struct("date", "variant")).alias("current_price"))


def _sale_head() -> list[Column]:
    return [F.lit("tcg"), F.col("product_id").cast("string"), F.substring(F.coalesce("orderDate", F.lit("")), 1, 19), F.col("purchasePrice").cast("string")]


def sale_keys(raw: DataFrame) -> DataFrame:
    """Adds the sale key and the older key without the condition."""
    listing = F.coalesce("customListingId", F.lit(""))
    head = _sale_head()
    return raw.withColumn("listing_id", F.concat_ws("-", *head, F.coalesce("condition", F.lit("")), listing)).withColumn("old_key", F.concat_ws("-", *head, listing))


def sale_parts(raw: DataFrame, existing: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame]]:
    """Raw sales and stored keys in ``n`` parts, so that whatever a sale's keys may equal is in its part.

    Both keys begin with the same text up to their second dash, mostly the product's number. Judged one
    after the other, the parts need a part of the disk.
    """
    def part(text: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring_index(text, "-", 2)), F.lit(n))

    of_raw, of_key = part(F.concat_ws("-", *_sale_head(), F.lit(""))), part(F.col("listing_id"))
    return [(raw.filter(of_raw == i), existing.filter(of_key == i)) for i in range(n)]


def dedup_sales(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Every raw sale with its status: new, duplicate or error. Equal keys keep one sale.

    Sales meet all that their key decides on one exchange. Only those that it leaves open cross another one,
    by the older key: few, where a feed mostly repeats what is stored.
    """
    keyed = sale_keys(raw).withColumn("order_date", F.try_to_timestamp(F.col("orderDate")))
    known = existing.select("listing_id").distinct()
    # One representative per key without a window: the smallest position of the key.
    first = keyed.groupBy("listing_id").agg(F.min("pos").alias("first_pos"))
    met = keyed.join(first, "listing_id").join(known.withColumn("known", F.lit(True)), "listing_id", "left")
    later = F.col("order_date").isNotNull() & (F.col("pos") != F.col("first_pos"))
    decided = F.col("known").isNotNull() | F.coalesce(later, F.lit(False))
    rest = met.filter(~decided).join(known.select(F.col("listing_id").alias("old_key"), F.lit(True).alias("known_old")), "old_key", "left")
    status = F.when(F.col("known_old"), "duplicate").when(F.col("order_date").isNull(), "error").otherwise("new")
    columns = ["listing_id", "old_key", *[c for c in keyed.columns if c not in ("listing_id", "old_key")]]
    return met.filter(decided).select(*columns, F.lit("duplicate").alias("status")).unionByName(rest.select(*columns, status.alias("status")))


def price_from_sales_batch(raw: DataFrame, key: str = "card_id") -> DataFrame:
    """Upper median of each card's batch, from counted prices."""
    from thinmarket.operators.sales import grouped_medians

    out = grouped_medians(raw, [key], "purchasePrice", {"b": F.lit(True)})
    return out.select(key, rnd(F.col("b_upper")).alias("current_price"))


def product_fields(products: DataFrame) -> DataFrame:
    """Number, rarity and clean name of products; those without a number are sealed and dropped."""
    ext = F.map_from_entries(F.transform(F.col("extendedData"), lambda e: F.struct(e["name"], e["value"])))
    return products.withColumn("ext", ext).select(
        "productId", "groupId", F.col("name").alias("product_name"), X.card_number(F.try_element_at("ext", F.lit("Number"))).alias("number"),
        F.try_element_at("ext", F.lit("Rarity")).alias("rarity"), F.trim(F.regexp_replace("name", r"\s*-\s*\d+/\d+$", "")).alias("clean_name"),
    ).filter("number IS NOT NULL AND number <> ''")


def map_products_to_cards(groups: DataFrame, products: DataFrame, cards: DataFrame) -> DataFrame:
    """Products with the card they belong to: by set and number, else by set and name."""
    sets = cards.select("set_id", F.lower(F.trim("set_name")).alias("title")).distinct()
    g = groups.select("groupId", X.set_title(F.col("name")).alias("title")).join(sets, "title")
    p = product_fields(products).join(g.select("groupId", "set_id"), "groupId")
    by_number = cards.groupBy("set_id", "number").agg(F.min("card_id").alias("id1"))
    by_name = cards.groupBy("set_id", F.col("name").alias("clean_name")).agg(F.min("card_id").alias("id2"))
    hits = p.join(by_number, ["set_id", "number"], "left").join(by_name, ["set_id", "clean_name"], "left")
    best = hits.groupBy("productId").agg(F.coalesce(F.min("id1"), F.min("id2")).alias("card_id"))
    state = cards.select("card_id", F.col("product_id").isNotNull().alias("was_mapped"))
    return best.join(state, "card_id", "left").select(
        "productId", "card_id", F.when(F.col("card_id").isNull(), "unmatched").when(F.col("was_mapped"), "already_mapped").otherwise("mapped").alias("status")
    )


def discover_products(groups: DataFrame, products: DataFrame, entries: DataFrame, cards: DataFrame, min_price: float = 10.0) -> DataFrame:
    """What to do with every product that is dear enough: already_tracked, re_track, map_existing or create.

    Sets match when the catalogue's set name contains the group title; an empty title is in every name.
    A price counts as it is shown, in cents.
    """
    price = F.coalesce(F.nullif(F.col("marketPrice"), F.lit(0.0)), F.col("midPrice"))
    best = best_price_entry(entries).withColumn("price", rnd(price))
    dear = product_fields(products).join(best.filter(F.col("price") >= min_price).select("productId", "price", "variant"), "productId")
    known = cards.filter("product_id IS NOT NULL").select(F.col("product_id").alias("productId"), F.col("is_tracked").alias("tracked"))
    synthetic = cards.filter("tcg_id LIKE 'tcgcsv-%'").select("tcg_id", F.lit(True).alias("synthetic"))
    titles = groups.select("groupId", X.set_title(F.col("name")).alias("title"))
    sets = cards.select("set_name").distinct().withColumn("low", F.lower("set_name"))
    names = sets.select("low").filter("low IS NOT NULL").distinct()
    bases = titles.select(F.col("title").alias("base")).distinct()
    pairs = containing(names, bases).unionByName(names.crossJoin(bases.filter("base = ''")))  # at most one empty title
    close = titles.join(pairs.withColumnRenamed("base", "title"), "title").join(sets, "low").select("groupId", "set_name")
    numbered = cards.groupBy("set_name", "number").agg(F.min("card_id").alias("card_id"))
    match = dear.join(close, "groupId").join(numbered, ["set_name", "number"]).groupBy("productId").agg(F.min("card_id").alias("match_id"))
    rows = (
        dear.join(known, "productId", "left").withColumn("tcg_id", F.concat(F.lit("tcgcsv-"), F.col("productId").cast("string")))
        .join(synthetic, "tcg_id", "left").join(match, "productId", "left")
    )
    action = (
        F.when(F.col("tracked"), "already_tracked").when(~F.col("tracked"), "re_track").when(F.col("synthetic"), "already_tracked")
        .when(F.col("match_id").isNotNull(), "map_existing").otherwise("create")
    )
    return rows.select("productId", "tcg_id", "clean_name", "number", "price", "variant", "match_id", action.alias("action"))


# The tiers that a look-up may use: all of them, or those of the short chain of the sales collector.
MATCH_CHAINS = {"full": (1, 2, 3, 4, 5), "short": (1, 2, 5)}


def match_product_listing(cards: DataFrame, found: DataFrame, chain: str = "full") -> DataFrame:
    """Best search result per card by tier, then by position.

    ``found`` has card_id, pos, product_id, product_name, product_set, product_number. The short chain
    takes a name inside a product's name whatever its set.
    """
    rows = found.join(cards.select("card_id", F.lower(F.trim("name")).alias("n"), F.lower(F.trim("set_name")).alias("s"), F.col("number").cast("string").alias("num")), "card_id")
    pn, ps = F.lower(F.trim(F.coalesce("product_name", F.lit("")))), F.lower(F.trim(F.coalesce("product_set", F.lit(""))))
    bare = F.when(ps.contains(": "), F.regexp_replace(ps, r"^.*?: ", ""))
    s, n, num = F.col("s"), F.col("n"), F.col("num")
    same_set = ps.contains(s) | s.contains(ps) | F.coalesce(bare.contains(s) | s.contains(bare), F.lit(False))
    numbered = F.coalesce((num != "") & (pn.contains(F.concat(F.lit("#"), num)) | pn.contains(F.concat(F.lit("- "), num)) | (F.col("product_number").cast("string") == num)), F.lit(False))
    tests = {1: same_set & numbered, 2: same_set & (pn == n), 3: same_set & pn.contains(n), 4: pn == n, 5: pn.contains(n)}
    tier = F.coalesce(*[F.when(tests[k], k) for k in MATCH_CHAINS[chain]])
    ranked = rows.withColumn("tier", tier).filter("tier IS NOT NULL")
    return ranked.groupBy("card_id").agg(F.min(F.struct("tier", "pos", "product_id")).alias("b")).select("card_id", "b.tier", "b.product_id")


def resolve_products(cards: DataFrame, sales: DataFrame, found: DataFrame, chain: str = "full") -> DataFrame:
    """The product of every card and where it was found: mapped, sales, search, or null where nowhere.

    A card's own product id comes first, then the id of its earliest sale that names a number (ties: the
    smallest number), then the search results. Sales are reduced to one row a card before the join.
    """
    pid = F.col("source_product_id").try_cast("long")
    own = sales.filter(pid.isNotNull()).groupBy("card_id").agg(F.min(F.struct("order_date", pid.alias("pid")))["pid"].alias("sold_id"))
    searched = match_product_listing(cards, found, chain).select("card_id", F.col("product_id").alias("search_id"))
    rows = cards.select("card_id", "product_id").join(own, "card_id", "left").join(searched, "card_id", "left")
    via = F.when(F.col("product_id").isNotNull(), "mapped").when(F.col("sold_id").isNotNull(), "sales").when(F.col("search_id").isNotNull(), "search")
    return rows.select("card_id", F.coalesce("product_id", "sold_id", "search_id").alias("product_id"), via.alias("via"))


def html_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags dropped, the common entities decoded, trimmed."""
    bare = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def is_finance_url(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("pok") & low.rlike("|".join(ARTICLE_WORDS)) & ~low.contains("japanese-pok")


def extract_articles(pages: DataFrame, finance_only: bool = True, limit: int | None = None, max_chars: int = 0) -> DataFrame:
    """Title, date and body of article pages; the newest ``limit`` of them if one is given.

    The body is whole; a report that shows a summary passes ``max_chars``.
    """
    rows = pages.filter(is_finance_url(F.col("url"))) if finance_only else pages
    body = F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(p|h2|h3)\b[^>]*>(.*?)(?=</\1>|<p\b|<h2\b|<h3\b|$)"), F.lit(2))
    texts = F.transform(blocks, html_text)
    kept = F.filter(
        texts,
        lambda t: (t != "") & ~t.rlike(r"^\d+/\d+") & ~((F.length(t) < 20) & t.contains("$")) & ~t.isin(*BUTTON_LABELS),
    )
    content = F.array_join(kept, "\n")
    in_url = F.regexp_extract("url", r"(\d{2})-(\d{2})-(\d{4})", 0)
    url_date = F.try_to_date(F.nullif(in_url, F.lit("")), "MM-dd-yyyy")
    ld_date = F.try_to_date(F.nullif(F.regexp_extract("html", r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1), F.lit("")), "yyyy-MM-dd")
    cut = content if not max_chars else F.when(F.length(content) > max_chars, F.concat(F.substring(content, 1, max_chars), F.lit("..."))).otherwise(content)
    out = rows.select(
        "page_id", "url", html_text(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("title"),
        F.coalesce(ld_date, url_date).alias("date"), url_date.alias("url_date"), cut.alias("content"),
    ).filter("content <> ''")
    ordered = out.drop("url_date")
    return ordered if limit is None else out.orderBy(F.desc_nulls_last("url_date"), "page_id").limit(limit).drop("url_date")


def decode_json_cols(cards: DataFrame, *names: str) -> DataFrame:
    """JSON list columns as arrays; empty where null or broken."""
    empty = F.array().cast("array<string>")
    return cards.withColumns({n: F.coalesce(F.from_json(n, "array<string>"), empty) for n in names})


def apply_pricepoints(cards: DataFrame, points: DataFrame, existing: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Cards with the first positive point of each, and the history rows to add.

    ``points`` has card_id and an array of printingType, marketPrice. A card that has any row of
    the day gets none, whatever its variant.
    """
    first = F.get(F.filter("points", lambda e: e["marketPrice"] > 0), F.lit(0))
    hits = points.select("card_id", first.alias("e")).filter("e IS NOT NULL").select(
        "card_id", rnd(F.col("e.marketPrice")).alias("price"), F.lower(F.coalesce("e.printingType", F.lit(""))).alias("printing")
    )
    rows = cards.join(hits, "card_id", "left")
    variant = lookup(PRINTING_TO_VARIANT, F.col("printing"), F.coalesce("price_variant", F.lit("normal")))
    got = F.col("price").isNotNull()
    updated = rows.select(
        *[c for c in cards.columns if c not in ("current_price", "price_variant")],
        F.coalesce("price", "current_price").alias("current_price"), F.when(got, variant).otherwise(F.col("price_variant")).alias("price_variant"), got.alias("updated"),
    )
    history = updated.filter("updated").select(
        "card_id", as_of.alias("date"), F.col("price_variant").alias("variant"), F.lit("Near Mint").alias("condition"), F.col("current_price").alias("market_price")
    ).join(existing.select("card_id", "date"), ["card_id", "date"], "left_anti")
    return updated, history
