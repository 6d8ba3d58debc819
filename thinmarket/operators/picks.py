"""Recommended cards out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.functions import text as X
from thinmarket.operators.containment import containing

# Headings that open and close the recommendation section.
SECTION_STARTS = ("portfolio recommendations", "core holdings")
SECTION_ENDS = ("watchlist", "where the desk agrees", "key risks", "the honest answer")
MAX_PRICE_DISTANCE = 0.75


def plain_marks(text: Column) -> Column:
    return F.translate(text, "’‘“”—–", "''\"\"--")


def recommendation_section(text: Column) -> Column:
    starts = [F.instr(F.lower(text), s) for s in SECTION_STARTS]
    begin = F.when(starts[0] > 0, starts[0]).otherwise(F.greatest(starts[1], F.lit(1)))
    body = F.substr(text, begin)
    # A marker at the very start does not cut.
    ends = [F.when(F.instr(F.lower(body), m) > 1, F.instr(F.lower(body), m)) for m in SECTION_ENDS]
    return F.substr(body, F.lit(1), F.coalesce(F.least(*ends) - 1, F.length(body)))


def recommendation_blocks(texts: DataFrame) -> DataFrame:
    """Numbered blocks: (text_id, block, line, tier, signal, line_price)."""
    parts = F.split(recommendation_section(F.col("text")), r"\n(?=\s*\*{0,2}\d+[.)]\s)")
    rows = texts.select("text_id", F.posexplode(parts).alias("pos", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")))
    head = r"^\*{0,2}\d+[.)]\s*([^\n]*)"
    rows = rows.filter(F.col("part").rlike(head)).withColumn("line", F.trim(F.regexp_replace(F.regexp_extract("part", head, 1), r"^[\s*]+|[\s*]+$", "")))
    segments = F.split("line", "—")
    strategy = F.regexp_extract("part", r"(?im)\n[^\n]*?Strategy:[*\s]*([^\n]+?)\s*\*{0,2}\s*$", 1)
    price = F.regexp_extract("line", r"\$([\d,]+\.?\d*)", 1)
    low = plain_marks(F.lower("line"))
    name_part = F.trim(F.when(F.size(segments) >= 2, F.lower(F.get(segments, F.lit(0)))).otherwise(F.get(F.split(low, "-"), F.lit(0))))
    return rows.select(
        "text_id",
        F.row_number().over(Window.partitionBy("text_id").orderBy("pos")).alias("block"),
        "line", low.alias("low"), F.length(name_part).alias("name_chars"),
        F.when(F.size(segments) >= 2, X.parse_tier(F.element_at(segments, -1))).alias("tier"),
        F.when(strategy != "", X.parse_signal(strategy)).otherwise("hold").alias("signal"),
        F.regexp_replace(price, ",", "").try_cast("double").alias("line_price"),
    )


def candidates(blocks: DataFrame, cards: DataFrame) -> DataFrame:
    """Blocks with every priced card whose name occurs in the line.

    Distinct lines and distinct names meet through the index of ``containment``. Cards alike in name, set
    and price differ by their id alone, and a block asks for no more candidates than its number.
    """
    names = cards.filter("current_price > 0 AND name IS NOT NULL").select(
        "card_id", "current_price", plain_marks(F.lower("name")).alias("low_name"), plain_marks(F.lower(F.coalesce("set_name", F.lit("")))).alias("low_set")
    )
    alike = Window.partitionBy("low_name", "low_set", "current_price").orderBy("card_id")
    ranked = names.withColumn("copy", F.row_number().over(alike))
    hits = blocks.join(containing(blocks, names, "low", "low_name"), "low").join(ranked, "low_name").filter(F.col("copy") <= F.col("block"))
    distance = F.abs(F.col("current_price") - F.col("line_price")) / F.greatest(F.col("line_price"), F.lit(1.0))
    return (
        hits.withColumn("price_dist", F.when(F.col("line_price") > 0, distance))
        .filter(F.col("price_dist").isNull() | (F.col("price_dist") <= MAX_PRICE_DISTANCE))
        .withColumn("set_match", (F.col("low_set") != "") & F.col("low").contains(F.col("low_set")))
        .withColumn("coverage", F.length("low_name") / F.greatest(F.col("name_chars"), F.lit(1)))
    )


def extract_picks(texts: DataFrame, cards: DataFrame) -> DataFrame:
    """Each numbered block gets its best card; a card serves one block of a text, in block order.

    Block b can lose at most b - 1 candidates to the blocks before it, so its b best decide.
    """
    blocks = recommendation_blocks(texts)
    best = Window.partitionBy("text_id", "block").orderBy(
        F.desc("set_match"), F.desc("coverage"), F.asc_nulls_last("price_dist"), F.desc(F.length("low_name")), "card_id"
    )
    ranked = candidates(blocks, cards).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("block"))
    per_block = ranked.groupBy("text_id", "block", "tier", "signal").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "card_id"))), lambda c: c["card_id"]).alias("ids")
    )
    per_text = per_block.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("block", "tier", "signal", "ids"))).alias("blocks"))

    def take(taken: Column, b: Column) -> Column:
        free = F.filter(b["ids"], lambda c: ~F.array_contains(taken, c))
        return F.array_append(taken, F.coalesce(F.get(free, F.lit(0)), F.lit(-1).cast("long")))

    picks = F.aggregate("blocks", F.array().cast("array<bigint>"), take)
    rows = per_text.select("text_id", F.inline(F.arrays_zip(F.col("blocks").alias("b"), picks.alias("card_id"))))
    return rows.filter("card_id >= 0").select(
        "text_id", F.col("b.block").alias("block"), "card_id", F.coalesce("b.tier", F.lit("mid")).alias("price_tier"), F.col("b.signal").alias("signal")
    )
