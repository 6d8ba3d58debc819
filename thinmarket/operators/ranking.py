"""Ranks within groups that may be crowded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def banded_rank(df: DataFrame, keys: list[str], band: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Row number within ``keys``, computed band by band.

    ``band`` must fall as the rank grows (higher band first). Only the few band sizes of a group
    meet in one task; its rows are ranked in parallel inside their bands.
    """
    rows = df.withColumn("_band", band)
    sizes = rows.groupBy(*keys, "_band").agg(F.count("*").alias("_size"))
    above = F.sum("_size").over(Window.partitionBy(*keys).orderBy(F.desc("_band"))) - F.col("_size")
    offsets = sizes.withColumn("_above", above).withColumn("group_size", F.sum("_size").over(Window.partitionBy(*keys)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_band").orderBy(*order))
    return (
        rows.withColumn("_k", inside).join(offsets.drop("_size"), [*keys, "_band"])
        .withColumn(name, F.col("_above") + F.col("_k")).drop("_band", "_k", "_above")
    )


BANDS_PER_FACTOR = 1024  # bands to a factor of e
PIECES = 256  # pieces of a value that is too frequent for one slot


def slotted(df: DataFrame, keys: list[str], value: str, tie: str, most: int = 100_000) -> DataFrame:
    """The rows with the slot (``_b``, ``_v``, ``_piece``) they are ranked in, ``_above``, the rows before it, and ``group_size``.

    Slots follow each other in the order of falling value and rising tie. A band of values with up to ``most``
    rows is a slot. A larger one is cut by its values, and a value that is too frequent still at edges of its
    ties that cut it into even pieces. Only counts of bands, values and pieces meet in one task; a band holds few values of a price grid.
    """
    rows = df.withColumn("_b", F.floor(F.log(F.col(value)) * BANDS_PER_FACTOR))
    group, band, one = Window.partitionBy(*keys), [*keys, "_b"], [*keys, "_b", "_v"]
    bands = rows.groupBy(*band).agg(F.count("*").alias("_n"))
    bands = bands.withColumn("_above", F.sum("_n").over(group.orderBy(F.desc("_b"))) - F.col("_n")).withColumn("group_size", F.sum("_n").over(group))
    placed = rows.join(bands, band)
    few = placed.filter(F.col("_n") <= most).drop("_n").withColumns({"_v": F.lit(None).cast("double"), "_piece": F.lit(0).cast("long")})

    many = placed.filter(F.col("_n") > most).drop("_n").withColumn("_v", F.col(value).cast("double"))
    shares = [k / PIECES for k in range(1, PIECES)]
    values = many.groupBy(*one).agg(F.count("*").alias("_n"), F.percentile_approx(tie, shares, 100 * PIECES).alias("_edges"))
    values = values.withColumn("_before", F.sum("_n").over(Window.partitionBy(*band).orderBy(F.desc("_v"))) - F.col("_n"))
    passed = F.size(F.filter("_edges", lambda e: e < F.col(tie))).cast("long")  # any edges give right ranks, good ones even pieces
    many = many.join(values, one).withColumn("_piece", F.when(F.col("_n") > most, passed).otherwise(F.lit(0).cast("long")))
    pieces = many.groupBy(*one, "_piece").agg(F.count("*").alias("_n"))
    pieces = pieces.withColumn("_first", F.sum("_n").over(Window.partitionBy(*one).orderBy("_piece")) - F.col("_n")).drop("_n")
    many = many.join(pieces, [*one, "_piece"]).withColumn("_above", F.col("_above") + F.col("_before") + F.col("_first"))
    return few.unionByName(many.select(*few.columns))


def ordered_rank(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "rank", most: int = 100_000) -> DataFrame:
    """Row number within ``keys`` by falling value and rising tie, ranked slot by slot, so that no task sorts a crowded group.

    Values are positive numbers and ties whole numbers; rows without either, or without a key, are left out. Rows alike in
    value and tie follow each other in any order. An empty table gives none. ``group_size`` tells the rows of the group.
    """
    sound = df.filter(F.col(value) > 0).dropna(subset=[*keys, tie])
    inside = Window.partitionBy(*keys, "_b", "_v", "_piece").orderBy(F.desc(value), F.asc(tie))
    return slotted(sound, keys, value, tie, most).withColumn(name, F.col("_above") + F.row_number().over(inside)).drop("_b", "_v", "_piece", "_above")
