"""Writers. Tables are Parquet folders; no table format with MERGE is assumed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from thinmarket.functions.numeric import rnd


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty one like ``like`` if there is nothing at that path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def first_of_each(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order_by``, by all other columns without it; nulls come first."""
    order = order_by or [c for c in df.columns if c not in keys]
    if not order:
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(f"`{c}`") for c in order])).alias("__row"))
    return best.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def without_keys(df: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``keyed`` lacks; a null key equals a null key."""
    seen = keyed.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)])
    return df.join(seen, reduce(and_, [df[k].eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]), "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, order_by: list[str] | None = None) -> None:
    """Insert-if-absent: rows whose keys the table lacks, each key once; a null key equals a null key.

    Of several rows with a key the first by ``order_by`` is taken. The write replaces nothing, so a lost
    executor only repeats its own tasks.
    """
    fresh = first_of_each(without_keys(df, read_or_empty(df.sparkSession, path, df), keys), keys, order_by)
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Dynamic partition overwrite: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def overlay_partitions(df: DataFrame, path: str, keys: list[str], partition_by: list[str], staging: str, order_by: list[str] | None = None) -> None:
    """Lays rows over a table by key and rewrites only the partitions that they touch.

    A key's partition must not change, so ``partition_by`` has to follow from the keys. Only the
    touched partitions are read. The merged rows are written to the new folder ``staging`` first and replace the partitions
    from there, so a job that is stopped between the two loses nothing: the last step can be done again from ``staging``.
    """
    spark = df.sparkSession
    new = first_of_each(df, keys, order_by)
    touched = new.select(*partition_by).distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), partition_by, "left_semi").select(*df.columns)  # one row per partition
    without_keys(old, new, keys).unionByName(new).write.mode("error").parquet(staging)
    replace_partitions(spark.read.parquet(staging), path, partition_by)


def screener_export(page: DataFrame) -> DataFrame:
    """Fixed columns of the screener CSV, prices as text with two digits."""
    def fixed(name: str, digits: int):
        return F.format_string(f"%.{digits}f", F.col(name).cast("double"))

    roi = F.when(F.col("current_price") > 0, F.col("est_profit") / F.col("current_price") * 100)
    return page.select(
        F.col("name").alias("Name"), F.col("set_name").alias("Set"), fixed("current_price", 2).alias("Price"), fixed("investment_score", 1).alias("Investment Score"),
        fixed("liquidity_score", 1).alias("Liquidity"), fixed("appreciation_score", 1).alias("Appreciation"), F.col("regime").alias("Regime"),
        fixed("est_profit", 2).alias("Est Profit"), F.format_string("%.1f", rnd(roi, 1)).alias("Return %"), fixed("sales_per_day", 2).alias("Velocity"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("quoteAll", False).csv(path)
