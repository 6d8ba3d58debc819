"""Keys that name a row by its content, so that null or repeated ids need no special path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.session import checkpoint_root


def text_key(text: Column) -> Column:
    """128 bits of the text; null for null."""
    return F.unhex(F.md5(text.cast("string")))


def row_key(row_id: Column, text: Column) -> Column:
    """128 bits of id and text. Rows equal in both share it and get the same result."""
    return text_key(F.concat(F.coalesce(row_id.cast("string"), F.lit("\x01")), F.lit("\x00"), F.coalesce(text.cast("string"), F.lit("\x01"))))


def packed(rows: DataFrame) -> Column:
    """All columns as one struct with neutral names, to carry them past any clash."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("row")


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    return [replaced.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)]


def stored(rows: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read again; unlike ``checkpoint`` it computes them once."""
    path = f"{checkpoint_root(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
