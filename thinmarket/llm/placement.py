"""Shards by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered within so many hash buckets of a shard, so that no task sorts a whole shard.
BUCKETS, COPIES_AT_ONCE = 4096, 1 << 16


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, regions: int = 2) -> list[Leaf]:
    """Equal shards, ``racks`` to a region and ``regions`` times that in all, filled in order."""
    per_rack = max(1, -(-shards // (racks * regions)))
    return [Leaf(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own.

    A region that is new draws rows from all others and gives none, so rows move into the new shard
    only. A shard added inside a rack would raise its region's weight, and rows that the region then
    wins are dealt among all its shards.
    """
    s = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"region-of-{s}", f"rack-of-{s}", s, weight)]


def _draw(key: Column, nodes: dict[str, float]) -> Column:
    """The node whose weighted draw wins: the least of -ln(u) / weight, u hashed from key and node."""

    def draw(name: str, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(weight)).alias("score"), F.lit(name).alias("node"))

    draws = [draw(n, w) for n, w in sorted(nodes.items()) if w > 0]
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["node"]


def place(key: Column, tree: list[Leaf]) -> dict[str, Column]:
    """Region, rack and shard of a key: a draw at each level among the children of the node above.

    Changing a weight moves keys only into or out of the subtrees whose weights change; a key null is
    a key like any other.
    """
    region_w: dict[str, float] = {}
    rack_w: dict[str, dict[str, float]] = {}
    shard_w: dict[str, dict[str, float]] = {}
    for leaf in tree:
        region_w[leaf.region] = region_w.get(leaf.region, 0) + leaf.weight
        racks = rack_w.setdefault(leaf.region, {})
        racks[leaf.rack] = racks.get(leaf.rack, 0) + leaf.weight
        shard_w.setdefault(f"{leaf.region}/{leaf.rack}", {})[str(leaf.shard)] = leaf.weight
    key = F.coalesce(key.cast("string"), F.lit("\x00"))

    def below(parent: Column, children: dict[str, dict[str, float]]) -> Column:
        out = None
        for name, nodes in sorted(children.items()):
            if sum(nodes.values()) > 0:
                mine = _draw(F.concat(key, F.lit("\x00" + name)), nodes)
                out = F.when(parent == name, mine) if out is None else out.when(parent == name, mine)
        return out

    region = _draw(key, region_w)
    rack = below(region, rack_w)
    return {"region": region, "rack": rack, "shard": below(F.concat(region, F.lit("/"), rack), shard_w).cast("int")}


def shard_manifest(articles: DataFrame, tree: list[Leaf], article_id: str = "article_id", body: str = "body", buckets: int = BUCKETS) -> DataFrame:
    """Where each article goes: id, size, text_crc32, region, rack, shard, slot, grown_shard.

    Works on articles, or on any of the project's tables with an id and a text, such as sales by
    listing_id and listing_title. Size is the text's bytes plus 1. Id and tree alone decide the shard;
    ``grown_shard`` is the one after ``grown(tree)``. Slots of a shard run from 0 without a gap, in the
    order of (hash bucket, id, size, checksum).

    A null text is empty. A null id is a key of its own, as is each repeated id: its rows share a
    shard. Equal rows are counted first and numbered one after the other, so a hot id is not sorted
    row by row. Empty tables give empty manifests; other columns are ignored.
    """
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    rows = articles.select(F.col(article_id).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    at, later = place(F.col("id"), tree), place(F.col("id"), grown(tree))
    placed = counted.withColumn("region", at["region"]).withColumn("rack", at["rack"]).withColumn("shard", at["shard"]).withColumn("grown_shard", later["shard"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(buckets)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))  # at most shards x buckets rows
    first = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before(Window.partitionBy("shard").orderBy("bucket"))), zero).alias("first"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32"))), zero)
    numbered = placed.withColumn("own", own).join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("own"))
    parts = numbered.withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES_AT_ONCE))))
    begin = F.col("part") * COPIES_AT_ONCE
    copies = parts.withColumn("copy", F.explode(F.sequence(begin, F.least(begin + COPIES_AT_ONCE, F.col("n")) - 1)))
    return copies.select(F.col("id").alias(article_id), "size", "text_crc32", "region", "rack", "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")
