"""Near-duplicate articles: MinHash candidates, Bayesian pruning, exact Jaccard, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.llm.rows import packed, text_key, unpacked
from thinmarket.llm.text import SPACED, Words, chunks, mix, windows
from thinmarket.session import ensure_checkpoint_dir

#: Words of a shingle; bands of the candidate search and MinHash values of a band; values compared at a time.
SHINGLE, BANDS, BAND, STEP = 5, 24, 4, 16
#: A bucket of more texts, or more bytes, is split into blocks, and blocks meet in pairs.
BLOCK_TEXTS, BLOCK_BYTES = 256, 8_000_000
VALUES = BANDS * BAND
_random = np.random.default_rng(7)
_FACTOR = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_SHIFT = _random.integers(1, 1 << 63, VALUES, dtype=np.uint64)


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of ``compared`` at which the similarity may still reach the threshold.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its mass from
    the threshold on is the chance of at most m successes in n + 1 draws at the threshold.
    """
    n, mass = compared + 1, 0.0
    for m in range(n):
        mass += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if mass >= tolerance:
            return m
    return n


def signatures(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, MinHash values by row, number of words by row)."""
    for i, j, data, bounds in chunks(texts):
        words = Words(data, bounds, SPACED)
        h, first = windows(words.hashes(), words.first, SHINGLE)
        out = np.full((j - i, VALUES), np.iinfo(np.uint32).max, np.uint32)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            at = first[:-1][full]
            for k in range(VALUES):
                out[full, k] = np.minimum.reduceat((h * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), at)
        yield i, j, out, np.diff(words.first)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash per text and band."""
    parts = values.reshape(len(values), BANDS, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for k in range(BAND):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.astype(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = np.zeros((batch.num_rows, BANDS), np.int64)
        for i, j, values, _ in signatures(batch.column("body")):
            bands[i:j] = band_hashes(values)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("size"), lists], ["key", "id", "size", "bands"])


def _shingle_ids(bodies: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as numbers; equal numbers are equal words, nothing is hashed."""
    known: dict[bytes, int] = {}
    codes, counts = [], []
    for body in bodies:
        words = body.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ")
        own = [known.setdefault(w, len(known)) for w in words if w]
        counts.append(len(own))
        codes.append(np.array(own, np.int64))
    flat, first = np.concatenate(codes), np.concatenate([[0], np.cumsum(counts)])
    runs = [np.arange(a, max(a + 1, b - SHINGLE + 1)) if b > a else np.zeros(0, np.int64) for a, b in zip(first, first[1:])]
    at, stop = np.concatenate(runs), np.repeat(first[1:], [len(r) for r in runs])
    ids = np.zeros(len(at), np.int64)
    for k in range(SHINGLE):
        here = at + k
        part = np.where(here < stop, flat[np.minimum(here, len(flat) - 1)] + 1, 0)
        _, ids = np.unique(ids * (len(known) + 1) + part, return_inverse=True)
    ends = np.cumsum([len(r) for r in runs])
    return [np.unique(part) for part in np.split(ids, ends[:-1])]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common shingles of the given pairs: merged one by one, or as bit sets if many."""
    if len(pairs) * 20 < len(left) * len(right) or len(left) * len(right) < 64:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in pairs], np.int64)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        grids = []
        for side in (left, right):
            grid = np.zeros((len(side), 4096), bool)
            for row, ids in enumerate(side):
                grid[row, np.searchsorted(part, ids[np.isin(ids, part, assume_unique=True)])] = True
            grids.append(np.packbits(grid, axis=1).view(np.uint64))
        for row in range(len(left)):  # counted in words of 64 bits; a threaded matrix product can hang in forked workers
            total[row] += np.bitwise_count(grids[1] & grids[0][row]).sum(1, dtype=np.int64)
    return total[pairs[:, 0], pairs[:, 1]]


def linked_pairs(left: list[str], right: list[str] | None, band: int, threshold: float, tolerance: float) -> np.ndarray:
    """Pairs of a bucket that reach the threshold; of one list with itself if ``right`` is None.

    Only pairs whose first common band is ``band`` count, so each pair is judged in one bucket.
    """
    bodies = left + (right or [])
    values = np.concatenate([v for _, _, v, _ in signatures(pa.array(bodies, pa.string()))])
    n = len(left)
    a, b = (np.triu_indices(n, 1) if right is None else tuple(x.ravel() for x in np.indices((n, len(right)))))
    b = b if right is None else b + n
    bands = band_hashes(values)
    for k in range(band):
        fresh = bands[a, k] != bands[b, k]
        a, b = a[fresh], b[fresh]
    same = bands[a, band] == bands[b, band]
    a, b = a[same], b[same]
    matches = np.zeros(len(a), np.int64)
    for k in range(0, VALUES, STEP):
        matches += (values[a, k : k + STEP] == values[b, k : k + STEP]).sum(1)
        alive = matches >= least_matches(k + STEP, threshold, tolerance)
        a, b, matches = a[alive], b[alive], matches[alive]
    if not len(a):
        return np.zeros((0, 2), np.int64)
    ids = _shingle_ids(bodies)
    pairs = np.stack([a, b if right is None else b - n], 1)
    common = _overlaps(ids[:n], ids if right is None else ids[n:], pairs)
    sizes = np.array([len(x) for x in ids])
    union = sizes[a] + sizes[b] - common
    return np.stack([a, b], 1)[common >= threshold * union - 1e-9]


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member that pairs lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _matcher(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def judged():
            rows.sort()
            left = [r for r in rows if r[0] == 0]
            right = [r for r in rows if r[0] == 1]
            if group[2] != group[3] and not (left and right):
                return
            keys = [r[1] for r in left + right]
            pairs = linked_pairs([r[2] for r in left], [r[2] for r in right] or None, group[0], threshold, tolerance)
            if len(pairs):
                order = sorted(range(len(keys)), key=keys.__getitem__)
                rank = np.argsort(order)
                root = _forest(len(keys), rank[pairs])
                links = np.bincount(pairs.ravel(), minlength=len(keys))
                for k in np.flatnonzero(links):
                    yield keys[k], keys[order[root[rank[k]]]], int(links[k])

        def told(found):
            found = list(found)
            columns = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["key", "root", "links"])

        for batch in batches:
            out = []
            for band, bucket, i, j, side, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, bucket, i, j) != group:
                    if rows:
                        out.extend(judged())
                    group, rows = (band, bucket, i, j), []
                rows.append((side, key, body))
            yield told(out)
        if rows:
            yield told(judged())

    return run


def _components(edges: DataFrame) -> DataFrame:
    """(key, root): for every key of the edges (key, root) the smallest key that it leads to.

    Each round hangs every node on its smallest neighbour and follows one step, then keeps only edges
    between different roots. Nothing but one boolean a round comes to the driver.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = edges.select(F.col("key").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct().checkpoint()
    nodes = both(left).select(F.col("a").alias("key")).distinct().withColumn("root", F.col("key")).checkpoint()
    while not left.isEmpty():
        low = both(left).groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        step = low.join(low.select(F.col("a").alias("to"), F.col("to").alias("further")), "to", "left").select("a", F.coalesce("further", "to").alias("to")).checkpoint()
        nodes = nodes.join(step, nodes["root"] == step["a"], "left").select("key", F.coalesce("to", "root").alias("root")).checkpoint()
        end = lambda e, c: e.join(step.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
        left = end(end(left, "a"), "b").filter("a <> b").select("a", "b").distinct().checkpoint()
    return nodes


def _has_words(body: Column) -> Column:
    return F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def text_classes(articles: DataFrame, article_id: str = "article_id", body: str = "body", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(key, first_id, n_copies, n_links, root): every distinct text with words, and its class's root."""
    ensure_checkpoint_dir(articles.sparkSession)
    text = F.col(body).cast("string")
    rows = articles.select(text_key(text).alias("key"), F.col(article_id).alias("id"), F.octet_length(text).alias("size"), text.alias("body")).filter(_has_words(F.col("body")))
    kind = rows.schema["id"].dataType.simpleString()
    banded = rows.mapInArrow(_banded, f"key binary, id {kind}, size int, bands array<long>")
    # One narrow row per distinct text; copies are summed before they are shuffled.
    texts = banded.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("size").alias("size"), F.first("bands").alias("bands")).checkpoint()

    places = texts.select("key", "size", F.posexplode("bands").alias("band", "bucket"))
    mark = F.xxhash64("key")
    buckets = places.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 40))).alias("s")).filter("n > 1")
    # A bucket with the same texts as one of an earlier band adds no pair.
    buckets = buckets.groupBy("n", "bytes", "x", "s").agg(F.min(F.struct("band", "bucket")).alias("b")).select(
        "b.band", "b.bucket", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks")
    )
    own = F.pmod(mark, F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j"), (own > y).cast("int").alias("side")))
    members = places.join(buckets, ["band", "bucket"]).select("key", "band", "bucket", F.explode(meets).alias("m"))
    wanted = members.groupBy("key").agg(F.collect_list(F.struct("band", "bucket", "m.i", "m.j", "m.side")).alias("at"))
    bodies = rows.groupBy("key").agg(F.first("body").alias("body"))
    met = bodies.join(wanted, "key").select("key", "body", F.explode("at").alias("a")).select("a.band", "a.bucket", "a.i", "a.j", "a.side", "key", "body")
    met = met.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j")
    linked = met.mapInArrow(_matcher(threshold, tolerance), "key binary, root binary, links long").checkpoint()

    roots = _components(linked)
    links = linked.groupBy("key").agg(F.sum("links").alias("n_links"))
    return texts.select("key", "first_id", "n_copies").join(links, "key", "left").join(roots, "key", "left").select(
        "key", "first_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "key").alias("root")
    )


def near_duplicates(articles: DataFrame, article_id: str = "article_id", body: str = "body", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per article: its class, its exact copies and its links to different texts.

    Texts are sets of five-word shingles, words being runs of anything but white space; a text of one
    to four words is one shingle. Two texts are linked if the Jaccard similarity of their sets is at
    least ``threshold``. Columns: the id, ``class_id`` (smallest id of the class that links and copies
    form), ``n_copies`` (articles with this very text, itself included), ``n_links`` (different texts
    linked to it).

    Candidates share one of 24 bands of four MinHash values (a pair at 0.8 shares none once in
    300,000). Their MinHash values are compared 16 at a time; a pair goes as soon as the posterior
    chance that its similarity reaches the threshold is below ``tolerance``; all others are verified
    on their words. Every pair is judged once, in its first common band. Buckets of any size are
    judged in full: large ones are split into blocks that meet in pairs, and only sums and one edge
    per text leave a task. Equal texts are one text from the first step on.

    Null, empty and blank bodies have no shingles: each is a class of its own, one copy, no link. Null
    ids are ignored for ``class_id`` unless the class has no other; repeated rows are copies. Empty
    tables give empty results; other columns are ignored.
    """
    rows = articles.select(F.col(article_id).alias("id"), F.when(_has_words(F.col(body).cast("string")), text_key(F.col(body))).alias("key"))
    texts = text_classes(articles, article_id, body, threshold, tolerance)
    named = texts.join(texts.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("key", "class_id", "n_copies", "n_links")
    none, one = F.col("key").isNull(), F.lit(1).cast("long")
    return rows.join(named, "key", "left").select(
        F.col("id").alias(article_id), F.when(none, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("n_links", one - 1).alias("n_links"),
    )


def one_of_each(articles: DataFrame, article_id: str = "article_id", body: str = "body", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """The articles with one of each class: of its root text, the row with the smallest id; all columns.

    Articles without words all stay.
    """
    losers = text_classes(articles, article_id, body, threshold, tolerance).filter("root <> key").select("key")
    text = F.col(f"`{body}`").cast("string")
    keyed = articles.select(packed(articles), text_key(text).alias("key"), F.col(f"`{article_id}`").alias("id"), _has_words(text).alias("full"))
    single = keyed.filter("full").groupBy("key").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row")).join(losers, "key", "left_anti")
    return single.select("row").unionAll(keyed.filter("NOT full").select("row")).select(*unpacked(articles.columns))
