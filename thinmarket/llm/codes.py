"""Vector codes: price windows cut into parts, each part coded by the nearest entry of a trained codebook."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinmarket.session import ensure_checkpoint_dir

#: Parts of a vector, entries of a part's codebook, rounds of training, units of one, rows of a block.
PARTS, ENTRIES, ROUNDS, SCALE, BLOCK = 4, 256, 4, 1024, 256
#: Bits of a Hilbert key, and the most of one component.
KEY_BITS, COMPONENT_BITS = 128, 8


def part_bounds(length: int) -> list[int]:
    """Where the parts of a vector begin and end; equal ones where the length allows."""
    return [length * p // PARTS for p in range(PARTS + 1)]


def largest(length: int) -> int:
    """Components beyond it, of either sign, are set to it, so that the squared error of a vector is below 2**62."""
    return 1 << int((62 - math.log2(max(length, 1))) / 2 - 1)


def _whole(values: np.ndarray, length: int) -> np.ndarray:
    top = largest(length)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -top, top).astype(np.int32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bytes that sort points (rows of numbers below 2**bits) along a Hilbert curve, one row of bytes a point."""
    x = cells.astype(np.uint32).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from the largest on
        low = np.uint32(q - 1)
        for i in range(n):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint32)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[None, :, None]) & 1
    return np.packbits(planes.reshape(len(x), bits * n).astype(bool), axis=1)


def _matrix(lists: pa.Array, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), length)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _slices(n: int, length: int) -> Iterator[slice]:
    """Rows by about 4 MB of components."""
    step = max(1, (1 << 20) // max(length, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _integers(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch.num_rows, length):
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(_whole(_matrix(part.column(1), length), length))], ["row", "parts"])

    return run


def _ints(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.int32).reshape(len(cells), width)


def _ranges(length: int):
    """Smallest and largest value of each component, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _ints(batch.column(0), length)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(v.min(0)), pa.array(v.max(0))], ["at", "low", "high"])

    return run


def _keyed(length: int, low: np.ndarray, high: np.ndarray):
    bounds = part_bounds(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch.num_rows, length):
                ids, rows = batch.column(0)[s], _ints(batch.column(1)[s], length)
                for p in range(PARTS):
                    a, b = bounds[p], bounds[p + 1]
                    bits = max(1, min(COMPONENT_BITS, KEY_BITS // max(b - a, 1)))
                    if b > a:
                        span = np.maximum(high[a:b] - low[a:b] + 1, 1)
                        keys = _binary(hilbert_keys(((rows[:, a:b] - low[a:b]) << bits) // span, bits))
                    else:
                        keys = _binary(np.zeros((len(rows), 1), np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), keys, ids, _binary(rows[:, a:b])], ["part", "curve", "id", "cells"])

    return run


def _blocked(length: int):
    """Sorted parts to flat blocks: values, ids, box and sum."""
    bounds = part_bounds(length)
    names = ["part", "n", "low", "high", "total", "ids", "cells"]

    def block(part: int, ids: list, cells: list) -> pa.RecordBatch:
        width = bounds[part + 1] - bounds[part]
        v = np.frombuffer(b"".join(cells), np.int32).reshape(len(ids), width)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        total = v.sum(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int32()), blob(v.min(0)), blob(v.max(0)), blob(total), blob(np.array(ids, np.int64)), blob(v)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, cells = -1, [], []
        for batch in batches:
            for p, i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ids and (p != part or len(ids) == BLOCK):
                    yield block(part, ids, cells)
                    ids, cells = [], []
                part = p
                ids.append(i)
                cells.append(c)
        if ids:
            yield block(part, ids, cells)

    return run


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to some point of the box, ascending.

    An entry whose distance to the box is beyond another one's largest distance to it is nearest to none;
    at equality it may tie, so it stays.
    """
    near = np.maximum(np.maximum(low - entries, entries - high), 0)
    far = np.maximum(np.abs(entries - low), np.abs(entries - high))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(v: np.ndarray, entries: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row among the shortlisted entries, ties to the lower index; whole numbers."""
    if v.shape[1] == 0:
        return np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    e = entries[few]
    apart = np.zeros((len(v), len(few)), np.int64)
    for j in range(v.shape[1]):
        d = v[:, j, None] - e[None, :, j]
        apart += d * d
    best = apart.argmin(1)
    return few[best], apart[np.arange(len(v)), best]


def _blocks_of(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]):
    for batch in batches:
        for part, n, low, high, total, ids, cells in zip(*(c.to_pylist() for c in batch.columns)):
            width = books[part].shape[1]
            box = [np.frombuffer(x, np.int32).astype(np.int64) for x in (low, high)]
            yield part, n, shortlist(*box, books[part]), np.frombuffer(total, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int32).reshape(n, width).astype(np.int64)


def _summed(books: list[np.ndarray]):
    """Counts and componentwise sums of the parts at each entry, one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for part, n, few, total, _, v in _blocks_of(batches, books):
            if len(few) == 1:  # the whole block has one nearest entry, so its stored sum will do
                counts[part][few[0]] += n
                totals[part][few[0]] += total
                continue
            at, _ = nearest(v, books[part], few)
            order = np.argsort(at, kind="stable")
            used, starts, k = np.unique(at[order], return_index=True, return_counts=True)
            counts[part][used] += k
            if v.shape[1]:
                totals[part][used] += np.add.reduceat(v[order], starts)
        for part, n in enumerate(counts):
            used = np.flatnonzero(n)
            width = totals[part].shape[1]
            at = np.repeat(used, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(n[at]), pa.array(totals[part][used].ravel())],
                ["part", "entry", "at", "n", "total"],
            )

    return run


def _coded(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, few, _, ids, v in _blocks_of(batches, books):
            at, error = nearest(v, books[part], few)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int32)), pa.array(error)], ["id", "part", "code", "error"])

    return run


def price_windows(price_history: DataFrame, length: int, card_id: str = "card_id", variant: str = "variant", date: str = "date", price: str = "market_price") -> DataFrame:
    """(card_id, variant, window): a card's last ``length`` market prices by day, each over the first of them.

    Cards with fewer days or with a first price of 0 have no window. Days without a price are left out; of
    several prices of a day the largest counts. A card has one row a day at most, so groups are bounded by the calendar.
    """
    days = price_history.filter(F.col(price).isNotNull()).groupBy(card_id, variant, date).agg(F.max(price).alias("p"))
    lists = days.groupBy(card_id, variant).agg(F.array_sort(F.collect_list(F.struct(date, "p"))).alias("days")).filter(F.size("days") >= length)
    last = F.transform(F.slice("days", -length, length), lambda d: d["p"])
    return lists.select(card_id, variant, last.alias("last")).filter("last[0] > 0").select(card_id, variant, F.transform("last", lambda p: p / F.col("last")[0]).alias("window"))


def _books_frame(spark: SparkSession, books: list[np.ndarray]) -> DataFrame:
    rows = [(p, i, [int(x) for x in e]) for p, book in enumerate(books) for i, e in enumerate(book)]
    return spark.createDataFrame(rows, "part int, entry int, components array<long>")


def compress_windows(windows: DataFrame, card_id: str = "card_id", window: str = "window") -> tuple[DataFrame, DataFrame]:
    """Codes of the cards' price windows, and the codebooks: (codes, codebooks).

    ``windows`` has a card and a list of numbers, such as its last prices over the first of them
    (``price_windows``). ``codes`` has the other columns of ``windows``, ``codes`` (array<int>, one entry index
    per part) and ``error`` (long, squared distance to the coded window); ``codebooks`` has part, entry and
    components. Components become integers, floor(1024 x); windows are cut into 4 consecutive parts. Each
    part's codebook starts as the parts of the 256 smallest card ids; 4 rounds assign every part to the nearest
    entry (squared distance, ties to the lower index) and replace each entry by its parts' componentwise
    floor(sum / count), unused entries staying; then the parts are assigned once more.

    Parts are sorted along a Hilbert curve by ranges that split equal parts as well, and stored once in flat
    blocks of 256 with the box they fill and their sum. In each round the distances from the box leave a short
    list of entries, and only those are compared with the block's parts; a block with one entry left adds its
    stored sum. A round brings one sum per entry and component to the driver, 256 times the window's length
    whatever the number of cards, and sends the codebooks back.

    Windows that are null or hold a null or non-finite component are left out, as are windows of another
    length than that of the smallest card id. Lengths that 4 does not divide give parts of nearly equal
    length. Components beyond ``largest`` (131,072 before scaling for 64 components) are set to it, so that all
    sums fit in 64 bits. Null card ids come last, equal ids by their window; repeated rows each count and
    get the same code. With fewer than 256 cards the codebook is smaller. An empty table gives no codes and no
    entries. Columns named ``codes`` or ``error`` are replaced; other names cannot clash.
    """
    spark = windows.sparkSession
    ensure_checkpoint_dir(spark)
    others = [c for c in windows.columns if c not in (window, "codes", "error")]
    value = F.col(f"`{window}`").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = windows.select(F.struct(F.lit(True).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(f"`{card_id}`").alias("card"), value.alias("v")).filter(value.isNotNull() & finite)
    smallest = lambda rows: [r.v for r in rows.orderBy(F.col("card").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    first = smallest(valid)
    length = len(first[0]) if first else 0
    fixed = valid.filter(F.size("v") == length)
    if any(len(v) != length for v in first):
        first = smallest(fixed)
    bounds = part_bounds(length)
    kind = valid.schema["row"].dataType.simpleString()
    start = _whole(np.array(first, np.float64).reshape(len(first), length), length).astype(np.int64)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]

    rows = fixed.select("row", "v").mapInArrow(_integers(length), f"row {kind}, parts binary").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    if not first:
        return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)], F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), _books_frame(spark, [])
    found = {r.at: (r.low, r.high) for r in rows.select("parts").mapInArrow(_ranges(length), "at int, low int, high int").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low, high = (np.array([found[i][k] for i in range(length)], np.int64) for k in (0, 1))
    keyed = rows.select("id", "parts").mapInArrow(_keyed(length, low, high), "part int, curve binary, id long, cells binary")
    order = ["part", "curve", F.xxhash64("id")]
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "id", "cells").mapInArrow(_blocked(length), "part int, n int, low binary, high binary, total binary, ids binary, cells binary").checkpoint()
    for _ in range(ROUNDS):
        sums = blocks.mapInArrow(_summed(books), "part int, entry int, at int, n long, total long").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in sums.collect():
            books[r.part][r.entry, r.at] = r.total // r.n
    at_part = lambda p: F.max(F.when(F.col("part") == p, F.col("code")))
    coded = blocks.mapInArrow(_coded(books), "id long, part int, code int, error long").groupBy("id").agg(F.array(*[at_part(p) for p in range(PARTS)]).alias("codes"), F.sum("error").alias("error"))
    codes = rows.select("id", "row").join(coded, "id").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)], "codes", "error")
    return codes, _books_frame(spark, books)


def decoded(codes: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``codes`` with ``decoded``, the window that the codes stand for; a code names at most 1,024 entries, so these are broadcast."""
    books = codebooks.groupBy(F.lit(1).alias("all")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("part", "entry"), "components"))).alias("book"))
    found = F.flatten(F.transform("codes", lambda c, i: F.element_at("book", F.struct(i.alias("part"), c.alias("entry")))))
    return codes.withColumn("all", F.lit(1)).join(F.broadcast(books), "all").withColumn("decoded", F.transform(found, lambda x: x / SCALE)).drop("all", "book")


def with_group_error(codes: DataFrame, group: str, card_id: str = "card_id", salts: int = 32) -> DataFrame:
    """``codes`` with ``group_error``, the errors summed over rows with an equal ``group``, nulls together.

    Sums are made in every task first and are given back by (group, salt), so that a group with a third
    of all rows is read by many tasks.
    """
    mark = F.coalesce(F.to_json(F.struct(F.col(f"`{group}`").alias("g"))), F.lit(""))
    keyed = codes.withColumn("_mark", mark)
    sums = keyed.groupBy("_mark").agg(F.sum("error").alias("group_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{card_id}`"), "codes"), F.lit(salts)).cast("int"))
    return salted.join(sums, ["_mark", "_salt"]).drop("_mark", "_salt")
