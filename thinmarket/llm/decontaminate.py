"""Benchmark passages in articles: a prefix-filtered join with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.llm.rows import packed, row_key, unpacked
from thinmarket.llm.text import ALNUM, Words, chunks, windows
from thinmarket.session import ensure_checkpoint_dir

#: Words of a window, words of a token (a shingle of a window), and bits of the token filter.
WINDOW, TOKEN, FILTER_BITS = 10, 3, 1 << 24
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _word_lists(texts: pa.Array, token_size: int = TOKEN) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """(from row, to row, words, token hashes, token bounds) of lower-cased texts, some rows at a time."""
    for i, j, data, bounds in chunks(texts):
        words = Words(LOWER[data], bounds, ALNUM)
        yield i, j, words, *windows(words.hashes(), words.first, token_size)


def _joined(words: Words, a: int, b: int) -> str:
    return b" ".join(words.word(k) for k in range(a, b)).decode("utf-8", "replace")


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each item with the hash and place of each of its tokens."""
    for batch in batches:
        ids = batch.column(0)
        out: dict[str, list] = {"item_id": [], "words": [], "size": [], "token": [], "offset": []}
        for i, j, words, tokens, bounds in _word_lists(batch.column(1)):
            for row in range(j - i):
                a, b = int(words.first[row]), int(words.first[row + 1])
                size = min(WINDOW, b - a)
                for start in range(a, b - size + 1) if size else ():
                    text = _joined(words, start, start + size)
                    for k in range(max(1, size - TOKEN + 1)):
                        for name, value in zip(out, (ids[i + row].as_py(), text, size, int(tokens[bounds[row] + start - a + k].astype(np.int64)), k)):
                            out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], ids.type), pa.array(out["words"], pa.string()), *(pa.array(out[n], pa.int64()) for n in ("size", "token", "offset"))], list(out))


def _bits(tokens: np.ndarray, n_bits: int) -> np.ndarray:
    return (tokens.astype(np.uint64) & np.uint64(n_bits - 1)).astype(np.int64)


def token_filter(tokens: DataFrame, n_bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the tokens, OR-ed by Spark: at most ``n_bits / 8`` bytes, however many tokens there are."""
    bits = tokens.select(F.expr(f"token & {n_bits - 1}").alias("bit"))
    found = bits.groupBy(F.expr("shiftright(bit, 5)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("bits")).toPandas()
    out = np.zeros(n_bits // 32, np.uint32)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, sizes = shared.value
        for batch in batches:
            seen = [t[full[_bits(t, len(full))]] for size in sizes for _, _, _, t, _ in _word_lists(batch.column(0), size)]
            token, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _prober(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, sizes = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            rows, found = [], []
            for size in sizes:
                for i, j, words, tokens, bounds in _word_lists(batch.column("body"), size):
                    n_words[i:j] = np.diff(words.first)
                    for k in np.flatnonzero(full[_bits(tokens, len(full))]):
                        row = int(np.searchsorted(bounds, k, "right")) - 1
                        first, last = int(words.first[row]), int(words.first[row + 1])
                        place = first + int(k - bounds[row])
                        a, b = max(first, place - WINDOW + 1), min(last, place + WINDOW)
                        rows.append(i + row)
                        found.append((place - first, int(tokens[k].astype(np.int64)), place - a, _joined(words, a, b)))
            order = np.argsort(np.array(rows, np.int64), kind="stable")
            at, token, back, context = zip(*[found[k] for k in order]) if found else ([], [], [], [])
            rows = np.sort(np.array(rows, np.int64))
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(token, pa.int64()), pa.array(back, pa.int32()), pa.array(context, pa.string())], ["at", "token", "back", "context"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(bounds), hits)],
                ["id", "key", "n_words", "hits"],
            )

    return run


def _occurrences(articles: DataFrame, benchmark: DataFrame, article_id: str, body: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of the items, all articles with their word counts, and (key, start, size, words) of each occurrence."""
    spark = articles.sparkSession
    ensure_checkpoint_dir(spark)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    # Narrow and read several times; every item's windows, whatever their number.
    of_items = items.mapInArrow(_item_windows, f"item_id {kind}, words string, size long, token long, offset long").checkpoint()
    sizes = [int(r.size) for r in of_items.select(F.least("size", F.lit(TOKEN)).alias("size")).distinct().collect()]  # of 1 to TOKEN
    full = spark.sparkContext.broadcast((token_filter(of_items.select("token")), sorted(sizes) or [TOKEN]))

    rows = articles.select(F.col(article_id).alias("id"), F.col(body).cast("string").alias("body"))
    counts = rows.select("body").mapInArrow(_counter(full), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    distinct = of_items.select("words", "size", "token", "offset").distinct()
    rarest = distinct.join(counts, "token").groupBy("words", "size").agg(F.min(F.struct("n", "token", "offset")).alias("p"))
    # A window one of whose tokens no article has cannot occur.
    needed = distinct.groupBy("words").agg(F.count_distinct("token").alias("of"))
    held = distinct.join(counts, "token", "left_semi").groupBy("words").agg(F.count_distinct("token").alias("of"))
    prefix = rarest.join(needed.join(held, ["words", "of"], "left_semi"), "words", "left_semi").select("words", "size", "p.token", "p.offset")

    id_kind = rows.schema["id"].dataType.simpleString()
    probed = rows.select("id", row_key(F.col("id"), F.col("body")).alias("key"), "body").mapInArrow(
        _prober(full), f"id {id_kind}, key binary, n_words long, hits array<struct<at: long, token: long, back: int, context: string>>"
    ).checkpoint()
    near = probed.select("key", F.explode("hits").alias("h")).select("key", "h.*").join(prefix, "token")
    begin, size = F.col("back") - F.col("offset"), F.col("size")
    around = F.split("context", " ")
    exact = near.filter((begin >= 0) & (begin + size <= F.size(around))).filter(F.array_join(F.slice(around, (begin + 1).cast("int"), size.cast("int")), " ") == F.col("words"))
    exact = exact.select("key", (F.col("at") - F.col("offset")).alias("start"), "size", "words").distinct()

    return of_items, probed, exact


def find_benchmark_passages(articles: DataFrame, benchmark: DataFrame, article_id: str = "article_id", body: str = "body", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark windows that occur in articles: n_words, n_hit, n_items, item_ids per article.

    The project has no benchmark records, so ``benchmark`` is any table of an id and a text; articles
    are scraped articles. Letters A-Z are lower-cased; words are runs of ASCII letters, digits and
    everything beyond ASCII. A window is 10 consecutive words of an item, or the whole item if it has
    fewer. ``n_hit`` counts the article's words inside any occurrence of any window.

    Method: a window's tokens are its three-word shingles (all its words if it has fewer). All articles are read once to count the
    benchmark's tokens and once to join: a window that occurs must hold its rarest token, so that
    prefix of one token is joined, the token's place in window and text bounds where the window can
    start and end, and the words of the candidate are compared one by one. The articles are read
    past a bitmap of tokens of fixed size; it admits too much at worst, never too little.

    Null texts have no words. Null ids are kept; a null item id counts as an item. Rows equal in id and
    text get the same result each. Items with equal windows count each. Empty tables give empty or
    all-clean results. Other columns are ignored. Item ids return sorted as strings.
    """
    of_items, probed, exact = _occurrences(articles, benchmark, article_id, body, item_id, item_text)
    spans = exact.groupBy("key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.coalesce(F.max("end").over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("new", F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", before))).groupBy("key").agg(F.sum("new").alias("n_hit"))
    named = exact.select("key", "words").distinct().join(of_items.select("words", "item_id").distinct(), "words").select("key", "item_id").distinct()
    named = named.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    zero = F.lit(0).cast("long")
    return probed.select("id", "key", "n_words").join(hit, "key", "left").join(named, "key", "left").select(
        F.col("id").alias(article_id), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean_articles(articles: DataFrame, benchmark: DataFrame, article_id: str = "article_id", body: str = "body", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Articles that hold no benchmark window, with all their columns; nulls and repeated rows as above."""
    _, _, exact = _occurrences(articles, benchmark, article_id, body, item_id, item_text)
    keyed = articles.select(packed(articles), row_key(F.col(f"`{article_id}`"), F.col(f"`{body}`")).alias("key"))
    return keyed.join(exact.select("key").distinct(), "key", "left_anti").select(*unpacked(articles.columns))
