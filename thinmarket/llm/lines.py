"""Removal of line passages that the corpus repeats: content-defined chunks as anchors, then the lines around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.llm.rows import stored

#: (lines of the rolling window, divisor): a line at which the hash over the window meets the divisor is a boundary.
CHUNKINGS = ((1, 2), (2, 4))
#: A long line, one of this many characters, is an anchor by itself unless these bits of its hash are all set (one in 16).
LONG_LINE, LONE_BITS = 20, 15
#: Lines around anchors that are compared as well, and the least passage that goes: lines with words, and their characters.
REACH, LEAST_LINES, LEAST_CHARS = 8, 2, 150


def _keyed(articles: DataFrame, article_id: str, body: str) -> DataFrame:
    """(k1, k2, id, body, rest): 128 never-null bits of the row, and all its columns.

    The comparison and the removal both read all of these, so their exchange by key is made once.
    """
    i, b = F.col(f"`{article_id}`"), F.col(f"`{body}`").cast("string")
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(articles.columns) if c != body], F.lit(True).alias("any"))
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in articles.schema.fields]
    marks = [F.isnull(f"`{c}`") for c in articles.columns]
    return articles.select(F.xxhash64(*plain, *marks).alias("k1"), F.xxhash64(F.lit("second"), *marks, *plain[::-1]).alias("k2"), i.alias("id"), b.alias("body"), rest.alias("rest"))


def _hashed(keyed: DataFrame) -> DataFrame:
    """(id, k1, k2, h, chars) of articles with several lines: each line's hash, and its characters if it has words, else 0."""
    lines = F.split("body", "\n")
    chars = F.transform(lines, lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.length(x)).otherwise(0))
    return keyed.filter(F.col("body").contains("\n") & (F.length("body") >= LEAST_CHARS)).select("id", "k1", "k2", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), chars.alias("chars"))


def _chunks(h: Column, window: int, divisor: int) -> Column:
    """(start, n, hash) of the lines from one boundary's window to the next boundary.

    A boundary depends on the lines of its window only, so a chunk is the same wherever its lines stand.
    """
    rolled = h if window == 1 else F.transform(h, lambda x, i: F.when(i >= window - 1, F.xxhash64(F.slice(h, i - (window - 2), window))))
    at = F.filter(F.transform(rolled, lambda r, i: F.when(F.pmod(r, F.lit(divisor)) == 0, i)), lambda i: i.isNotNull())
    pairs = F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.struct((a - (window - 1)).alias("start"), (b - a + window).alias("n")))
    whole = F.filter(pairs, lambda c: c["n"].isNotNull())
    return F.transform(whole, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(F.slice(h, c["start"] + 1, c["n"])).alias("hash")))


def anchors(hashed: DataFrame) -> DataFrame:
    """(hash, here) of the content-defined chunks and of long lines; ``here`` orders places by id, key and line."""
    h, chars = F.col("h"), F.col("chars")
    lone = F.filter(F.transform(h, lambda x, i: F.struct(i.alias("start"), F.lit(1).alias("n"), x.alias("hash"))), lambda c: (F.get(chars, c["start"]) >= LONG_LINE) & (c["hash"].bitwiseAND(F.lit(LONE_BITS)) != LONE_BITS))
    found = hashed.select("id", "k1", "k2", F.explode(F.concat(lone, *[_chunks(h, w, d) for w, d in CHUNKINGS])).alias("c"))
    return found.select("c.hash", F.struct("id", "k1", "k2", "c.start", "c.n").alias("here"))


def _runs(own: Column, other: Column, chars: Column) -> Column:
    """(start, n) of the longest runs of equal lines with enough lines and characters; the arrays are as long."""
    same = F.zip_with(own, other, lambda a, b: a == b)
    first = F.filter(F.transform(same, lambda e, i: F.when(e & ~F.coalesce(F.get(same, i - 1), F.lit(False)), i)), lambda i: i.isNotNull())
    last = F.filter(F.transform(same, lambda e, i: F.when(e & ~F.coalesce(F.get(same, i + 1), F.lit(False)), i)), lambda i: i.isNotNull())
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))
    total = lambda r: F.aggregate(F.slice(chars, r["start"] + 1, r["n"]), F.lit(0), lambda t, c: t + c)
    full = lambda r: F.size(F.filter(F.slice(chars, r["start"] + 1, r["n"]), lambda c: c > 0))
    return F.filter(runs, lambda r: (total(r) >= LEAST_CHARS) & (full(r) >= LEAST_LINES))


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """(k1, k2, start, n, bytes) of passages that, by their hashes, stand earlier in the corpus as well.

    Earlier means a smaller (id, k1, k2, start); a null id is the smallest. ``bytes`` are the lines of the
    earlier place, for the comparison that decides. Until then only hashes move.
    """
    hashed = stored(_hashed(keyed))
    found = anchors(hashed)
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min("here").alias("first")).filter("times > 1").select("hash", "first")
    later = found.join(often, "hash").filter(F.col("here") != F.col("first"))
    # Anchors of one article that lead to one place of another are one stretch.
    shift = (F.col("first.start") - F.col("here.start")).alias("shift")
    stretch = later.groupBy(F.col("here.k1").alias("k1"), F.col("here.k2").alias("k2"), F.col("first.k1").alias("a1"), F.col("first.k2").alias("a2"), shift).agg(
        F.min("here.start").alias("low"), F.max(F.col("here.start") + F.col("here.n")).alias("high"),
    )
    low = F.greatest(F.col("low") - REACH, F.lit(0), -F.col("shift"))
    stretch = stretch.select("k1", "k2", "a1", "a2", "shift", low.alias("low"), (F.col("high") + REACH - low).alias("n"))
    there = hashed.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("h").alias("ah"))
    sent = stretch.join(there, ["a1", "a2"]).select("k1", "k2", "a1", "a2", "shift", "low", F.slice("ah", F.col("low") + F.col("shift") + 1, F.col("n")).alias("ah"))
    n = F.least(F.size("ah"), F.size("h") - F.col("low"))
    cut = lambda c, at: F.slice(c, at, n)
    runs = sent.join(hashed.select("k1", "k2", "h", "chars"), ["k1", "k2"]).select("k1", "k2", "a1", "a2", "shift", "low", F.explode(_runs(cut("h", F.col("low") + 1), cut("ah", F.lit(1)), cut("chars", F.col("low") + 1))).alias("r"))
    start = F.col("low") + F.col("r.start")
    runs = runs.select("k1", "k2", "a1", "a2", start.alias("start"), (start + F.col("shift")).alias("at"), F.col("r.n").alias("n"))

    firsts = runs.groupBy("a1", "a2").agg(F.collect_set(F.struct("at", "n")).alias("firsts")).withColumnsRenamed({"a1": "k1", "a2": "k2"})
    # The condition on both sides holds for every row; it keeps all columns, so that the exchange is shared.
    whole = F.length(F.to_json("rest")) + F.size("firsts") > 0
    told = keyed.join(firsts, ["k1", "k2"]).filter(whole).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.split("body", "\n").alias("lines"), F.explode("firsts").alias("c"))
    told = told.select("a1", "a2", "c.at", "c.n", F.array_join(F.slice("lines", F.col("c.at") + 1, F.col("c.n")), "\n").alias("bytes"))
    told = told.groupBy("a1", "a2", "at", "n").agg(F.first("bytes").alias("bytes"))
    return runs.join(told, ["a1", "a2", "at", "n"]).select("k1", "k2", "start", "n", "bytes")


def drop_repeated_lines(articles: DataFrame, article_id: str = "article_id", body: str = "body") -> DataFrame:
    """Articles without the multi-line passages that stand earlier in the corpus.

    Lines are what ``\\n`` separates. A hash rolls over the lines' hashes; where it meets a divisor there is a
    boundary, so chunks depend on their own lines only and do not shift with what stands around them. Chunks,
    and most lines of 20 characters or more, are anchors. An anchor whose hash stands earlier in the corpus is
    extended line by line both ways, and what results is removed if it has at least ``LEAST_LINES`` lines with
    words and ``LEAST_CHARS`` characters in these and its bytes equal those of the earlier place. So every line
    keeps its first copy in the corpus, and what ordinary texts share, such as closing brackets or the
    head of a small table, stays. Blank lines belong to a passage if they are equal to the byte.

    All columns return, ``body`` without the removed lines, and ``n_removed_lines`` (long) is added or
    replaced. Every article stays, even if its body becomes empty. A null body stays null; empty
    bodies and empty tables pass. Single repeated lines stay. Inside one article a passage is repeated as in two. Rows equal in all
    columns count as one article and get the same result; a null id is the smallest id. Only built-in
    expressions run. Joins are on hashes, so a passage that a third of all articles share is split by the
    engine's handling of skewed joins and summed before shuffles; an article's stretches that lead to one place
    travel as one. A passage whose hashes equal another's by chance only is never removed.

    A passage can be missed if none of its anchors has its first place in the passage's first copy, such as two
    lines of which the long one stands alone in an earlier article; the README has measured shares.
    """
    keyed = _keyed(articles, article_id, body)
    gone = repeated_passages(keyed).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "bytes")).alias("spans"))
    lines, left = F.col("lines"), F.col("left")
    joined = keyed.join(gone, ["k1", "k2"], "left").select("body", "rest", F.when(F.col("spans").isNotNull(), F.split("body", "\n")).alias("lines"), "spans")
    equal = F.filter("spans", lambda s: F.array_join(F.slice("lines", s["start"] + 1, s["n"]), "\n") == s["bytes"])
    places = F.flatten(F.transform(equal, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    joined = joined.select("body", "rest", "lines", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places).alias("left"))
    text = F.when(left.isNull(), F.col("body")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(left.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long")
    columns = [text.alias(c) if c == body else F.col(f"rest.c{n}").alias(c) for n, c in enumerate(articles.columns) if c != "n_removed_lines"]
    return joined.select(*columns, removed.alias("n_removed_lines"))
