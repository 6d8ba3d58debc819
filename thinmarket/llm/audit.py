"""Filter interaction audit: what every order of the article filters keeps, removes and makes redundant."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.llm.rows import text_key

#: Filters by bit: A too few words, B few distinct words, C many capitals, D symbols, E a copy of an earlier article.
FILTERS = "ABCDE"
COPY_BIT = FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_bits(body: Column) -> Column:
    """Bits of the filters A to D, set where the text fails; the whole text is read once."""
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long") > 5 * F.length(body).cast("long"), body.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_cells(articles: DataFrame, labels: DataFrame, article_id: str = "article_id", body: str = "body", source: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(source, mask, n, good, toxic): articles by source and by the set of filters that they fail.

    Texts leave the scan as 128-bit keys. Copies are counted by (text, source, labels) before they meet by
    text, so a text that a third of all articles share is summed in every task first.
    """
    text = F.coalesce(F.col(f"`{body}`").cast("string"), F.lit(""))
    rows = articles.select(F.col(f"`{article_id}`").alias("id"), text_key(text).alias("key"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), text_bits(text).alias("bits"))
    told = labels.groupBy(F.col(f"`{article_id}`").alias("id")).agg(
        F.max((F.col(f"`{quality}`") == 1).cast("int")).alias("good"), F.max((F.col(f"`{toxic}`") == 1).cast("int")).alias("toxic"),
    )
    known = lambda c: F.coalesce(c, F.lit(0))
    group = ["key", "source", "bits", "good", "toxic"]
    each = rows.join(told, "id", "left").select("id", "key", "source", "bits", known(F.col("good")).alias("good"), known(F.col("toxic")).alias("toxic"))
    by_id = each.groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    copies = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    earliest = copies.groupBy("key").agg(F.min("low.id").alias("first"))
    stay = F.col("nameless") + F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = F.array(F.struct(F.col("bits").alias("mask"), stay.alias("n")), F.struct(F.col("bits").bitwiseOR(1 << COPY_BIT).alias("mask"), (F.col("n") - stay).alias("n")))
    cells = copies.join(earliest, "key").select("source", "good", "toxic", F.explode(both).alias("c")).filter("c.n > 0")
    return cells.groupBy("source", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def _orders() -> str:
    """The order array: a literal of all orders, each with its name and the bits in turn; it travels with the plan to every task."""
    return "array(" + ", ".join(f"struct('{''.join(o)}' AS name, array({', '.join(str(FILTERS.index(f)) for f in o)}) AS bits)" for o in permutations(FILTERS)) + ")"


def _folded(cell: str) -> str:
    """SQL: one cell's 600 structs, an order after the other and in each a step after the other."""
    fails = f"(({cell}.mask & shiftleft(1, f)) <> 0)"
    counts = {
        "kept": f"if(acc.gone OR {fails}, 0L, {cell}.n)", "removed": f"if({fails} AND NOT acc.gone, {cell}.n, 0L)", "redundant": f"if({fails} AND acc.gone, {cell}.n, 0L)",
        "unique_fails": f"if({cell}.mask = shiftleft(1, f), {cell}.n, 0L)", "good_lost": f"if({fails} AND NOT acc.gone, {cell}.good, 0L)", "toxic_lost": f"if({fails} AND NOT acc.gone, {cell}.toxic, 0L)",
    }
    kind = ", ".join(f"{c}: BIGINT" for c in COUNTS)
    step = f"named_struct('gone', acc.gone OR {fails}, 'steps', concat(acc.steps, array(named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in counts.items())}))))"
    start = f"named_struct('gone', false, 'steps', cast(array() AS ARRAY<STRUCT<{kind}>>))"
    return f"flatten(transform(orders, o -> aggregate(o.bits, {start}, (acc, f) -> {step}, acc -> acc.steps)))"


def audit_filters(articles: DataFrame, labels: DataFrame, article_id: str = "article_id", body: str = "body", source: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per source, order of the five filters and step: what the step's filter does there.

    For scraped articles and reviewers' labels of them (article id, ``quality`` and ``toxic``, 1 or not). A
    filter fails an article: A under 50 words, B fewer than 65 distinct words of 100, C more than 5 capitals A-Z
    of 100 code points, D any of ``#$%&*|``, E a text that an article with a smaller id has, removed or not.
    Columns: ``source``, ``filter_order`` (five letters, applied left to right), ``step`` (1 to 5) and, as
    counts of articles, ``kept`` after the step, ``removed`` here, ``redundant`` (failing but removed before),
    ``unique_fails`` (failing this filter only), ``good_lost`` and ``toxic_lost`` (removed here with the label)
    and ``shapley`` (removed by this filter over all orders).

    Articles are first counted by source and mask of failed filters, at most 32 cells a source. Each cell
    folds across the array of the 120 orders to 600 weighted structs; a source's cells are summed element by
    element. So the folds depend on the number of sources only, and no group holds more than 32 rows.

    A null body is an empty text, a null source the empty one. An article without an id is no copy and
    makes none; articles with the same id and text are not copies of each other, each row counts. Of several labels of
    an article any 1 counts; without a label it is neither good nor toxic. Zeros are rows. Empty tables give
    no row; other columns are ignored.
    """
    cells = failure_cells(articles, labels, article_id, body, source, quality, toxic)
    grouped = cells.groupBy("source").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("orders", F.expr(_orders()))
    folded = grouped.select("source", "orders", F.expr(f"transform(cells, c -> {_folded('c')})").alias("folded"))
    sums = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    merged = folded.select("source", "orders", F.expr(f"aggregate(slice(folded, 2, size(folded)), folded[0], (a, b) -> zip_with(a, b, (x, y) -> named_struct({sums})))").alias("merged"))
    letter = "orders[cast(i DIV 5 AS INT)].bits[cast(i % 5 AS INT)]"
    by_filter = f"transform(sequence(0, 4), f -> aggregate(filter(merged, (m, i) -> {letter} = f), 0L, (acc, m) -> acc + m.removed))"
    rows = merged.select("source", "orders", F.expr(by_filter).alias("shares"), F.posexplode("merged").alias("i", "m"))
    return rows.select(
        "source", F.expr("orders[cast(i DIV 5 AS INT)].name").alias("filter_order"), F.expr("cast(i % 5 + 1 AS INT)").alias("step"), *[F.col(f"m.{c}") for c in COUNTS], F.expr(f"shares[{letter}]").alias("shapley"),
    )
