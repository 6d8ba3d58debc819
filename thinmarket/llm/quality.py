"""Rule ledger: every rule judged once per article, kept as bits; policies are masks over the bits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.llm.rows import packed, unpacked

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile("[#*$%&|<>]")
LETTER = re.compile("[A-Za-z\x80-\U0010ffff]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bare_words")

#: Name of each rule and when it fails. The place in the list is the bit; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("few_letters", "100 * n_bare_words > 30 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
)
#: Versions of the policy; each names the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeats_itself"),
    "v1": ("too_short", "repeats_itself", "symbol_heavy", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(body: str | None) -> tuple[int, ...]:
    """The measurements of one text in the order of ``MEASURES``; a missing text has no words."""
    body = body or ""
    words = WORD.findall(body)
    lines = [line for line in body.split("\n") if WORD.search(line)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = 0
    if len(seen) < len(words) - 2:
        end = 0
        for i, run in enumerate(zip(words, words[1:], words[2:])):
            if seen[run] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words), sum(map(len, words)), len(SYMBOL.findall(body)), len(lines), len(lines) - len(set(lines)), covered,
        sum(LETTER.search(w) is None for w in words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(measure(x.as_py()) for x in batch.column(1)))) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["key", *MEASURES])


def rule_ledger(articles: DataFrame, article_id: str = "article_id", body: str = "body") -> DataFrame:
    """One row per article: its id, all measurements and ``fail_bits``, bit i set if rule i fails.

    Works on scraped articles and any other text, such as insight messages. A null or empty body has
    no words, so it fails ``too_short`` and no share rule. Null and repeated ids and repeated rows are
    judged row by row; other columns are ignored, so their names cannot clash. An empty table gives
    an empty ledger. The whole text counts, however long.
    """
    rows = articles.select(F.col(article_id).alias("key"), F.col(body).cast("string").alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits.cast("long")).withColumnRenamed("key", article_id)


def kept(policy: str, fail_bits: str = "fail_bits") -> Column:
    """Whether a policy keeps the row: none of its rules has failed."""
    return F.col(fail_bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: rejected rows, and rows that only this rule rejects.

    The ledger is first counted by its bits, so at most 2**rules rows go on; no text is read again.
    """
    used = F.lit(mask(policy)).cast("long")
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(used).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"),
    )


def only_rule(policy: str, fail_bits: str = "fail_bits") -> Column:
    """The rule that alone rejects the row under a policy; null where none or several do."""
    used = F.col(fail_bits).bitwiseAND(F.lit(mask(policy)).cast("long"))
    return F.coalesce(*[F.when(used == 1 << i, name) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]])


def _judge(bodies: pa.Array) -> pa.Array:
    """The measurements of each text, one text in hand at a time."""
    rows = list(zip(*(measure(x.as_py()) for x in bodies))) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in rows], list(MEASURES))


def keep_articles(articles: DataFrame, policy: str, body: str = "body") -> DataFrame:
    """The articles that a policy keeps, with all their columns, in one pass without a shuffle.

    Only the body goes to Python and only numbers come back; the rows wait in the JVM.
    """
    measured = F.arrow_udf(_judge, "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")(F.col(f"`{body}`").cast("string"))
    row = articles.select(packed(articles), measured.alias("m")).select("row", "m.*")
    wanted = [test for name, test in RULES if name in POLICIES[policy]]
    return row.filter(" AND ".join(f"NOT ({test})" for test in wanted)).select(*unpacked(articles.columns))
