"""Secrets in articles, told apart by how many owners and repositories hold the same value."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Independent samples of a text's words by which near-equal texts are known.
SAMPLES = (21, 22, 23, 24)


class Kind(NamedTuple):
    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: In the order in which spans that begin alike are listed. ``least`` are the characters of the group.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26, False),
    Kind("login", r"://[^\x00-\x20:/@]+:([^\x00-\x20:/@]+)@", 1, 4, False),
    Kind("prefixed", r"(?:gh[pousr]_|sk_live_|xox[abprs]-)[A-Za-z0-9-]+", 0, 20, False),
)


def candidates(text: Column, kind: Kind) -> Column:
    """Array of (start, kind, end, value) of a kind's matches, in code points, end exclusive."""
    whole, value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    between = F.split(text, kind.pattern, -1)  # one more than matches
    told = F.arrays_zip(F.transform(between, F.length).alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= kind.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(kind.pattern), F.aggregate(told, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])).otherwise(none)


def sampled(text: Column) -> Column:
    """Array of (sample, key): by each of ``SAMPLES`` the least hash of three neighbouring words.

    Two texts share a key with the chance of their Jaccard similarity, so mirrored ones share some.
    """
    held = lambda x, use: F.get(F.transform(F.array(x), use), 0)  # noqa: E731  # x is worked out once, not at each use
    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), lambda w: F.xxhash64(w))
    runs = held(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(h, i + 1, 3))))
    least = lambda r, s: F.array_min(F.transform(r, lambda x: F.xxhash64(x, F.lit(s))))
    return held(runs, lambda r: F.array(*[F.struct(F.lit(s), least(r, s)) for s in SAMPLES])).cast("array<struct<sample: int, key: bigint>>")


def spread_of(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every value; found has hash, owner, repository and samples.

    Texts that share a key count for the owner and repository that are first among them only. Each
    sample gives a count; the least holds, as near-equal texts may differ in some samples.
    """
    texts = found.select("hash", "owner", "repository", F.explode("samples").alias("s")).groupBy("hash", "s.sample", "s.key").agg(F.min(F.struct("owner", "repository")).alias("by"))
    counted = texts.groupBy("hash", "sample").agg(F.count_distinct("by.owner").alias("owners"), F.count_distinct("by.repository").alias("repositories"))
    return counted.groupBy("hash").agg(F.min("owners").alias("owners"), F.min("repositories").alias("repositories"))


def find_secrets(articles: DataFrame, article_id: str = "article_id", body: str = "body", owner: str = "source", repository: tuple[str, ...] = ("article_id",), live_owners: int = 1, live_repositories: int = 3) -> DataFrame:
    """Per article: base_spans, spans (arrays of kind:start:end), n_assign, n_access, n_hex, n_live, n_examples.

    The project has no repositories, so an article's ``owner`` is its source and its repository the
    columns ``repository``, by default the article; any other columns may be named. Base kinds are
    always reported. All candidates of the corpus are hashed by value and counted by distinct owners
    and repositories; near-equal texts, as mirrored articles are, count once. A value with at most
    ``live_owners`` owners and ``live_repositories`` repositories is specific to them and counts as
    live, others are examples that many copy. Candidates of the further kinds (web tokens, logins in
    links, prefixed keys) become spans only if they are live.

    A null body is empty. A null owner or repository is one of its own. Rows equal in all columns used
    share their result; null and repeated ids are kept. Spans are ordered by start, then kind. Empty
    tables give none; other columns are ignored. Values never leave as text: only hashes are shuffled.
    """
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    held = F.to_json(F.struct(*[F.col(c) for c in repository]))
    who = F.to_json(F.struct(F.col(owner)))
    rows = articles.select(F.col(article_id).alias("id"), text.alias("text"), who.alias("owner"), held.alias("repository"))
    rows = rows.withColumns({"k1": F.xxhash64("id", "text", "owner", "repository"), "k2": F.xxhash64(F.lit("second"), "repository", "owner", "text", "id")})
    every = F.concat(*[candidates(F.col("text"), k) for k in KINDS])
    listed = rows.select("k1", "k2", "owner", "repository", sampled(F.col("text")).alias("samples"), every.alias("every")).filter(F.size("every") > 0)
    found = listed.select("k1", "k2", "owner", "repository", "samples", F.explode("every").alias("c")).select("k1", "k2", "owner", "repository", "samples", "c.start", "c.kind", "c.end", F.unhex(F.sha2(F.col("c.value").cast("binary"), 256)).alias("hash"))
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    base = F.array_contains(F.lit([KINDS.index(k) for k in KINDS if k.base]), F.col("kind"))
    marked = found.drop("samples").join(spread_of(found), "hash").select("k1", "k2", F.struct("start", "kind", "end", live.alias("live"), base.alias("base")).alias("s"))
    mine = marked.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("all"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    shown = lambda a: F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    every = F.coalesce("all", F.array().cast(marked.groupBy().agg(F.collect_set("s").alias("x")).schema["x"].dataType))
    count = lambda test: F.size(F.filter(every, test)).cast("long")
    of_kind = lambda i: count(lambda s: s["kind"] == i)
    return rows.select("id", "k1", "k2").join(mine, ["k1", "k2"], "left").select(
        F.col("id").alias(article_id), *[of_kind(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        shown(F.filter(every, lambda s: s["base"])).alias("base_spans"), shown(F.filter(every, lambda s: s["base"] | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_examples"),
    )
