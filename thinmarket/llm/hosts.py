"""URL verdicts: rules first, then trust and distrust that flow along the links between hosts."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinmarket.session import ensure_checkpoint_dir

DAMPING, TOLERANCE, BLOCK_FROM = 0.85, 1e-10, 0.02
#: What a mass of one takes to fall below the tolerance; how many a plain iteration needs, no limit here.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
SALT = 32
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or if there is no ``://``."""
    after = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(name, verdict) of the longest rule whose host is this or above it and whose path begins this one."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    if not fits:
        return F.lit(None).cast("struct<size: int, name: string, verdict: string>")
    return F.array_max(F.array(*fits)) if len(fits) > 1 else fits[0]


def host_scores(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from pages with host, html and the verdict of their rule.

    Trust is PageRank restarted at hosts with allowed pages and flows along links; distrust restarts
    at hosts with blocked pages and flows against them, to whoever links there. A host's seed is the
    share of its pages so judged; an edge between two hosts counts once, and a host's flow is dealt
    evenly over its edges. Links within a host do not count.

    Each round sends on what the round before added. It goes on until all that is still to come, summed
    over the hosts, is at most ``tolerance``; no score is further from the limit. What is sent shrinks
    by ``damping`` at least, so this ends.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    share = lambda v: F.avg(F.coalesce((F.col("verdict") == v).cast("double"), F.lit(0.0)))
    seeds = pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    link = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))))
    edges = pages.filter("host <> ''").select("host", link.alias("to")).select("host", F.translate("to", UPPER, LOWER).alias("to")).filter("`to` <> '' AND `to` <> host").distinct().checkpoint()
    named = lambda kind: F.lit(kind).alias("kind")
    seed = seeds.select("host", named("trust"), F.col("trust").alias("seed")).unionAll(seeds.select("host", named("distrust"), F.col("distrust").alias("seed"))).filter("seed > 0").checkpoint()
    if edges.isEmpty():
        scores = seed.withColumn("score", F.col("seed") * (1 - damping))
    else:
        flow = edges.select(F.col("host").alias("at"), F.col("to"), named("trust")).unionAll(edges.select(F.col("to").alias("at"), F.col("host").alias("to"), named("distrust")))
        flow = flow.join(flow.groupBy("at", "kind").agg(F.count(F.lit(1)).alias("ways")), ["at", "kind"]).checkpoint()
        scores = seed.select("host", "kind", F.lit(0.0).alias("score"), (F.col("seed") * (1 - damping)).alias("added"))
        left = scores.agg(F.sum("added")).first()[0] or 0.0
        while left * damping > tolerance * (1 - damping):
            sent = flow.join(scores.filter("added > 0").select(F.col("host").alias("at"), "kind", "added"), ["at", "kind"]).select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("score"), (damping * F.col("added") / F.col("ways")).alias("added"))
            held = scores.select("host", "kind", (F.col("score") + F.col("added")).alias("score"), F.lit(0.0).alias("added"))
            scores = sent.unionAll(held).groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("added").alias("added")).checkpoint()
            left = scores.agg(F.sum("added")).first()[0]
        scores = scores.select("host", "kind", (F.col("score") + F.col("added")).alias("score"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge_pages(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", block_from: float = BLOCK_FROM) -> DataFrame:
    """Verdict of every scraped page: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Other pages follow their host: blocked if its distrust is at
    least ``block_from`` and more than its trust, else allowed; so pages of unknown hosts, and pages
    without a host, are allowed.

    A null url, or one without ``://``, has an empty host and path. Null html has no links. Ids may be
    null or repeat: each row is judged. Empty tables give none; other columns are ignored. Only
    built-in expressions run; a host with a third of all pages or links is summed before it is
    shuffled, and its pages meet its score in ``SALT`` places.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    scores = host_scores(rows.select("host", "html", F.col("r.verdict").alias("verdict")))
    # A host may have a third of all pages: its rows go to SALT places, each with a copy of the host's one score row.
    scores = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.drop("html").withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALT)).cast("int"))
    told = F.when((F.col("distrust") >= block_from) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return rows.join(scores, ["host", "salt"], "left").select(
        F.col("id").alias(page_id), "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), told).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
