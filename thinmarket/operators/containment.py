"""Which texts contain which names: short names looked up whole, longer ones by their rarest run of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the longest run, how many texts may hold a run before they are dealt out, into how many
#: parts, and how many distinct runs of all names are sent to every task instead of shuffling the texts' runs.
RUN, HOT, PARTS, SENT = 8, 1000, 64, 500_000
#: Names that may share a run before the texts that hold it are counted.
SHARED = 16


def _name_runs(name: Column) -> Column:
    """The name's runs of ``RUN`` letters; a shorter name is its only run."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (RUN - 1), F.lit(1))), lambda i: F.substring(name, i, RUN)))


def containing(texts: DataFrame, names: DataFrame, text: str = "low", name: str = "base", hot: int = HOT, sent: int = SENT) -> DataFrame:
    """(text, name): every distinct text with each distinct name that it contains.

    A name of up to ``RUN`` letters is in the texts that have it as a run. A longer name is looked up by
    that of its runs which the fewest names share, and what is found is compared letter by letter. Where
    names are so alike that some run is shared by more than ``SHARED`` of them at best, or too many to be
    sent, the run that the fewest texts hold is taken; if one is in no text the name is done. Texts give runs only of lengths that names ask for. Up to
    ``sent`` distinct runs (counted first) go to every task. With more, the texts' runs are shuffled, and
    those of a run in more than ``hot`` texts are dealt out. Null and empty names are in no text.
    """
    rows = texts.select(F.col(text).alias("_text")).filter(F.length("_text") > 0).distinct()
    asked = names.select(F.col(name).alias("_name")).filter(F.length("_name") > 0).distinct()
    by_run = asked.select("_name", F.explode(_name_runs(F.col("_name"))).alias("_run"))
    runs = by_run.select("_run").distinct()
    few = runs.limit(sent + 1).count() <= sent
    small = F.broadcast if few else lambda df: df

    # At most RUN lengths.
    lengths = F.broadcast(runs.select(F.length("_run").alias("_k")).distinct())
    places = rows.join(lengths, F.col("_k") <= F.length("_text")).select("_text", "_k", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_k") + 1)).alias("_at"))
    index = places.select("_text", "_at", F.substring("_text", F.col("_at"), F.col("_k")).alias("_run"))
    # A run counts where it first stands, so once in a text.
    first = F.col("_at") == F.instr(F.col("_text"), F.col("_run"))

    def rarest(counted: DataFrame) -> DataFrame:
        least = by_run.join(counted, "_run", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_run").alias("run"))).alias("_least"))
        return least.filter("_least.n > 0").select("_name", F.col("_least.run").alias("_run"), F.col("_least.n").alias("_n"))

    lookup = rarest(by_run.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")))
    if not few or lookup.filter(F.col("_n") > SHARED).limit(1).count():
        lookup = rarest(index.join(small(runs), "_run").filter(first).groupBy("_run").agg(F.count(F.lit(1)).alias("_n")))
    if few:
        found = index.join(small(lookup), "_run")
    else:
        part = F.pmod(F.xxhash64("_text"), F.lit(PARTS)).cast("int")
        dealt = lookup.filter(F.col("_n") > hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        found = index.join(lookup.filter(F.col("_n") <= hot), "_run").select("_text", "_name", "_at", "_run").unionByName(
            index.withColumn("_part", part).join(dealt, ["_run", "_part"]).select("_text", "_name", "_at", "_run")
        )
    return found.filter(first & F.contains(F.col("_text"), F.col("_name"))).select(F.col("_text").alias(text), F.col("_name").alias(name))
