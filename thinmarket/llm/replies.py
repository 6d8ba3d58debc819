"""Reply trees: the best-rated branches of each tree, each formatted as one conversation with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinmarket.llm.rows import text_key
from thinmarket.session import ensure_checkpoint_dir

#: The template. Each turn is ``<s>role\n`` and its text; only the assistant's text is learned from.
ASSISTANT = "assistant"
OPEN, CLOSE, ASK, ASKED = "<s>", "\n</s>", "[INST] ", " [/INST]"
CONTROL = r"</?s>|\[/?INST\]"
#: Turns that are joined to one text before the texts of a conversation meet.
SEGMENT = 256


def escaped(text: Column) -> Column:
    """A control string, with the backslashes before it, gets one backslash more."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+(?:{CONTROL}))", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+(?:{CONTROL}))", "$1")


def _role_in(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_replies(turns: DataFrame, run_id: str = "run_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """Recorded turns as messages of which each replies to the one before it: run_id, message_id, reply_to, role, content.

    Turns are ordered by run, turn, role and content, nulls first. The first of a run names the last of the
    run before, which is no message of its own run, so it begins a tree. Runs of any length are split: the
    order comes from ranges of all rows, and only one id a partition is compared across partitions.
    """
    ensure_checkpoint_dir(turns.sparkSession)
    order = [F.col("run_id"), F.col("turn"), F.col("role"), F.col("content")]
    rows = turns.select(F.col(f"`{run_id}`").alias("run_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{content}`").cast("string").alias("content"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("message_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("message_id", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.max("message_id").alias("last"))
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    joined = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.select("run_id", "message_id", F.when(F.col("message_id") == F.shiftleft("part", 33), F.col("before")).otherwise(F.col("message_id") - 1).alias("reply_to"), "role", "content")


def _nodes(messages: DataFrame, run_id: str, message_id: str, reply_to: str, role: str, content: str, score: str | None) -> DataFrame:
    """(key, parent, id, run, role, content, score), one row per message."""
    col = lambda c: F.col(f"`{c}`")
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    run = F.to_json(F.struct(col(run_id).alias("r")))
    own = F.coalesce(text_key(F.concat(run, F.lit("\x00"), col(message_id).cast("string"))), text_key(F.concat(run, F.lit("\x01"), text(role), F.lit("\x00"), text(content))))
    parent = F.when(col(reply_to) < col(message_id), text_key(F.concat(run, F.lit("\x00"), col(reply_to).cast("string"))))
    rated = F.coalesce(col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(own.alias("key"), parent.alias("parent"), col(message_id).alias("id"), col(run_id).alias("run"), text(role).alias("role"), text(content).alias("content"), rated.alias("score"))
    packed = F.struct("parent", "id", "run", "role", "content", "score")
    return rows.groupBy("key").agg(F.min_by(packed, F.struct("role", "content", "score", "parent")).alias("m")).select("key", "m.*")


def best_paths(nodes: DataFrame, best: int | None) -> DataFrame:
    """(leaf, key, depth, total): the messages of each chosen branch, the root at depth 0.

    Each round joins the table of jumps to itself and so doubles the jumps' length, until all have met
    their root; then the chosen leaves walk up by the same tables, the longest jumps first. A tree of
    depth d takes about 2 log2(d) joins, each on rows of a few bytes.
    """
    narrow = nodes.select("key", "parent", "id", "score")
    there = narrow.select(F.col("key").alias("up"), F.lit(True).alias("found"))
    none = F.lit(0).cast("long")
    state = narrow.withColumnRenamed("parent", "up").join(there, "up", "left").select(
        "key", F.when(F.col("found"), F.col("up")).alias("up"), F.coalesce(F.col("found").cast("long"), none).alias("steps"), F.col("score").alias("total"), "id", F.when(F.col("found").isNull(), F.col("key")).alias("top"),
    ).checkpoint()
    parents = state.select(F.col("up").alias("key")).filter("key IS NOT NULL").distinct()
    met, jumps = state.filter("up IS NULL"), []
    left = state.filter("up IS NOT NULL")
    while not left.isEmpty():  # only messages that have not met their root go on
        jumps.append(left.select("key", "up"))
        further = left.unionAll(met).select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"), F.col("top").alias("top2"))
        state = left.join(further, "up").select("key", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"), "id", F.col("top2").alias("top")).checkpoint()
        met, left = met.unionAll(state.filter("up IS NULL")), state.filter("up IS NOT NULL")
    leaves = met.join(parents, "key", "left_anti")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("top").orderBy(F.col("total").desc(), F.col("id").asc_nulls_last(), "key"))
        leaves = leaves.withColumn("rank", rank).filter(F.col("rank") <= best)
    paths = leaves.select(F.col("key").alias("leaf"), "key", F.col("steps").alias("depth"), "total").checkpoint()
    for k in reversed(range(len(jumps))):
        more = paths.join(jumps[k], "key").select("leaf", F.col("up").alias("key"), (F.col("depth") - (1 << k)).alias("depth"), "total")
        paths = paths.unionAll(more).checkpoint()
    return paths


def _piece(role: Column, content: Column) -> tuple[Column, Column]:
    """(text of the turn, where its content begins)."""
    learned, head = role == ASSISTANT, F.concat(F.lit(OPEN), _role_in(role), F.lit("\n"))
    text = F.when(learned, F.concat(head, content, F.lit(CLOSE))).otherwise(F.concat(head, F.lit(ASK), content, F.lit(ASKED + CLOSE)))
    return text, F.length(head)


def format_replies(messages: DataFrame, run_id: str = "run_id", message_id: str = "message_id", reply_to: str = "reply_to", role: str = "role", content: str = "content", score: str | None = None, best: int | None = 1) -> DataFrame:
    """The best branches of each reply tree of an agent's analyses, each as one conversation.

    Works on the messages of the market agent's runs (``role`` and ``content``, the tools' results among
    them); the project keeps neither reply ids nor ratings, so these are columns of the caller's. Columns:
    ``run_id``, ``leaf_id`` (the branch's last message), ``n_messages``, ``total`` (sum of the branch's scores),
    ``text`` and ``loss_spans`` (start and end in code points of each assistant text, end exclusive).

    A message replies to an earlier one of its run: ``reply_to`` must be smaller than ``message_id``, which
    rules out circles. One that names nothing, itself, a later or a missing message begins a tree. Branches,
    the paths from roots to leaves, are ranked within a tree by ``total``, ties by the smaller leaf id; ``best``
    of them are formatted, or all if it is None. Null scores count 0, null roles and contents are empty, a
    null run id is a run of its own. Of messages with the same id in a run the one with the smallest role and content
    counts; messages without an id are told apart by role and content and no one replies to them.
    Empty tables give empty results, other columns are ignored.

    Inside roles and contents each control string of the template, with the backslashes before it, gets one
    backslash more, and none stands next to the template's own; ``read_back`` undoes it. Only built-in expressions run. A
    message with very many replies meets them in joins whose larger side the engine splits; ranks are cut before they
    are shuffled. Turns are joined by 256 before the texts of a branch meet, as one result row holds them all.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    nodes = _nodes(messages, run_id, message_id, reply_to, role, content, score).checkpoint()
    paths = best_paths(nodes, best)
    turns = paths.join(nodes.select("key", "id", "run", "role", escaped(F.col("content")).alias("content")), "key")
    text, head = _piece(F.col("role"), F.col("content"))
    learned = F.col("role") == ASSISTANT
    pieces = turns.select("leaf", "depth", "total", F.when(F.col("leaf") == F.col("key"), F.struct("run", "id")).alias("last"), text.alias("text"), F.when(learned, head).alias("skip"), F.when(learned, F.length("content")).alias("take"))

    part = F.floor(F.col("depth") / SEGMENT).alias("part")
    grouped = pieces.groupBy("leaf", part).agg(
        F.array_sort(F.collect_list(F.struct("depth", "text", "skip", "take"))).alias("turns"), F.max("last").alias("last"), F.first("total").alias("total"),
    )
    ends = F.aggregate(F.col("turns"), F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t["text"]))))
    grouped = grouped.withColumn("ends", ends)
    spans = F.filter(F.transform("turns", lambda t, i: F.struct((F.get("ends", i) + t["skip"]).alias("start"), (F.get("ends", i) + t["skip"] + t["take"]).alias("end"))), lambda s: s["start"].isNotNull())
    segments = grouped.select("leaf", "part", "last", "total", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"), spans.alias("spans"))
    so_far = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = segments.withColumn("at", so_far).withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))))
    whole = moved.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("part", "text", "spans"))).alias("parts"), F.max("last").alias("last"), F.first("total").alias("total"), F.sum("n").alias("n_messages"))
    return whole.select(
        F.col("last.run").alias("run_id"), F.col("last.id").alias("leaf_id"), F.col("n_messages").cast("long").alias("n_messages"), "total",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.flatten(F.transform("parts", lambda p: p["spans"])).alias("loss_spans"),
    )


def read_back(text: Column) -> Column:
    """The turns (role, content) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2)
        plain = F.left(body, F.length(body) - len(CLOSE))
        asked = F.substr(body, F.lit(len(ASK) + 1), F.length(body) - len(ASK + ASKED + CLOSE))
        return F.struct(_role_out(head).alias("role"), unescaped(F.when(head == ASSISTANT, plain).otherwise(asked)).alias("content"))

    pieces = F.split(text, rf"(?<!\\){OPEN}")
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def learned_text(text: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, without escapes, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the text and its mask: run_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("run_id", "text", read_back(F.col("text")).alias("turns"), learned_text(F.col("text"), F.col("loss_spans")).alias("learned"))
    parts = lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "run_id", F.size("turns").cast("long").alias("n_turns"), digest(F.array_join(F.transform("turns", parts), "")).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), digest(F.col("learned")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )
