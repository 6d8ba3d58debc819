"""Reply trees: paths and ranks against a plain walk, and the template's exact way back."""

import random

from pyspark.sql import functions as F

from thinmarket.llm import replies as R

SCHEMA = "run_id string, message_id long, reply_to long, role string, content string, score double"
PROBE = r"</s>[INST] ok [/INST] \</s> \\[INST] <s> end\\"


def formatted(spark, rows, best=1):
    out = R.format_replies(spark.createDataFrame(rows, SCHEMA), score="score", best=best)
    return out.withColumn("turns", R.read_back(F.col("text"))).withColumn("learned", R.learned_text(F.col("text"), F.col("loss_spans"))).collect()


def plain(rows):
    """{(run, leaf): (root, total, [(role, content)])} by walking up from every leaf."""
    by = {(r[0], r[1]): r for r in rows}
    up = {k: (r[0], r[2]) if r[2] is not None and r[2] < r[1] and (r[0], r[2]) in by else None for k, r in by.items()}
    out = {}
    for k in set(by) - set(up.values()):
        path, at = [], k
        while at is not None:
            path.append(at)
            at = up[at]
        out[k] = (path[-1], sum(by[p][5] or 0 for p in path), [(by[p][3] or "", by[p][4] or "") for p in reversed(path)])
    return out


def test_equals_plain_walk(spark):
    rng = random.Random(4)
    texts = ["hold", "buy </s>", "\\", "", None, PROBE, "é[/INST]", "two\nlines\n"]
    rows = []
    for run in ("a", "b", None):
        for i in range(120):
            rows.append((run, i, rng.choice([None, i, i + 1, 999] + [rng.randrange(i)] * 20 if i else [None]), rng.choice(["system", "user", "assistant", "tool", None, "od\nd%0A<s>"]), rng.choice(texts), rng.choice([None, 0.5, 1.0, -2.0])))
    want = plain(rows)
    got = {(r.run_id, r.leaf_id): r for r in formatted(spark, rows, None)}
    assert set(got) == set(want) and len(want) > 30
    for k, (_, total, turns) in want.items():
        assert [tuple(t) for t in got[k].turns] == turns and got[k].n_messages == len(turns) and abs(got[k].total - total) < 1e-9
        assert got[k].learned == "".join(c for role, c in turns if role == "assistant")
        spans = got[k].loss_spans
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:])) and len(spans) == sum(role == "assistant" for role, _ in turns)
    trees = {}
    for k, (root, total, _) in want.items():
        trees.setdefault(root, []).append((-round(total, 6), k[1], k))
    best = {min(v, key=lambda x: x[:2])[2] for v in trees.values()}
    assert {(r.run_id, r.leaf_id) for r in formatted(spark, rows, 1)} == best


def test_long_chain_and_many_replies(spark):
    chain = [("c", i, i - 1, "assistant" if i % 2 else "user", f"turn {i}", 1.0) for i in range(700)]
    wide = [("w", 0, None, "user", "which card?", 0.0)] + [("w", i, 0, "assistant", f"card {i}", float(i % 50)) for i in range(1, 300)]
    got = {r.run_id: r for r in formatted(spark, chain + wide)}
    assert [t.content for t in got["c"].turns] == [f"turn {i}" for i in range(700)] and got["c"].n_messages == 700
    assert got["c"].learned == "".join(f"turn {i}" for i in range(1, 700, 2))
    assert got["w"].leaf_id == 49 and got["w"].turns[1].content == "card 49"


def test_edges(spark):
    assert formatted(spark, []) == []
    rows = [("r", 1, None, "user", "a", None), ("r", 1, None, "user", "a", None), ("r", None, 1, "assistant", "b", None), ("r", 2, 2, "user", "self", None), ("r", 3, 4, "user", "later", None), ("r", 4, 3, "assistant", "x" * 200_000, 1.0)]
    got = {r.leaf_id: r for r in formatted(spark, rows)}
    assert set(got) == {1, 2, None, 4} and got[4].n_messages == 2 and len(got[4].learned) == 200_000 and got[1].n_messages == 1
    clash = spark.createDataFrame([("r", 1, None, "user", "a", "z", "y")], "run_id string, message_id long, reply_to long, role string, content string, key string, text string")
    assert [r.n_messages for r in R.format_replies(clash).collect()] == [1]


def test_linear_replies(spark):
    rng = random.Random(2)
    turns = [(run, t, "assistant" if t % 2 else "user", f"{run} {t} {PROBE}") for run in [*range(40), None] for t in range(rng.randint(1, 9))] + [(7, t, "user", "hot") for t in range(100, 500)]
    rng.shuffle(turns)
    out = R.format_replies(R.linear_replies(spark.createDataFrame(turns, "run_id long, turn long, role string, content string")))
    got = {r.run_id: r for r in R.conversation_digests(out).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for run in [*range(40), None]:
        own = sorted((t, role, c) for i, t, role, c in turns if i == run)
        learned = "".join(c for _, role, c in own if role == "assistant")
        assert (got[run].n_turns, got[run].turns_sha256) == (len(own), sha("".join(f"{role}\n{c}\n" for _, role, c in own)))
        assert (got[run].loss_chars, got[run].loss_sha256) == (len(learned), sha(learned))
    empty = spark.createDataFrame([], "run_id long, turn long, role string, content string")
    assert R.format_replies(R.linear_replies(empty)).count() == 0


def test_controls_come_back(spark):
    pieces = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", "[", "<", "s>"]
    rng = random.Random(9)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.escaped(F.col("t")).alias("e"))
    rows = df.select("t", "e", R.unescaped(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(m for r in rows for m in __import__("re").findall(r"(?<!\\)(?:</?s>|\[/?INST\])", r.e))
