"""Names in texts: equal to comparing every pair, with common runs split and with odd lengths."""

import random

from thinmarket.operators import picks
from thinmarket.operators.containment import containing


def pairs(spark, texts, names, **how):
    t, n = spark.createDataFrame([(x,) for x in texts], "low string"), spark.createDataFrame([(x,) for x in names], "base string")
    rows = [(r.low, r.base) for r in containing(t, n, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain(texts, names):
    return {(t, n) for t in texts for n in names if t and n and n in t}


def test_equals_all_pairs(spark):
    rng = random.Random(7)
    letters = "abcde é"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(300)] + [None, "", "a"]
    names = ["".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(200)] + [None, "", "zzz", "abc zzz"]
    want = plain(texts, names)
    assert len(want) > 500
    for hot in (1000, 5, 0):
        assert pairs(spark, texts, names, hot=hot) == want


def test_common_runs_and_long_texts(spark):
    texts = [f"charizard {i}" for i in range(400)] + ["x" * 3000 + " charizard ex " + "y" * 3000]
    names = ["charizard", "charizard 7", "charizard ex", "ex", "x", "y" * 3001]
    assert pairs(spark, texts, names, hot=20) == plain(texts, names)
    assert pairs(spark, [], names) == pairs(spark, texts, []) == set()


def test_runs_shuffled_and_long_names_that_share_their_runs(spark):
    texts = [f"supplier#{i:09d} — set {i % 7}" for i in range(60)] + ["a" * 40 + "b"]
    names = [f"supplier#{i:09d}" for i in range(0, 80, 3)] + ["set 1", "supplier#0000", "b"] + ["a" * n for n in range(8, 45)]
    want = plain(texts, names)
    for how in ({}, {"sent": 0}, {"sent": 0, "hot": 2}):
        assert pairs(spark, texts, names, **how) == want


def test_copies_of_a_card_do_not_multiply_the_candidates(spark):
    cards = spark.createDataFrame([(i, "Fox", "Base", 10.0) for i in range(50)], "card_id long, name string, set_name string, current_price double")
    text = "PORTFOLIO RECOMMENDATIONS\n" + "".join(f"{b}. **Fox** — Base — $10.00 — Premium\n   Strategy: HOLD\n" for b in (1, 2, 3))
    texts = spark.createDataFrame([(1, text)], "text_id long, text string")
    assert picks.candidates(picks.recommendation_blocks(texts), cards).count() == 1 + 2 + 3
    assert sorted((r.block, r.card_id) for r in picks.extract_picks(texts, cards).collect()) == [(1, 0), (2, 1), (3, 2)]
