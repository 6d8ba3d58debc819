"""Benchmark passages against a plain search over all windows."""

import random
import re

from thinmarket.llm import decontaminate as D

A, B = "article_id long, body string, key string, words string", "item_id long, text string, token string"


def plain(body, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = cut(body), set(), set()
    for i, t in items:
        w = cut(t)
        size = min(10, len(w))
        wins = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in wins:
                hit.update(range(k, k + size))
                ids.add(str(i))
    return len(words), len(hit), sorted(ids)


def run(spark, articles, items):
    a = spark.createDataFrame([(*x, "k", "w") for x in articles], A)
    b = spark.createDataFrame([(*x, "t") for x in items], B)
    return sorted(((r.article_id, r.n_words, r.n_hit, r.item_ids) for r in D.find_benchmark_passages(a, b).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = "set card price rose fell Éclair the of a".split()
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, "..."), (None, text(14)), (92, "The SET, card!"), (93, "the set card")]
    articles = [(i, text(rng.choice([0, 5, 40])) + " " + (rng.choice(items)[1] or "").upper() + "\n" + text(rng.choice([0, 3, 30]))) for i in range(40)]
    articles += [(None, None), (7, ""), (7, ""), (50, items[11][1]), (50, items[11][1]), (51, "x " * 30_000 + (items[12][1] or "") + " the set card")]
    want = sorted(((i, *plain(t, items)) for i, t in articles), key=str)
    got = run(spark, articles, items)
    # a null item id counts in n_items only
    clean = [(i, n, h, [x for x in ids if x != "None"]) for i, n, h, ids in want]
    assert got == sorted(clean, key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b"), (None, None)], []) == [(1, 2, 0, []), (None, 0, 0, [])]
