"""Near duplicates against all pairs by brute force; a group larger than a block; pruning; edges."""

import random

import numpy as np

from thinmarket.llm import neighbours as N

SCHEMA = "article_id long, body string, key string, root string"


def shingles(t):
    w = (t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None


def linked_groups(rows):
    sets = {t: s for t in {t for _, t in rows} if (s := shingles(t))}
    groups, free = [], set(sets)
    while free:
        seen = todo = {free.pop()}
        while todo:
            todo = {o for o in free for t in todo if len(sets[t] & sets[o]) >= 0.8 * len(sets[t] | sets[o]) - 1e-9}
            free -= todo
            seen = seen | todo
        groups.append(seen)
    return groups


def plain(rows, threshold=0.8):
    sets = {}
    for _, t in rows:
        sets[t] = sets[t] if t in sets else shingles(t)
    texts = [t for t, s in sets.items() if s]
    links = {t: set() for t in texts}
    for x, a in enumerate(texts):
        for b in texts[:x]:
            common = len(sets[a] & sets[b])
            if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    out = []
    for i, t in rows:
        if not sets[t]:
            out.append((i, i, 1, 0))
            continue
        seen, todo = {t}, [t]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        ids = [j for j, o in rows if o in seen and j is not None]
        out.append((i, min(ids) if ids else None, sum(o == t for _, o in rows), len(links[t])))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", "r") for r in rows], SCHEMA)
    return df, sorted(((r.article_id, r.class_id, r.n_copies, r.n_links) for r in N.near_duplicates(df).collect()), key=str)


def variants(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [t for n, w, e in ((40, 80, 4), (25, 200, 12), (10, 6, 1), (30, 120, 8)) for t in variants(rng, n, w, e)]
    texts += [" ".join(f"u{i}{k}" for k in range(30)) for i in range(40)] + ["a", "a", "a b", "a  b", "a b c d e"]
    rows = list(enumerate(texts, 1)) + [(900 + i, texts[i]) for i in range(0, 60, 7)]
    rows += [(None, None), (None, texts[3]), (5, ""), (6, " \n"), (6, " \n"), (None, "only here"), (77, "long word " * 20_000)]
    rng.shuffle(rows)
    df, got = run(spark, rows)
    want = plain(rows)
    assert got == want
    kept = [r.body or "" for r in N.one_of_each(df).collect()]
    groups = linked_groups(rows)
    assert sum(not t.split() for t in kept) == 4
    assert sorted(sum(t in g for t in kept) for g in groups) == [1] * len(groups)


def test_a_group_beyond_a_block(spark):
    rows = list(enumerate(variants(random.Random(2), N.BLOCK_TEXTS * 2 + 60, 60, 3)))
    assert run(spark, rows)[1] == plain(rows)


def test_pruning_rule():
    for n in (16, 48, 96):
        m = N.least_matches(n, 0.8, 1e-6)
        draws = np.random.default_rng(0).beta(m, n - m + 2, 200_000)  # one match fewer: pruned
        assert (draws >= 0.8).mean() < 1e-4 and m <= 0.8 * n


def test_empty(spark):
    assert run(spark, [])[1] == []
