"""Repeated passages: soundness against a plain search for repeats, measured recall, ordinary text, and the edges."""

import random

from thinmarket.llm import lines as L

SCHEMA = "article_id long, body string, key string, start string"
WORDS = "rose fell card set price holo sold week chart buyers raw graded market spread volume".split()


def dedup(spark, rows):
    return L.drop_repeated_lines(spark.createDataFrame([(*r, "k", "s") for r in rows], SCHEMA))


def line(rng, n=9):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.randrange(10**6)}"


def repeats(rows):
    """{article: numbers of lines that belong to a large enough run of lines which stands earlier}, by looking at every pair of places."""
    texts = sorted((i, body.split("\n")) for i, body in rows)
    places = {}
    for i, split in texts:
        for j, x in enumerate(split):
            places.setdefault(x, []).append((i, j))
    by, out = dict(texts), {i: set() for i, _ in texts}
    for i, split in texts:
        for j, x in enumerate(split):
            for a, k in places[x]:
                if (a, k) < (i, j):
                    n = 0
                    while j + n < len(split) and k + n < len(by[a]) and split[j + n] == by[a][k + n]:
                        n += 1
                    run = [y for y in split[j : j + n] if y.strip()]
                    if len(run) >= L.LEAST_LINES and sum(map(len, run)) >= L.LEAST_CHARS:
                        out[i].update(range(j, j + n))
    return out


def test_removes_only_repeats_and_nearly_all(spark):
    rng = random.Random(5)
    pool = [line(rng, rng.choice([1, 4, 9, 14])) for _ in range(60)] + ["", "  }", "}"]
    passages = [rng.sample(pool, rng.randint(2, 9)) for _ in range(25)]
    rows = []
    for i in range(150):
        own = [line(rng) if rng.random() < 0.8 else rng.choice(pool) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + rng.choice(passages) + own[at:])))
    want = repeats(rows)
    got = {r.article_id: (r.body.split("\n") if r.body else [], r.n_removed_lines) for r in dedup(spark, rows).collect()}
    removed = 0
    for i, body in rows:
        split = body.split("\n")
        kept, n = got[i]
        sure = [x for j, x in enumerate(split) if j not in want[i]]
        rest = iter(kept)
        assert all(any(x == y for y in rest) for x in sure), i  # what is no repeat stays, in order
        assert n == len(split) - len(kept) or kept == []
        removed += n
    total = sum(map(len, want.values()))
    print(f"removed {removed} of {total} repeated lines")
    assert removed >= 0.95 * total > 400
    assert {x for kept, _ in got.values() for x in kept} >= {x for _, b in rows for x in b.split("\n") if x}  # every line keeps a copy


def test_edges(spark):
    passage = "\n".join(f"the {i}th line of a passage that stands in two articles" for i in range(12))
    rows = [(1, passage), (2, passage), (None, None), (3, ""), (4, "one\n\n\n\none"), (1, passage), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "x\n" * 20_000)]
    got = sorted(((r.article_id or 0, r.body, r.n_removed_lines) for r in dedup(spark, rows).collect()), key=str)
    by = {a: (b, n) for a, b, n in got}
    assert by[1] == (passage, 0) and by[2] == ("", 12) and by[0] == (None, 0) and by[3] == ("", 0)
    assert by[4] == ("one\n\n\n\none", 0) and by[5] == by[6] == ("\n\n\n\n", 0) and by[7][1] == 0 and len(got) == len(rows)
    assert dedup(spark, rows).columns == ["article_id", "body", "key", "start", "n_removed_lines"]
    assert dedup(spark, []).count() == 0


def removed_of_planted(spark, copies: int) -> dict[int, tuple[int, int, int]]:
    """By length of the passage: (lines removed, lines of the later copies, other lines removed), 60 passages each amid foreign lines."""
    rng = random.Random(copies)
    rows, size, i = [], {}, 0
    for n in range(1, 11):
        for p in range(60):
            passage = [line(rng, 16) if n < 4 else line(rng, rng.choice([6, 12])) for _ in range(n)]
            for _ in range(copies):
                around = [line(rng) for _ in range(2 + i % 3)]
                rows.append((i, "\n".join(around[:1] + passage + around[1:])))
                size[i], i = (n, set(around)), i + 1
    out = {n: [0, 60 * n * (copies - 1), 0] for n in range(1, 11)}
    for r in dedup(spark, rows).collect():
        n, around = size[r.article_id]
        out[n][0] += r.n_removed_lines
        out[n][2] += len(around - set(r.body.split("\n")))
    return {n: tuple(x) for n, x in out.items()}


def test_planted_passages(spark):
    for copies in (2, 12):
        got = removed_of_planted(spark, copies)
        print(copies, got)
        assert got.pop(1)[0] == 0  # single lines stay
        assert all(gone >= 0.9 * lines and clean == 0 for gone, lines, clean in got.values())


def test_ordinary_text_stays(spark):
    rng = random.Random(1)
    code = [(i, f"{line(rng)}\ndef f{i}(x) {{\n  if (x) {{\n    return {i};\n  }}\n}}\n{line(rng)}") for i in range(20)]
    table = [(100 + i, f"{line(rng)}\n| card | price | week |\n|------|-------|------|\n| {i} | {i + 1} | 3 |") for i in range(20)]
    rows = code + table + [(200, "x\nx\nx\ny")]
    assert {(r.article_id, r.body, r.n_removed_lines) for r in dedup(spark, rows).collect()} == {(i, b, 0) for i, b in rows}


def test_blank_lines_count_by_their_bytes(spark):
    a, b = "A a " * 30, "B b " * 30
    rows = [(1, f"{a}\n\n{b}\nown"), *[(i, f"own {i}\n{a}\n \n{b}") for i in range(2, 6)], *[(i, f"{a}\n\r\n{b}") for i in range(6, 9)]]
    got = {r.article_id: (r.body, r.n_removed_lines) for r in dedup(spark, rows).collect()}
    assert got[1][1] == got[2][1] == got[6][1] == 0  # each line of these is long, but no two neighbours are equal to earlier ones
    assert all(got[i][1] in (0, 3) for i in range(3, 9))
