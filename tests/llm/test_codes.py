"""Vector codes against a plain version; the curve and the box lists by their defining properties."""

import numpy as np
import pytest

from thinmarket.llm import codes as C


def plain(rows):
    """{id: (codes, error)} and the codebooks, by loops over all entries."""
    kept = sorted((i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    n = len(kept[0][1])
    cut = [n * p // 4 for p in range(5)]
    parts = [[v[a:b] for _, v in kept] for a, b in zip(cut, cut[1:])]
    books = [p[:256] for p in parts]

    def assign(part, book):
        far = [[sum((x - y) ** 2 for x, y in zip(v, e)) for e in book] for v in part]
        return [min(range(len(book)), key=lambda i: (d[i], i)) for d in far], [min(d) for d in far]

    for _ in range(4):
        for p, part in enumerate(parts):
            at, _ = assign(part, books[p])
            groups = {}
            for v, i in zip(part, at):
                groups.setdefault(i, []).append(v)
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    final = [assign(part, book) for part, book in zip(parts, books)]
    return [(i, [at[k] for at, _ in final], sum(e[k] for _, e in final)) for k, (i, _) in enumerate(kept)], books


def run(spark, rows, kind="array<float>"):
    found, books = C.compress_windows(spark.createDataFrame(rows, f"card_id long, window {kind}"))
    got = sorted(((r.card_id, r.codes, r.error) for r in found.collect()), key=lambda r: (r[0] is None, r))
    lists = [[] for _ in range(4)]
    for r in sorted(books.collect()):
        lists[r.part].append(r.components)
    return got, lists


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 30] + rng.normal(size=12) / 4]) for i in rng.permutation(700)]
    hot = [(1000 + i, [0.5] * 12) for i in range(400)]  # one vector of many cards
    odd = [(2000, None), (2001, [None] + [0.0] * 11), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, [0.0] * 11)]
    want, books = plain(rows + hot)
    got, lists = run(spark, rows + hot + odd)
    assert got == want and lists == books


def test_few_ties_and_odd_lengths(spark):
    rows = [(1, [0.0, 0.0, 1.0, 1.0, 2.0, 2.5]), (1, [0.0, 0.0, 1.0, 1.0, 2.0, 2.5]), (2, [0.25, 0.0, 1.0, 1.0, 2.0, 2.5]), (3, [0.0, 0.0, 1.0, 1.0, -2.0, 9.5])]
    want, books = plain(rows)
    got, lists = run(spark, rows, "array<double>")
    assert got == want and lists == books and got[0][1] == got[1][1]
    assert run(spark, []) == ([], [[], [], [], []])
    assert run(spark, [(1, []), (2, [])])[0] == [(1, [0] * 4, 0), (2, [0] * 4, 0)]
    huge, _ = run(spark, [(i, [1e38 * (-1) ** i, 0.0, 0.0, 0.0]) for i in range(3)])
    assert [e for _, _, e in huge] == [0, 0, 0]
    nameless, lists = run(spark, [(None, [1.0] * 4), (5, [2.0] * 4)])
    assert nameless == [(5, [0] * 4, 0), (None, [1] * 4, 0)] and lists[0] == [[2048], [1024]]


def test_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = [k.tobytes() for k in C.hilbert_keys(cells, 3)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(1)
    cut = 0
    for _ in range(50):
        v, e = rng.integers(-50, 50, (40, 3)) + rng.integers(-200, 200, 3), rng.integers(-300, 300, (60, 3))
        few = C.shortlist(v.min(0), v.max(0), e)
        far = ((v[:, None] - e[None]) ** 2).sum(2)
        at, error = C.nearest(v, e, few)
        assert (at == far.argmin(1)).all() and (error == far.min(1)).all()
        cut += len(few) < 30
    assert cut > 25


def test_windows_groups_and_decoding(spark):
    days = [(c, "normal", d, float(10 + c + d % 3)) for c in range(5) for d in range(9)] + [(9, "normal", 0, 1.0), (0, "normal", 3, None)]
    windows = C.price_windows(spark.createDataFrame(days, "card_id long, variant string, date int, market_price double"), 8)
    found, books = C.compress_windows(windows.withColumn("codes", windows.card_id))
    assert found.columns == ["card_id", "variant", "codes", "error"] and found.count() == 5
    back = {r.card_id: r for r in C.decoded(found, books).collect()}
    for r in windows.collect():
        assert back[r.card_id].error == 0 and np.abs(np.array(back[r.card_id].decoded) - r.window).max() < 1 / 1024
    told = C.with_group_error(spark.createDataFrame([(1, "a", [1], 5), (2, "a", [1], 7), (3, None, [1], 1), (4, None, [2], 2)], "card_id long, variant string, codes array<int>, error long"), "variant")
    assert sorted((r.card_id, r.group_error) for r in told.collect()) == [(1, 12), (2, 12), (3, 3), (4, 3)]


@pytest.mark.parametrize("length", [4, 64, 5000])
def test_components_fit(length):
    assert length * (2 * C.largest(length)) ** 2 <= 2**62
