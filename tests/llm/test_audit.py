"""Filter audit against a plain walk through every order."""

import random
import re
from itertools import permutations

from thinmarket.llm import audit as A

FIELDS = "article_id long, body string, source string, mask string"


def plain(rows, labels):
    """{(source, order, step): counts} by sending every article through every order."""
    least = {}
    for i, body, *_ in rows:
        if i is not None:
            least[body or ""] = min(least.get(body or "", i), i)
    told = {}
    for i, good, toxic in labels:
        g, t = told.get(i, (False, False))
        told[i] = (g or good == 1, t or toxic == 1)
    fails = []
    for i, body, source, *_ in rows:
        text = body or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > least[text])
        fails.append((source or "", {f for f, bad in zip("ABCDE", tests) if bad}, told.get(i, (False, False)) if i is not None else (False, False)))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for source in {s for s, *_ in fails}:
            own = [x for x in fails if x[0] == source]
            for k, f in enumerate(order):
                before = set(order[:k])
                left = [x for x in own if not x[1] & before]
                gone = [x for x in left if f in x[1]]
                out[source, order, k + 1] = [len(left) - len(gone), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2][0] for x in gone), sum(x[2][1] for x in gone)]
    for source in {s for s, *_ in fails}:
        for f in "ABCDE":
            total = sum(v[1] for (s, o, k), v in out.items() if s == source and o[k - 1] == f and len(v) < 7)
            for (s, o, k), v in out.items():
                if s == source and o[k - 1] == f:
                    v.append(total)
    return out


def audit(spark, rows, labels):
    told = spark.createDataFrame(labels, "article_id long, quality int, toxic int")
    out = A.audit_filters(spark.createDataFrame([(*r, "x") for r in rows], FIELDS), told)
    assert out.columns == ["source", "filter_order", "step", *A.COUNTS, "shapley"]
    got = {(r.source, r.filter_order, r.step): [r[c] for c in (*A.COUNTS, "shapley")] for r in out.collect()}
    return got


def test_equals_plain_walk(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 90])], k=rng.randint(0, 120))) + rng.choice(["", " #tag", " é", " ABC" * 40, "\x0b$"]) for _ in range(60)]
    rows = [(rng.choice([None, *range(150)]), rng.choice(texts + [None, ""]), rng.choice(["a", "b", None, ""])) for _ in range(300)]
    rows += [(1000 + i, texts[0], "hot") for i in range(200)] + [(1000, texts[0], "hot")]
    labels = [(rng.randrange(1200), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    assert audit(spark, rows, labels) == plain(rows, labels)


def test_edges(spark):
    assert audit(spark, [], []) == {}
    got = audit(spark, [(1, "x " * 100_000, "s"), (1, "x " * 100_000, "s")], [])
    assert len(got) == 600 and got["s", "ABCDE", 2] == [0, 2, 0, 2, 0, 0, 240] and got["s", "EABCD", 1] == [2, 0, 0, 0, 0, 0, 0]
