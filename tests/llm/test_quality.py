"""Rule ledger: measurements against a plain loop, bits, policies and ablations."""

from thinmarket.llm import quality as Q

SCHEMA = "article_id long, body string, n_words string"
GOOD = " ".join(f"card{i} price{i * 7} rose" for i in range(40))


def plain(body):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", body or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(words), len(hit)


def test_measures_match_a_plain_loop():
    for body in (None, "", " ", "a", "a b c a b c", "x x x x x", "a b c d a b c e b c d", "é|# 12\n\n12\n12 ", "a\x1cb\x85c " * 5):
        got = dict(zip(Q.MEASURES, Q.measure(body)))
        assert (got["n_words"], got["n_repeat_words"]) == plain(body), body


def test_ledger_edges(spark):
    rows = [(1, GOOD, "x"), (None, None, None), (1, GOOD, "x"), (2, "", "y"), (3, "win ### *** $$$ " * 30, "z"), (4, "word " * 400_000, "long")]
    got = {(r.article_id, r.n_words): r.fail_bits for r in Q.rule_ledger(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 120): 0, (None, 0): 1, (2, 0): 1, (3, 120): 2 | 4 | 16, (4, 400_000): 2}
    assert Q.rule_ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_policies_and_ablation(spark):
    rows = [(i, b, "") for i, b in enumerate([GOOD, GOOD, "short", "a b c " * 30, "win ### *** $$$ " * 30])]
    df = spark.createDataFrame(rows, SCHEMA)
    ledger = Q.rule_ledger(df)
    assert {r.article_id for r in ledger.filter(Q.kept("base")).collect()} == {0, 1}
    got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(ledger, "v1").collect()}
    for rule in Q.POLICIES["v1"]:  # against judging every row again without the rule
        bit, used = 1 << [n for n, _ in Q.RULES].index(rule), Q.mask("v1")
        bits = [r.fail_bits & used for r in ledger.collect()]
        assert got[rule] == (sum(b & bit > 0 for b in bits), sum(b > 0 and b & ~bit == 0 for b in bits))
    kept = Q.keep_articles(df, "base")
    assert kept.columns == df.columns and kept.count() == 2


def test_query_ablates_over_whole_documents(spark):
    """The counts beside each row against removing one rule and judging every row of the table again."""
    from thinmarket.llm import queries

    rows = queries.op1_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert any(r.only_rule for r in rows) and any(not r.kept and r.only_rule is None for r in rows)
    for i, (name, _) in enumerate(Q.RULES):
        rest = Q.mask("v2") & ~(1 << i)
        saved = [r for r in rows if not r.kept and r.fail_bits & rest == 0]
        assert [r.doc_id for r in saved] == [r.doc_id for r in rows if r.only_rule == name]
        assert {(r.only_rule_rows, r.only_rule_failed) for r in saved} <= {(len(saved), sum(r.fail_bits >> i & 1 for r in rows))}
    assert all(r.kept_v1 == (r.fail_bits & Q.mask("v1") == 0) and (r.only_rule_rows is None) == (r.only_rule is None) for r in rows)
