"""Every stage against a plain version on its own input, at the smallest scale."""

import hashlib

import corpus_pipeline as C
from test_bpe import CODER
from test_decontaminate import plain as leaks
from test_lines import repeats
from test_neighbours import linked_groups
from thinmarket.llm import quality as Q

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [name for name, _ in C.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding"]
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r for r in out.collect()}
        if name != "bpe_encoding":
            assert out.dtypes == docs.dtypes and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "quality_rules":
            m = {i: dict(zip(Q.MEASURES, Q.measure(t))) for i, t in before.items()}
            assert set(rows) == {i for i, x in m.items() if not any(eval(test.replace("OR", "or"), {}, x) for _, test in Q.RULES)}
        elif name == "line_dedup":
            lines = lambda texts: {x for t in texts for x in t.split("\n")}
            assert lines(before.values()) == lines(r.text for r in rows.values())  # every line keeps a copy
            assert all(set(r.text.split("\n")) <= set(before[i].split("\n")) for i, r in rows.items())
            want = repeats(list(before.items()))  # lines of passages that stand earlier: nothing else goes, and nearly all of these do
            gone = 0
            for i, t in before.items():
                split, kept = t.split("\n"), rows[i].text.split("\n") if i in rows else []
                rest = iter(kept)
                assert all(any(x == y for y in rest) for j, x in enumerate(split) if j not in want[i])
                gone += len(split) - len(kept)
            total = sum(map(len, want.values()))
            assert gone >= 0.9 * total > 0
        elif name == "ngram_jaccard_join":
            groups = linked_groups(list(before.items()))
            texts = [r.text for r in rows.values()]
            assert sorted(sum(t in g for t in texts) for g in groups) == [1] * len(groups)
        elif name == "benchmark_decontamination":
            assert set(rows) == {i for i, t in before.items() if leaks(t, items)[1] == 0} and len(rows) < len(before)
        else:
            for i, t in before.items():
                ids = CODER.tokenizer.encode(t, add_special_tokens=False).ids
                assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        docs = out
    assert sorted(C.run(spark, SF).collect()) == sorted(docs.collect())
