"""Ids and decoded texts against the library on whole texts, for every way of cutting."""

import hashlib
import random

import public_tokenizers

from thinmarket.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER = B.Coder.of(PATH)


def odd_texts(rng):
    stuff = ["price", "THE", "Éclair", "é", "'s", "'", "<|endoftext|>", "<|", "日本語", "🎴", "İ", "ß", "́", "12", "...", "a" * 50, "\xa0", "\x1c", " ", "한국", "x" * 7, "~!~", "कि", "ΣΑΣ"]
    for _ in range(120):
        yield "".join(rng.choice(stuff) + rng.choice(["", "", "", " ", "\n"]) for _ in range(rng.randint(1, 60)))


def test_joins_equal_the_whole():
    rng = random.Random(4)
    runs = ["".join(rng.choices("abetnrios", k=900)), "a" * 700, "日本" * 300, "🎴" * 200, "é" * 300, "'s" * 300, "!?" * 300]
    for text in [*odd_texts(rng), *runs]:
        want = CODER.tokenizer.encode(text, add_special_tokens=False).ids
        for piece in (5, 40, 333):
            got = B.join_tree(CODER, [CODER.run(p) for p in B.halves(text, piece, CODER.special)], window=4)
            assert got.ids == want, (piece, text)


def test_articles_equal_the_library(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(odd_texts(rng))] + [(None, None), (5, ""), (6, " \n "), (7, "same"), (7, "same")]
    rows += [(800 + i, t) for i, t in enumerate(["".join(rng.choices("abetnrios", k=5000)), "card set " * 4000, "x" * 3000 + " tail", "card set " * 4000])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "article_id long, body string, key string")
    got = sorted(map(tuple, B.encode_articles(df, PATH, piece=700).collect()), key=str)
    want = []
    for i, t in rows:
        ids = CODER.tokenizer.encode(t or "", add_special_tokens=False).ids
        text = CODER.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert B.encode_articles(df.limit(0), PATH).count() == 0
