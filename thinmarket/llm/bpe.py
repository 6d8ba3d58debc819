"""BPE ids of whole articles: long texts in halves, joined by re-encoding growing windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinmarket.llm.rows import text_key

#: Characters of a piece of a long text, of the first window around a join, and words a worker remembers.
PIECE, WINDOW, REMEMBERED = 1 << 15, 64, 300_000
_loaded: dict[str, "Coder"] = {}


class Run(NamedTuple):
    """Text without a plain space, its ids, and where each token stands in it."""

    text: str
    ids: list[int]
    spans: list[tuple[int, int]]


class Coder:
    """A tokenizer file with the ids of the words seen so far.

    Every token ends at a plain space, tab or line end, as the pre-tokenizer drops white space; so the
    ids of a text are those of its words in turn, and a word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words: dict[str, tuple[str, str, int]] = {}

    @classmethod
    def of(cls, path: str) -> "Coder":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def run(self, text: str) -> Run:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return Run(text, e.ids, e.offsets)

    def learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        fresh = [w for w in words if w not in self.words]
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self.words[w] = (" ".join(map(str, e.ids)), self.decode(e.ids), len(e.ids))

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[str, str, int]]:
        """Ids joined by spaces, decoded text and number of ids of each text."""
        for text in texts:
            part = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
            missing = {w for w in part if w not in self.words}
            if missing:
                self.learn(missing | (set(part) if len(self.words) + len(missing) > REMEMBERED else set()))
            found = [x for x in map(self.words.__getitem__, part) if x[2]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])


def _aligned(run: Run) -> dict[tuple[int, int, int], int]:
    """Tokens that begin and end between characters, followed by one that does too, and not last."""
    out = {}
    for k in range(len(run.ids) - 2):
        (a, b), (c, d) = run.spans[k], run.spans[k + 1]
        if a < b <= c < d and (k == 0 or run.spans[k - 1][1] <= a) and d <= run.spans[k + 2][0]:
            out[(run.ids[k], a, b, run.ids[k + 1], c, d)] = k
    return out


def join(coder: Coder, left: Run, right: Run, window: int = WINDOW) -> Run:
    """The encoding of two neighbouring texts as one.

    A window around the join is encoded and grows until, on both sides, two tokens in a row equal the
    side's own in id and place. From there on the sides stand as they are: BPE's tokens are right if
    each pair of neighbours is, and all pairs come from the sides or the window. A window that has
    grown over all text is itself the answer.
    """
    if not left.text or not right.text:
        return right if not left.text else left
    text, cut = left.text + right.text, len(left.text)
    mine = _aligned(left)
    theirs = _aligned(Run(text, right.ids, [(a + cut, b + cut) for a, b in right.spans]))
    size = window
    while size < max(cut, len(right.text)):
        a, b = max(0, cut - size), min(len(text), cut + size)
        mid = coder.run(text[a:b])
        mid = Run(mid.text, mid.ids, [(x + a, y + a) for x, y in mid.spans])
        known = _aligned(mid)
        starts = [] if a else [(0, 0)]  # at the text's own beginning the window needs no agreement
        starts += [(mine[t], k) for t, k in known.items() if t in mine and t[5] <= cut and t[1] > a]
        ends = [(len(right.ids), len(mid.ids))] if b == len(text) else []
        ends += [(theirs[t], k) for t, k in known.items() if t in theirs and t[1] >= cut and t[5] < b]
        if starts and ends:
            (i, k), (j, m) = starts[-1], ends[0]
            if k <= m:
                spans = left.spans[:i] + mid.spans[k:m] + [(x + cut, y + cut) for x, y in right.spans[j:]]
                return Run(text, left.ids[:i] + mid.ids[k:m] + right.ids[j:], spans)
        size *= 2
    return coder.run(text)


def join_tree(coder: Coder, runs: list[Run], window: int = WINDOW) -> Run:
    """Neighbours joined in pairs, level by level."""
    while len(runs) > 1:
        runs = [join(coder, *runs[k : k + 2], window) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def halves(text: str, limit: int, whole: tuple[str, ...] = ()) -> list[str]:
    """The leaves of a text that is halved until no part is longer than ``limit``; ``whole`` strings are never cut."""
    if len(text) <= limit:
        return [text]
    cut = (len(text) + 1) // 2
    for w in whole:  # the special tokens' own strings
        at = text.find(w, max(0, cut - len(w) + 1), cut + len(w) - 1)
        if 0 <= at < cut < at + len(w):
            cut = at or len(w)
    return [text] if cut == len(text) else halves(text[:cut], limit, whole) + halves(text[cut:], limit, whole)


def _edges(text: str) -> tuple[str, str | None, str | None]:
    """(head, middle, tail) at the first and the last plain space; only the head if there is none."""
    a, b = text.find(" "), text.rfind(" ")
    return (text, None, None) if a < 0 else (text[:a], text[a : b + 1], text[b + 1 :])


RUN = "struct<text: string, ids: array<long>, begin: array<long>, end: array<long>>"


def _told(run: Run | None) -> dict | None:
    return run and {"text": run.text, "ids": run.ids, "begin": [a for a, _ in run.spans], "end": [b for _, b in run.spans]}


def _heard(x: dict) -> Run:
    return Run(x["text"], list(map(int, x["ids"])), [(int(a), int(b)) for a, b in zip(x["begin"], x["end"])])


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path)
        for batch in batches:
            sums = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest()) for i, d, n in coder.encode(x.as_py() for x in batch.column("body"))]
            n, ids, decoded = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _cut(path: str, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = Coder.of(path).special
        for batch in batches:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                parts = halves(body.replace("\n", " ").replace("\t", " ").replace("\r", " "), piece, special)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["key", "part", "text"])

    return run


def _leaves(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path)
        for f in frames:
            cut = [_edges(t) for t in f["text"]]
            middle = list(coder.encode([m or "" for _, m, _ in cut]))
            yield pd.DataFrame({
                "key": f["key"], "part": f["part"], "head": [_told(coder.run(h)) for h, _, _ in cut], "whole": [m is None for _, m, _ in cut],
                "ids": [i for i, _, _ in middle], "decoded": [d for _, d, _ in middle], "tail": [_told(coder.run(t or "")) for _, _, t in cut],
            })

    return run


def _grow(path: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        coder, ids, decoded, open_runs = Coder.of(path), [], [], []
        for row in frame.sort_values("part").itertuples():  # what lies between two spaces is joined as a tree
            open_runs.append(_heard(row.head))
            if not row.whole:
                parts = [join_tree(coder, open_runs).ids]
                ids += [" ".join(map(str, parts[0])), row.ids]
                decoded += [coder.decode(parts[0]), row.decoded]
                open_runs = [_heard(row.tail)]
        last = join_tree(coder, open_runs).ids
        ids, decoded = [x for x in [*ids, " ".join(map(str, last))] if x], [x for x in [*decoded, coder.decode(last)] if x]
        told = " ".join(ids)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "n_tokens": [told.count(" ") + bool(told)], "ids_sha256": [hashlib.sha256(told.encode()).hexdigest()], "decoded_sha256": [hashlib.sha256(" ".join(decoded).encode()).hexdigest()]})

    return run


def encode_articles(articles: DataFrame, tokenizer_path: str, article_id: str = "article_id", body: str = "body", piece: int = PIECE) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row per article.

    ``tokenizer_path`` is a BPE file of the tokenizers library, readable on every worker, whose
    pre-tokenizer drops white space and whose decoder joins tokens by spaces. Columns: the id,
    n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256.

    Bodies of up to ``piece`` characters are encoded where they are read. Longer ones are halved until
    no part is longer, wherever that cuts; the parts are rows of their own and encoded in parallel.
    What two parts share without a space between is joined as a tree: a growing window around each
    join is encoded anew until both sides agree exactly. Equal long bodies are encoded once.

    A null body is the empty text: no tokens. Null and repeated ids and repeated rows each get their
    own result; empty tables give none; other columns are ignored.
    """
    rows = articles.select(F.col(article_id).alias("id"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.filter(F.length("body") <= piece).mapInArrow(_short(tokenizer_path), f"id {kind}, {out}")
    long = rows.filter(F.length("body") > piece).select("id", text_key(F.col("body")).alias("key"), "body")
    parts = long.groupBy("key").agg(F.first("body").alias("body")).mapInArrow(_cut(tokenizer_path, piece), "key binary, part int, text string").repartition("key", "part")
    leaves = parts.mapInPandas(_leaves(tokenizer_path), f"key binary, part int, head {RUN}, whole boolean, ids string, decoded string, tail {RUN}")
    joined = leaves.groupBy("key").applyInPandas(_grow(tokenizer_path), f"key binary, {out}")
    named = long.select("id", "key").join(joined, "key").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.unionByName(named).withColumnRenamed("id", article_id)
