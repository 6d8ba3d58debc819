"""Rendering by hand-worked pages and word for word; archives by exact round trips."""

import io
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from thinmarket.llm import archive as A
from thinmarket.llm import render as R

CASES = [
    ("<p>a<p>b<br>c", "a\n\nb\nc"),
    ("<ul><li>x<li>y<ol><li>z</ol></ul>after", "- x\n- y\n  1. z\n\nafter".replace("  1.", "   1.")),
    ("<table><tr><th>card<th>price<tr><td>A<td>12.50<tr><td>Longer name<td>3</table>", "card        | price\nA           | 12.50\nLonger name | 3"),
    ("<div hidden>no</div><div style='display: none'>no</div><script>no</script><b>y</b>es<style>p{}</style>", "yes"),
    ("a &amp; b   c\n d", "a & b c d"), ("<pre>a\n  b</pre>", "a\n  b"), ("</p></div>x</td>", "x"), ("", ""), (None, ""),
    ("<h1>T</h1><div>one<div>two</div>three</div>", "T\n\none\ntwo\nthree"), ("x<!-- no --><img alt='pic'>", "xpic"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert R.visible_text(html) == text


SEEN = [
    ("<head><title>x</title><p>text", "text"), ("<head><title>x <p> y</title><meta name=a>\n bare text<p>more", "bare text\n\nmore"),
    ("<html><head><script>no</script><noscript><img alt=no></noscript><style>no</style></head>yes", "yes"), ("<head><title>x</title><body>text", "text"),
    ("<span aria-hidden='true'>seen</span>", "seen"), ("<textarea>\na &lt;b>\n  <i>c</textarea>d", "a <b>\n  <i>cd"), ("<p>a</p><textarea>open &amp; on", "a\n\nopen & on"),
    ("<select><option>one<option selected>two</select>", "two"), ("<select><option disabled>none<optgroup><option>one<option>two</select>", "one"), ("<select multiple><option>one<option>two</select>", "one two"),
    ("a<![x]>b<![ if]>c<![if !IE]>d<![endif]>e", "abcde"), ("a<![x", "a"), ("a<![ if", "a"), ("<![CDATA[x]]>a", "a"),
]


@pytest.mark.parametrize("html,text", SEEN)
def test_nothing_visible_is_lost(html, text):
    assert R.visible_text(html) == text


SPANS = [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"), ("<table><tr><td colspan=2>wide title<tr><td>a<td>b</table>", "wide title\na | b"),
    ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a | b\nc\nd | e"), ("<table><tr><td colspan=1000>a<tr><td>b<td>c</table>", "a\nb | c"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
    ("<table><tr><td>カード<td>x<tr><td>abc<td>y</table>", "カード | x\nabc    | y"), ("<table><tr><td colspan=x rowspan=-1>a<td>b<tr><td>c</table>", "a | b\nc"),
    ("<div style='visibility:hidden'>no<br><b style='visibility: visible'>yes</b>no</div>", "yes"), ("<input value=go type=submit><input type=hidden value=no>", "go"),
]


@pytest.mark.parametrize("html,text", SPANS)
def test_spans_and_visibility(html, text):
    assert R.visible_text(html) == text


def test_tables_against_a_painted_grid():
    """Cells are put into a matrix slot by slot and painted character by character."""
    rng = random.Random(4)
    for _ in range(200):
        high, wide = rng.randint(1, 6), rng.randint(1, 6)
        grid, cells = {}, []
        for r in range(high):
            for c in range(wide):
                if (r, c) not in grid:
                    most = next((k for k in range(1, wide - c) if (r, c + k) in grid), wide - c)
                    cells.append((r, c, rng.randint(1, min(most, 3)), rng.randint(1, min(high - r, 3)), rng.choice("abc") * rng.randint(1, 9)))
                    grid |= {(r + i, c + k): len(cells) for i in range(cells[-1][3]) for k in range(cells[-1][2])}
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for rr, _, w, h, t in cells if rr == r) for r in range(high)) + "</table>"
        starts = sorted({c for _, c, *_ in cells})
        width = {c: max([len(t) for _, k, w, _, t in cells if k == c and sum(c <= s < c + w for s in starts) == 1], default=0) for c in starts}
        for _, c, w, _, t in cells:
            inside = [s for s in starts if c <= s < c + w]
            width[inside[-1]] += max(0, len(t) - sum(width[s] for s in inside) - 3 * (len(inside) - 1))
        left = {c: sum(width[s] + 3 for s in starts if s < c) for c in starts}
        lines = []
        for r in range(high):
            own = [(c, t) for rr, c, _, _, t in cells if rr == r]
            if own:
                line = [" "] * 200
                for c in starts:
                    if 0 < c <= own[-1][0] and grid[r, c] != grid[r, c - 1]:
                        line[left[c] - 2] = "|"
                for c, t in own:
                    line[left[c] : left[c] + len(t)] = t
                lines.append("".join(line).rstrip())
        assert R.visible_text(html) == "\n".join(lines).strip("\n")


@pytest.mark.parametrize("html", [
    "<b>" * 50_000 + "</i>" * 50_000, "<i><table><td>" + "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<tr><td rowspan=65534>x" * 5000,
    "<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 20_000, "<table><tr><td>" + "long " * 100_000 + "<td>x" + "<tr><td>a<td>b" * 20_000,
])
def test_odd_pages_take_time_in_proportion(html):
    start = time.perf_counter()
    text = R.visible_text(html)
    assert time.perf_counter() - start < 10 and len(text) < 400 * len(html)


def test_every_visible_word_once(spark):
    rng = random.Random(6)
    tags = "p div li ul ol table tr td b span h2 article pre".split()
    rows = []
    for i in range(60):
        parts, words = [], []
        for k in range(rng.randint(0, 60)):
            words.append(f"w{k}")
            parts.append(f"<{rng.choice(['', '/'])}{rng.choice(tags)}> w{k} ")
        rows.append((i, "".join(parts), words))
    rows += [(None, None, []), (3, "<div>" * 5000 + "deep", ["deep"])]
    df = spark.createDataFrame([(i, h, "t") for i, h, _ in rows], "page_id long, html string, text string")
    got = sorted((str(r.page_id), sorted(re.findall(r"w\d+|deep", r.text))) for r in R.render_pages(df).collect())
    assert got == sorted((str(i), sorted(w)) for i, _, w in rows)
    assert R.render_pages(df.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    pages = [(i, f"https://x.org/{i}?é \n", f"<p>page {i % 40} " + "é word " * (i % 40)) for i in range(200)]
    pages += [(500, None, None), (501, "u", ""), (None, "u", "<p>page 3 " + "é word " * 3), (0, "again", "<p>page 0 "), (900, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*p, "f") for p in pages], "page_id long, url string, html string, file string")
    for least in (0, 50):
        got = A.round_trip(df, f"file://{tmp_path}/{least}", revisit_from=least, file_bytes=20_000)
        want = []
        for i, _, h in pages:
            raw = (h or "").encode()
            same = [j for j, _, o in pages if (o or "") == (h or "") and j is not None]
            again = len(raw) >= least and i != min(same)
            want.append((i, len(raw), A.digest(raw), "revisit" if again else "response", min(same) if again else None))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert A.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_dictionary_helps_and_frames_stand_alone():
    records = [A.record(str(i), f"https://x.org/{i}", f"<html><head><title>{i}</title></head><body>{i * 7}</body></html>".encode(), None, False) for i in range(400)]
    data = A.archive_bytes(records)
    assert list(A.archive_records(io.BytesIO(data))) == records
    assert len(data) < sum(len(zlib.compress(r)) for r in records)
    assert list(A.archive_records(io.BytesIO(A.archive_bytes(records[:1])))) == records[:1]


def test_reading_is_linear_and_tells_cut_files():
    records = [A.record(str(i), None, random.Random(i).randbytes(i % 50_000), None, False) for i in range(4000)]
    data = A.archive_bytes(records)
    start = time.perf_counter()
    assert list(A.archive_records(io.BytesIO(data))) == records
    assert time.perf_counter() - start < 2
    with pytest.raises(ValueError):
        list(A.archive_records(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(A.archive_records(io.BytesIO(data[8:])))


def test_odd_ids_and_a_task_per_file(spark, tmp_path):
    ids = ["a\r\nPage-ID: b", "", " x: y ", "é%0A", None, "a\r\nPage-ID: b"]
    df = spark.createDataFrame([(i, None, f"<p>{i}") for i in ids], "page_id string, url string, html string")
    got = [r.page_id for r in A.round_trip(df, f"file://{tmp_path}/odd").collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)
    many = spark.range(4000).selectExpr("id AS page_id", "'u' AS url", "repeat(CAST(id AS STRING), 50) AS html").repartition(3)
    files = A.write_archives(many, f"file://{tmp_path}/many", file_bytes=40_000)
    n = files.count()
    read = A.read_archives(files, f"file://{tmp_path}/many")
    tasks = read.rdd.getNumPartitions()
    assert tasks == min(n, 4 * spark.sparkContext.defaultParallelism) and n > 8
    per_task = read.groupBy(F.spark_partition_id()).count().count()
    assert per_task > tasks // 2 and read.count() == 4000
