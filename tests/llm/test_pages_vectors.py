"""WARC archives, page extraction and nearest neighbours."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, extract, warc
from quillspark.llm.boosting import Boosted
from quillspark.llm.dom import block_text, read
from quillspark.llm.hilbert import hilbert_keys

from .conftest import clashing

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HUGE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    rows = [(i, f"http://x/{i}", "é" * i * 20) for i in range(40)]
    rows += [(100, "u", RECORD * 3 + "tail"), (101, None, None), (102, "a\r\nb", "WARC/1.1\r\n"), (103, "u", "x" * 2000 + RECORD + "y" * 7000), (104, "u", "z" * 1500), (105, "u", "z" * 1500), (106, "u", HUGE + "q" * 9000 + RECORD), (None, "u", "nn"), (107, "u", "q" * 999), (108, "u", "q" * 999), (109, "u", "z" * 1500)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # records go across splits
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
        got = {r.page_id: r for r in warc.archive_round_trip(df, compression).collect()}
        empty = warc.archive_round_trip(df.limit(0), compression).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and empty == 0
    for i, _, h in rows:
        body = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest()) and r.stated_digest == r.payload_digest
        assert (r.record_type, r.refers_to) == (("revisit", 109) if i in (104, 105) else ("response", None))
    assert got[102].uri == "a%0D%0Ab"


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", "x" * 2000)] * 2 + [(2, "u", "")] * 2, "page_id long, url string, html string")
    got = warc.archive_round_trip(df).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (1, "response"), (2, "response"), (2, "response")]


def test_pointer_jumping():
    starts, successors = np.array([0, 10, 20, 25, 30]), np.array([10, 30, 25, 99, 40])
    assert warc.reachable(starts, successors).tolist() == [True, True, False, False, True]
    n = 5000
    assert warc.reachable(np.arange(n), np.arange(n) + 1).all()
    assert warc.reachable(np.arange(0), np.arange(0)).tolist() == []


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no</title>{head}</head><body>{body}</body></html>"


NAV, FOOT = "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav>", "<footer>&copy; 2024 Somebody, all rights.</footer>"
PARAS = "<p>First paragraph of the story, with some words in it.</p><p>Second &amp; last one,<br>on two lines.</p>"


def test_extraction(spark):
    want = "A title\nFirst paragraph of the story, with some words in it.\nSecond & last one, on two lines."
    rows = [
        (1, "u", page(NAV + '<div class="ad">Buy this now, it is cheap.</div><article><h1>A title</h1>' + PARAS + "</article>" + FOOT)),
        (2, "u", page(NAV + "<article><h1>A title</h1>" + PARAS + "</article><section class='comments'><h3>Comments</h3><div class='comment'><p>I like it a lot.</p></div></section>" + FOOT)),
        (3, "u", page("<header><h1><a href='/'>Site</a></h1></header>" + NAV + "<aside class='sidebar'><h3>Popular</h3><ul><li><a href='/x'>Other story</a></li></ul></aside><article><h1>A title</h1>" + PARAS + "<div class='ad'>Sponsored thing here.</div></article><form><label>Mail</label><input><button>Go</button></form><div class='cookie-notice'><p>We use cookies.</p></div>" + FOOT)),
        (4, None, None), (5, "u", ""), (6, "u", "   "), (7, "u", "<p"), (7, "u", "<p"), (None, "u", page("<script>var a='</p>text';</script>")),
    ]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in extract.extract(df).collect()}
    for i in (1, 2, 3):
        assert got[i].text == want and got[i].n_chars == len(want)
    for i in (4, 5, 6, 7, None):
        assert got[i].text == "" and got[i].n_chars == 0
    assert extract.extract(df).count() == len(rows) and extract.extract(df.limit(0)).count() == 0


def test_held_out_pages():
    """Pages of the generator with another seed: nearly all right, and characters of main text found and left out rightly."""
    model, writer = extract.trained(), extract.Writer(random.Random(1234))
    right = same = found = wanted = 0
    for _ in range(150):
        p = writer.page()
        nodes, blocks = read(p)
        want = [block_text(b) for n, b in blocks if "data-y=1" in nodes[n].attrs]
        got = extract.main_texts([p], model)[0].split("\n")
        right += [w for w in want if w] == [g for g in got if g]
        same += sum(len(g) for g in got if g in want)
        found += sum(map(len, got))
        wanted += sum(map(len, want))
    assert right >= 140 and same / found > 0.98 and same / wanted > 0.98


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(0)
    writer = extract.Writer(random.Random(3))
    for _ in range(20):
        nodes, _ = read(writer.page())
        kept = extract.decode(nodes, rng.normal(0, 2, len(nodes) - 1))
        assert all(not kept[i] or kept[nodes[i].parent] for i in range(1, len(nodes)))


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert len(read(deep)[0]) == 3001
    assert len(extract.main_texts([page("<article>" + "<p>words and more words here.</p>" * 5000 + "</article>")], extract.trained())[0].split("\n")) == 5000


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted(trees=40).fit(x[:1000], y[:1000])
    assert ((model.log_odds(x[1000:]) > 0) == y[1000:]).mean() > 0.95


def test_hilbert_is_a_curve():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("clustered", [True, False])
def test_search_recall(spark, clustered):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    if clustered:
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] * 4 + x * 0.3
    x = x.astype(np.float32)
    x[700] = x[0]
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = ann.search(df, F.col("vec_id") % 50 == 0, 10, part_rows=128).collect()
    full = x.astype(float) @ x.T.astype(float)
    hits = n = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - full[q, r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = [i for i in np.lexsort((np.arange(1500), -full[q])) if i != q][:10]
        hits += len(set(best) & {r.vec_id for r in mine})
        n += 10
    assert hits / n >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [], 0), (9, [1.0, 1.0, 1.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert ann.search(vectors(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors(spark, rows[3:5]), F.col("vec_id") % 20 == 0).count() == 0
