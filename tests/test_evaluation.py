import pytest

from quillspark import constants
from quillspark.operators import evaluation
from quillspark.operators.classify import hash_encoder
from quillspark.plans.similarity import cached_vectors, compare
from quillspark.sources.fetch import fetch


def test_vectors_are_judged(spark):
    v = spark.createDataFrame([("данные", [1.0, 0.0]), ("субъект", [0.9, 0.1]), ("связь", [0.0, 1.0]), ("сеть", [0.1, 0.9])], "word string, vector array<double>")
    groups, pairs = constants.groups(spark), constants.pairs(spark)
    r = evaluation.evaluate(v, groups, pairs, "m", typo=constants.TYPO).first()
    assert (r.model, r.vocabulary_size, r.oov_typo_supported) == ("m", 4, False)
    assert r.evaluation_coverage == round(4 / len({w for g in constants.EVALUATION_GROUPS.values() for w in g}), 3)
    assert r.mean_association_cosine is None and r.mean_group_precision_at_5 == 0.2  # one of five, each
    extra = spark.createDataFrame([(constants.TYPO, [1.0, 0.0])], "word string, vector array<double>")
    assert evaluation.evaluate(v, groups, spark.createDataFrame([("данные", "субъект")], "a string, b string"), "f", extra, constants.TYPO).first().oov_typo_supported
    near = evaluation.nearest(evaluation.word_questions(v, groups), v, 2).filter("question = 'данные'").orderBy("rank").collect()
    assert [x.word for x in near] == ["субъект", "сеть"]


def test_equations(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [1.0, -1.0])], "word string, vector array<double>")
    q = evaluation.equation_questions(v, [("a - b", ("a",), ("b",)), ("unknown", ("a",), ("z",))])
    got = evaluation.nearest(q, v, 1).collect()
    assert [(r.question, r.word, r.cosine) for r in got] == [("a - b", "d", 1.0)]


def test_representations_are_compared(spark):
    rows = [(f"{g}{i}", g, f"{w} общий текст {w} {w} номер") for g, w in (("x", "данные"), ("y", "связь")) for i in range(3)]
    texts = spark.createDataFrame(rows, "article_id string, document_id string, text string")
    got = {r.model: r for r in compare(texts, "document_id", "article_id", hash_encoder(32), 32).collect()}
    assert got["tfidf"].precision_at_k == 1.0 and got["tfidf"].separation > 0.3 and set(got) == {"tfidf", "encoder"}


def test_vectors_are_kept(spark, tmp_path):
    texts = spark.createDataFrame([(1, "раз два"), (2, "три")], "doc_id int, text string")
    first = cached_vectors(texts, hash_encoder(8), 8, str(tmp_path), "m", "doc_id")
    again = cached_vectors(texts, hash_encoder(8), 8, str(tmp_path), "m", "doc_id")
    other = cached_vectors(texts.limit(1), hash_encoder(8), 8, str(tmp_path), "m", "doc_id")
    assert (first[1], again[1], other[1]) == (False, True, False) and again[0].count() == 2


def test_pages_are_fetched_once(tmp_path):
    page = b'<div class="text_upd"><article><p>x</p></article></div>'
    asked = []

    def transport(url):
        asked.append(url)
        if url.endswith("robots.txt"):
            return "text/plain", b"User-agent: *\nDisallow: /no/"
        return ("application/pdf" if url.endswith("pdf") else "text/html; charset=utf-8"), page if "bad" not in url else b"<p>none</p>"

    source = lambda i, u: {"id": i, "title": i, "topic": "t", "url": u}
    two = [source("a", "https://x.test/a"), source("b", "https://x.test/b")]
    assert fetch(two, str(tmp_path), transport, delay=0) == ["a", "b"]
    assert fetch(two, str(tmp_path), transport, delay=0) == [] and len(asked) == 3
    assert fetch(two[:1], str(tmp_path), transport, refresh=True, delay=0) == ["a"]
    for url, error in (("https://x.test/no/c", PermissionError), ("https://x.test/c.pdf", ValueError), ("https://x.test/bad", ValueError)):
        with pytest.raises(error):
            fetch([source("c", url)], str(tmp_path), transport, delay=0)
    assert not (tmp_path / "c.html").exists()
