"""Dictionaries, saved models, contexts, search and the TF-IDF arm, on small tables."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as command
from quillspark.operators import classify, context, cooccurrence, embeddings, lemmas, tfidf
from quillspark.plans import analysis, search
from quillspark.profiles import GENERIC
from quillspark.sources import models

WORDS = ["art", "law", "data", "person", "tax", "rate", "fine", "court"]


def texts(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(f"a{i}", f"d{i % 2}", " ".join(rng.choice(WORDS[:5] if i % 2 else WORDS[3:], 12)), 12) for i in range(n)]
    return spark.createDataFrame(rows, "article_id string, document_id string, text string, clean_word_count long"), rows


def test_dictionary(spark):
    dictionary = spark.createDataFrame([("laws", "law", "N", "pl"), ("laws", "lawe", "V", None), ("rate", "rate", "V", None), (None, "x", "y", "z")], "form string, lemma string, pos string, case string")
    rows = spark.createDataFrame([(1, ["laws", "rate", "laws", "zz"]), (2, []), (3, None), (None, ["laws"])], "id int, tokens array<string>")
    got = {r.id: r.tags for r in lemmas.tag(rows.filter("id is not null"), dictionary, "id").collect()}
    assert [tuple(x) for x in got[1]] == [("law", "N", "pl"), ("rate", "V", None), ("law", "N", "pl"), ("zz", None, None)]
    assert got[2] == [] and got[3] is None
    counts = lemmas.tag_counts(lemmas.tag(rows.filter("id = 1"), dictionary, "id"), "pos", "case").collect()
    assert {(r.pos, r.case): r.n for r in counts} == {("N", "pl"): 2, ("V", None): 1, (None, None): 1}
    assert [r.tags for r in lemmas.tag(rows.filter("id = 1"), dictionary.limit(0), "id").collect()] == [[(w, None, None) for w in ("laws", "rate", "laws", "zz")]]


def test_saved_classifier(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"c{i % 3}", (np.eye(3)[i % 3] + rng.normal(0, 0.1, 3)).tolist()) for i in range(60)], "label string, vector array<double>")
    model = classify.fit_logistic(rows, "label")
    models.save_classifier(model, str(tmp_path / "m"))
    again = models.load_classifier(spark, str(tmp_path / "m"))
    own, other = (classify.predict(rows, m).select("prediction", "confidence").collect() for m in (model, again))
    assert own == other
    with pytest.raises(FileNotFoundError):
        models.load_classifier(spark, str(tmp_path / "none"))


def test_saved_word_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(WORDS,)] * 5, "tokens array<string>")
    model = embeddings.word2vec(docs, size=4, epochs=1)
    models.save_word2vec(model, str(tmp_path / "w"))
    got = {r.word: r.vector for r in models.load_word2vec(spark, str(tmp_path / "w")).collect()}
    assert got == {r.word: list(r.vector) for r in model.getVectors().collect()} and set(got) == set(WORDS)


def test_context(spark):
    rows = spark.createDataFrame([("a", "One operator works."), ("b", "Operators film a scene."), ("c", "One operator works.")], "id string, text string")
    encoder = context.hash_token_encoder(8)
    got = {r.id: np.array(r.vector) for r in context.word_in_context(rows, "operator", encoder, "id").collect()}
    (_, hidden), (_, other) = encoder()(["One operator works.", "Operators film a scene."])
    assert np.allclose(got["a"], hidden[1] / np.linalg.norm(hidden[1])) and np.allclose(got["b"], other[0] / np.linalg.norm(other[0]))
    matrix = context.cosine_matrix(spark.createDataFrame([(k, v.tolist()) for k, v in got.items()], "id string, vector array<double>"), "id")
    cosines = np.array([r.cosines for r in matrix.orderBy("id").collect()])
    assert np.allclose(cosines, [[got[a] @ got[b] for b in "abc"] for a in "abc"], atol=1e-6) and cosines[0, 2] == 1
    with pytest.raises(Exception, match="lacks the word"):
        context.word_in_context(spark.createDataFrame([("a", None)], "id string, text string"), "operator", encoder, "id").collect()


def test_tfidf_vectors_and_arm(spark):
    docs, rows = texts(spark)
    docs = docs.union(spark.createDataFrame([("empty", "d0", "1 2 3", 3)], docs.schema))
    found = analysis.tfidf_experiment(docs)
    train = {r.article_id for r in found["split"].filter("split = 'train'").collect()}
    terms = {a: Counter(w := t.split()) + Counter(f"{x} {y}" for x, y in zip(w, w[1:])) for a, _, t, _ in rows} | {"empty": Counter()}
    n = len(train)
    df = Counter(x for a in train for x in terms[a])
    known = sorted(x for x, k in df.items() if 2 <= k <= 0.98 * n)
    for r in found["vectors"].collect():
        raw = np.array([(1 + math.log(terms[r.article_id][x])) * (math.log((1 + n) / (1 + df[x])) + 1) if terms[r.article_id][x] else 0.0 for x in known])
        assert np.allclose(r.vector.toArray(), raw / (np.linalg.norm(raw) or 1))
    assert found["vectors"].count() == 41 and found["metrics"].first().f1_macro > 0.9
    both = {r.model: r.f1_macro for r in analysis.model_comparison(docs, classify.hash_encoder(16), 16).collect()}
    assert set(both) == {"tfidf", "encoder"} and both["tfidf"] == found["metrics"].first().f1_macro


def test_search_index_and_command(spark, tmp_path, capsys):
    docs, _ = texts(spark)
    articles = analysis.preprocess(docs, GENERIC).withColumn("document_title", F.col("document_id"))
    words = spark.createDataFrame([(w, np.eye(8)[i].tolist()) for i, w in enumerate(WORDS)], "word string, vector array<double>")
    tokens = articles.select("article_id", F.explode("lemmas").alias("term"))
    idf = tfidf.idf_from_counts(tfidf.term_frequencies(tokens, "article_id"), docs.count())
    search.save_index(str(tmp_path / "i"), words, idf, articles, 8)
    got = search.search(spark, str(tmp_path / "i"), "Court, rate!", 3, GENERIC).collect()
    assert [r.rank for r in got] == [1, 2, 3] and all(r.document_id == "d0" for r in got)
    assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)
    with pytest.raises(ValueError, match="no known word"):
        search.search(spark, str(tmp_path / "i"), "unknown", 3, GENERIC)
    with pytest.raises(ValueError, match="positive"):
        search.search(spark, str(tmp_path / "i"), "court", 0, GENERIC)
    with pytest.raises(FileNotFoundError):
        search.search(spark, str(tmp_path / "none"), "court", 3, GENERIC)


def test_commands_in_this_process(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("quillspark.session.local_session", lambda *_: spark)
    docs, _ = texts(spark, 6)
    words = spark.createDataFrame([(w, np.eye(8)[i].tolist()) for i, w in enumerate(WORDS)], "word string, vector array<double>")
    search.save_index(str(tmp_path / "i"), words, spark.createDataFrame([("art", 2.0)], "term string, idf double"), analysis.preprocess(docs, GENERIC), 8)
    assert command.main(["search", str(tmp_path / "i"), "court", "--top", "2", "--profile", "generic"]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("1. ") and "\n2. " in shown and "\n3. " not in shown
    assert command.main(["search", str(tmp_path / "none"), "court"]) == 1
    raw = tmp_path / "raw"
    raw.mkdir()
    page = '<html><body><div class="text_upd"><article><h1>Act</h1><p>one two three four five six</p></article></div></body></html>'
    import hashlib

    (raw / "x.html").write_text(page)
    (raw / "x.meta.json").write_text(json.dumps({"url": "https://example.org/x", "fetched_at_utc": "2026", "sha256": hashlib.sha256(page.encode()).hexdigest()}))
    (tmp_path / "sources.json").write_text(json.dumps([{"id": "x", "title": "t", "topic": "p", "url": "https://example.org/x"}]))
    arguments = ["corpus", str(tmp_path / "sources.json"), str(raw), str(tmp_path / "out"), "--profile", "generic", "--least-document", "5"]
    assert command.main([*arguments, "--least", "5"]) == 0 and command.main(arguments) == 1
    summary = json.loads(spark.read.text(str(tmp_path / "out" / "corpus_summary.json")).first()[0])
    assert summary["document_count"] == 1 and summary["total_words"] == 7 and summary["documents"][0]["id"] == "x"


def glove_pairs(spark, n=24):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(f"w{a}", f"w{b}", float(rng.integers(1, 30)) * (3 if (a < n // 2) == (b < n // 2) else 1)) for a in range(n) for b in range(n) if a != b], "center string, context string, weight double")


def test_glove_by_blocks(spark):
    """Any number of blocks learns all words, each epoch sees each pair once, and a second run gives the same numbers."""
    pairs = glove_pairs(spark)
    one = cooccurrence.train_glove(pairs, size=8, epochs=6)
    many = cooccurrence.train_glove(pairs, size=8, epochs=6, terms=7)
    again = cooccurrence.train_glove(pairs, size=8, epochs=6, terms=7)
    for words, losses in (one, many):
        got = {r.word: np.array(r.vector) for r in words.collect()}
        assert set(got) == {f"w{i}" for i in range(24)} and all(len(v) == 8 and np.isfinite(v).all() for v in got.values())
        loss = [r.loss for r in losses.orderBy("epoch").collect()]
        assert len(loss) == 6 and loss[-1] < loss[0]
    assert {r.word: r.vector for r in many[0].collect()} == {r.word: r.vector for r in again[0].collect()}
    assert many[1].collect() == again[1].collect()
    first = [f[1].filter("epoch = 1").first().loss for f in (one, many)]
    assert abs(first[0] - first[1]) < 0.35 * first[0]  # the same sum over the same pairs, in another order
    first_loss_without_training = [cooccurrence.train_glove(pairs, size=8, epochs=1, rate=0.0, terms=k)[1].first().loss for k in (7, 100)]
    x = np.array([r.weight for r in pairs.collect()])
    expected = 0.5 * float((np.minimum(1, (x / 100) ** 0.75) * np.log(x) ** 2).mean())
    assert all(abs(v - expected) < 0.05 * expected for v in first_loss_without_training)
