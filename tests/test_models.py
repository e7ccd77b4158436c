import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, cooccurrence, embeddings, experiments, metrics, retrieval, splits


def vectors(spark, rows, key="word"):
    return spark.createDataFrame(rows, f"{key} string, vector array<float>")


def test_weighted_means_and_search(spark):
    v = vectors(spark, [("данные", [1.0, 0.0]), ("согласие", [0.8, 0.2]), ("связь", [0.0, 1.0])])
    idf = spark.createDataFrame([("данные", 2.0), ("согласие", 1.0), ("связь", 1.0)], "term string, idf double")
    tokens = spark.createDataFrame([("a", "данные"), ("a", "согласие"), ("b", "связь"), ("c", "неизвестно")], "doc_id string, term string")
    got = {r.doc_id: r.vector for r in embeddings.weighted_means(tokens, v, idf, 2).collect()}
    assert set(got) == {"a", "b"} and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in got.values())
    rows = spark.createDataFrame(list(got.items()), "article_id string, vector array<double>")
    found = retrieval.search(rows, [1.0, 0.0], 2, "article_id").orderBy("rank").collect()
    assert [r.article_id for r in found] == ["a", "b"]


def test_pooled(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "owner int, vector array<double>")
    assert {r.owner: r.vector for r in embeddings.pooled(rows, 2, "owner").collect()} == {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.0, 0.0]}


def test_neighbours_and_separation(spark):
    rng = np.random.default_rng(0)
    data = [(f"{g}{i}", g, (np.eye(2)[k] + rng.normal(0, 0.01, 2)).tolist()) for k, g in enumerate("ab") for i in range(3)]
    df = spark.createDataFrame(data, "id string, document_id string, vector array<double>")
    found = retrieval.neighbours(df, 2, "id")
    got = retrieval.judged(found, df, "id", "document_id", 2).first()
    assert (got.precision_at_k, got.hit_rate_at_k) == (1.0, 1.0)
    assert retrieval.separation(df, "document_id", 2).first().separation > 0.9


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "truth string, prediction string")
    assert tuple(metrics.macro(rows).first()) == (1.0, 1.0, 1.0, 1.0)
    rows = spark.createDataFrame([("a", "a"), ("a", "z")], "truth string, prediction string")
    assert metrics.macro(rows).first().recall_macro == 0.25
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    got = {r.label: r.support for r in metrics.report(rows, labels).collect()}
    assert got == {"a": 2, "b": 0, "macro avg": 2, "weighted avg": 2}
    assert [tuple(r) for r in metrics.confusion(rows, ["a", "b"]).orderBy("truth").collect()] == [("a", 1.0, 0.0), ("b", 0.0, 0.0)]


def test_class_weights(spark):
    got = {r.label: r.weight for r in metrics.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int"), "label").collect()}
    assert got[1] == 2.0 and abs(got[0] - 2 / 3) < 1e-9


def test_probabilities(spark):
    rows = spark.createDataFrame([("d", c, lab, z) for c in (0, 1) for lab, z in (("a", 0.0), ("b", 2.0))], "id string, chunk int, label string, logit double")
    got = metrics.article_probabilities(rows, "id").orderBy("rank").collect()
    assert got[0].label == "b" and got[0].probability > 0.8 and abs(sum(r.probability for r in got) - 1) < 1e-5


def test_balanced_pick(spark):
    rows = [(d, f"{d}:{n}", n) for d in "abcde" for n in (60, 80, 110, 160, 240, 300)]
    got = splits.balanced_pick(spark.createDataFrame(rows, "document_id string, article_id string, n int"), "document_id", "n", "article_id").collect()
    assert len(got) == 15 and {r.n for r in got} == {80, 160, 240}
    with pytest.raises(Exception, match="three"):
        splits.balanced_pick(spark.createDataFrame([("a", "x", 100)], "document_id string, article_id string, n int"), "document_id", "n", "article_id").collect()


def test_splits(spark):
    rows = spark.createDataFrame([(d, f"{d}{i}") for d in "abc" for i in range(12)], "document_id string, article_id string")
    got = splits.stratified_split(rows, "document_id", "article_id").collect()
    test = {r.article_id for r in got if r.split == "test"}
    assert len(got) == 36 and len(test) == 9 and {r.document_id for r in got if r.split == "test"} == set("abc")
    odd = spark.createDataFrame([("a", f"a{i}") for i in range(7)] + [("b", f"b{i}") for i in range(6)], "document_id string, article_id string")
    assert sum(r.split == "test" for r in splits.stratified_split(odd, "document_id", "article_id").collect()) == 4
    half = splits.stratified_subset(spark.createDataFrame([(d, f"{d}{i}") for d in "abc" for i in range(10)], "d string, k string"), "d", "k", 0.5)
    assert {r["count"] for r in half.groupBy("d").count().collect()} == {5}
    assert splits.stratified_subset(spark.createDataFrame([("a", "x")], "d string, k string"), "d", "k", 0.1).count() == 1


def test_grid(spark):
    rows = experiments.grid(spark).collect()
    points = {(r.learning_rate, r.fraction) for r in rows}
    assert len(rows) == 5 == len(points) and (3e-5, 1.0) in points


def test_best_run_takes_first(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, f1 double")
    assert metrics.best_run(rows, "f1", "epoch").first().epoch == 2


def test_glove_learns(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c", "d"] * 5) for i in range(5)], "doc_id int, tokens array<string>")
    words, losses = cooccurrence.train_glove(cooccurrence.cooccurrence(docs), size=8, epochs=10)
    loss = [r.loss for r in losses.orderBy("epoch").collect()]
    assert loss[-1] < loss[0] and words.count() == 4 and len(words.first().vector) == 8
    with pytest.raises(ValueError):
        cooccurrence.train_glove(cooccurrence.cooccurrence(docs.limit(0)))


def test_cooccurrence_renumbers_after_rare_words(spark):
    docs = spark.createDataFrame([(1, ["a", "rare", "b"]), (2, ["a", "b"]), (3, ["a", "b"])], "doc_id int, tokens array<string>")
    got = {(r.center, r.context): r.weight for r in cooccurrence.cooccurrence(docs).collect()}
    assert got == {("a", "b"): 3.0, ("b", "a"): 3.0}


def test_subwords(spark):
    v = vectors(spark, [("данные", [1.0, 0.0]), ("связь", [0.0, 1.0])])
    table = embeddings.subword_table(v, 2)
    got = {r.word: r.vector for r in embeddings.subword_vectors(spark.createDataFrame([("данных",), ("zzz",)], "word string"), table, 2).collect()}
    assert got["данных"] is not None and got["zzz"] is None


def test_logistic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], (np.eye(2)[i % 2] + rng.normal(0, 0.1, 2)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string, vector array<double>")
    out = classify.predict(df, classify.fit_logistic(df, "label"))
    assert out.filter("label = prediction").count() == 40


def test_score_texts(spark):
    texts = spark.createDataFrame([(1, "достаточно длинный текст для проверки оценки"), (2, "ещё один текст, который тоже достаточно длинный")], "doc_id int, text string")
    scorer = lambda: lambda parts: np.array([[0.0, 2.0]] * len(parts))
    got = classify.score_texts(texts, scorer, ["class_a", "class_b"]).filter("doc_id = 1").orderBy("rank").collect()
    assert got[0].label == "class_b" and got[0].probability > 0.8 and abs(sum(r.probability for r in got) - 1) < 1e-9 and got[0].level == "высокая"


def test_fingerprint_depends_on_order_of_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "o int, text string")
    b = spark.createDataFrame([(2, "x"), (1, "y")], "o int, text string")
    f = lambda d: splits.fingerprint(d, "o", "text").first().fingerprint
    assert f(a) == f(a.repartition(3)) != f(b)


def test_first_per_class(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "i int, label string")
    assert [r.i for r in splits.first_per_class(rows, "label", "i", 2).collect()] == [0, 1]


def test_mean_loss(spark):
    assert metrics.mean_loss(spark.createDataFrame([(1.0, 1), (4.0, 2)], "loss double, n int")).first().loss == 3.0
    assert F is not None
