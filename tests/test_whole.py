"""Registered queries over small tables that are larger than the cuts they once had, against brute force."""

from collections import Counter, defaultdict
from math import log

import numpy as np

from quillspark import registry
from quillspark.operators import embeddings


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def word(i):
    return "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_word_vectors_have_no_cap(spark, tmp_path):
    terms = [word(i) for i in range(700)]
    texts = [" ".join(w for i, w in enumerate(terms) if i % 7 != k for _ in range(1 + (i < 20))) for k in range(5)] + ["zqqqqz zqqqqz", "zqqqqz", "none"]
    vectors = np.random.default_rng(3).normal(size=(900, 4)).astype(np.float32)
    d = written(spark, tmp_path, documents=([(k, x, "en", "s") for k, x in enumerate(texts)], DOCUMENTS), embeddings=([(i, i % 3, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>"))
    tf = [Counter(x.split()) for x in texts]
    df, total = Counter(w for c in tf for w in c), sum(tf, Counter())
    known = {w: i for i, w in enumerate(sorted((w for w in df if 2 <= df[w] <= 0.95 * len(tf)), key=lambda w: (-total[w], w)))}
    assert len(known) == 701 and known["zqqqqz"] > 500
    want = {}
    for k, c in enumerate(tf):
        v = sum((n * (log((1 + len(tf)) / (df[w] + 1)) + 1) * vectors[known[w]].astype(float) for w, n in c.items() if w in known), np.zeros(4))
        if v.any():
            want[k] = float((v / np.linalg.norm(v)) @ np.arange(1, 5))
    got = {r.doc_id: r.moment for r in registry.queries()["weighted_doc_vectors"](spark, d).collect()}
    assert set(got) == set(want) and {5, 6} <= set(got) and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    supported = {r.word: r.supported for r in registry.queries()["fasttext_oov"](spark, d).collect()}
    assert supported["qqqq"] and not supported["ation"]


def test_cooccurrence_table_has_every_pair(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [" ".join(word(i) for i in rng.zipf(1.3, 120) % 400) for _ in range(40)] + ["", "alone"]
    d = written(spark, tmp_path, documents=([(k, x, "en", "s") for k, x in enumerate(texts)], DOCUMENTS))
    n = Counter(w for x in texts for w in x.split())
    want = defaultdict(float)
    for x in texts:
        kept = [w for w in x.split() if n[w] >= 3]
        for i, a in enumerate(kept):
            for j in range(max(0, i - 5), min(len(kept), i + 6)):
                if j != i:
                    want[a, kept[j]] += 1 / abs(i - j)
    rows = registry.queries()["cooccurrence_table"](spark, d).collect()
    got = {(r.center, r.context): r.weight for r in rows}
    assert len(rows) == len(got) == len(want) > 1000 and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_trained_vectors_are_of_the_whole_job(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    texts = ["the " + " ".join(word(i) for i in rng.integers(0, 60, 12)) for _ in range(30)]
    d = written(spark, tmp_path, documents=([(k, x, "en", "s") for k, x in enumerate(texts)], DOCUMENTS))
    n = Counter(w for x in texts for w in x.split())
    rows = registry.queries()["glove_losses"](spark, d).collect()
    vectors, losses = {r.word: r.vector for r in rows if r.word is not None}, {r.epoch: r.loss for r in rows if r.epoch is not None}
    assert set(vectors) == {w for w in n if n[w] >= 3} and {len(v) for v in vectors.values()} == {100}
    assert set(losses) == set(range(1, 36)) and losses[35] < losses[1]
    models, fit = [], embeddings.word2vec
    monkeypatch.setattr(embeddings, "word2vec", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    assert registry.queries()["word2vec_neighbours"](spark, d).count() == 8
    assert models[0].getMaxIter() == 80 and models[0].getVectorSize() == 100


def test_word_neighbours_are_the_nearest_and_the_same_each_time(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["the " + " ".join(word(i) for i in rng.integers(0, 20, 12)) for _ in range(60)] + ["only four words here", "", None]
    d = written(spark, tmp_path, documents=([(k, x, "en", "s") for k, x in enumerate(texts)], DOCUMENTS))
    models, fit = [], embeddings.word2vec
    monkeypatch.setattr(embeddings, "word2vec", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    first, again = ([(r.word, r.cosine) for r in registry.queries()["word2vec_neighbours"](spark, d).collect()] for _ in range(2))
    assert first == again
    losses = {r.epoch: r.loss for r in models[0].losses.collect()}
    assert set(losses) == set(range(1, 81)) and losses[80] < losses[1]
    v = {r.word: np.array(r.vector, float) for r in models[0].getVectors().collect()}
    assert set(v) == {"the"} | {word(i) for i in range(20)}
    near = {w: x @ v["the"] / np.linalg.norm(x) / np.linalg.norm(v["the"]) for w, x in v.items() if w != "the"}
    assert [w for w, _ in first] == sorted(near, key=lambda w: (-near[w], w))[:8] and all(abs(near[w] - c) < 1e-4 for w, c in first)


def test_sections_and_reports_of_all_documents(spark, tmp_path):
    rng = np.random.default_rng(11)
    line = lambda: rng.choice(["Of.", "Erreth was.", "Nicht zwei Worte.", "four words with not here.", "a small not.", "Two. Sentences.", "Éa über ça."])
    texts = ["\n".join(line() for _ in range(n)) for n in (1, 3, 8, 20, 300)] + ["plain text with no heading\nand more", ""]
    d = written(spark, tmp_path, documents=([(k, x, "en", "s") for k, x in enumerate(texts)], DOCUMENTS))
    want = set()
    for k, x in enumerate(texts):
        parts, lines = [], [y for y in x.split("\n") if y]
        for y in lines:
            words = y[:-1].split(" ")
            if y[-1] == "." and len(words) <= 3 and all(w.isalpha() for w in words) and y[0].isupper():
                parts.append((words[0], " ".join(words[1:]), []))
            elif parts:
                parts[-1][2].append(y)
        if lines and not parts:
            parts = [(None, None, lines)]
        want |= {(k, i + 1, n, title, "\n".join(body)) for i, (n, title, body) in enumerate(parts)}
    got = registry.queries()["document_sections"](spark, d).collect()
    assert len(got) == len(want) > 100 and {(r.doc_id, r.ordinal, r.number, r.section_title, r.text) for r in got} == want
    reports = {r.source_file: r.markdown for r in registry.queries()["document_reports"](spark, d).collect()}
    assert set(reports) == {str(k) for k in range(len(texts))}
    for k in range(len(texts)):
        assert reports[str(k)].count("\n## ") == sum(w[0] == k for w in want)
