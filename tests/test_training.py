"""Training by gradient: single steps against plain Python, restarts, and experiments in the same passes."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cooccurrence, finetune, rotation, skipgram
from quillspark.operators.finetune import Run, Settings, Trainer
from quillspark.operators.rotation import Side


def numeric(loss, x, e=1e-6):
    out = np.zeros_like(x)
    for at in np.ndindex(x.shape):
        a, b = x.copy(), x.copy()
        a[at] += e
        b[at] -= e
        out[at] = (loss(a) - loss(b)) / (2 * e)
    return out


# --- rotating blocks ---------------------------------------------------------------------------------------------------


def test_batches_hold_each_pair_once_in_runs_of_a_word():
    rng = np.random.default_rng(0)
    i = rng.integers(0, 30, 500)
    parts = rotation.batches(i, 4, 64, rng)
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and all(len(p) <= 64 + 4 for p in parts)
    runs = [int((np.diff(i[p]) != 0).sum()) + 1 for p in parts]
    assert sum(runs) >= 500 / 4 and sum(runs) < 350
    assert rotation.batches(i[:0], 4, 64, rng) == []


def test_a_step_sums_the_gradients_of_a_row():
    value, seen = np.zeros((3, 2), np.float32), np.ones((3, 2), np.float32)
    rotation.descend(value, seen, np.array([2, 0, 2]), np.array([[1, 2], [3, 4], [5, 6]], np.float32), 0.1)
    want = [[-0.1 * 3 / math.sqrt(10), -0.1 * 4 / math.sqrt(17)], [0, 0], [-0.1 * 6 / math.sqrt(37), -0.1 * 8 / math.sqrt(65)]]
    assert np.allclose(value, want, atol=1e-6) and np.allclose(seen, [[10, 17], [1, 1], [37, 65]])


def test_glove_pass_against_plain_python():
    rng = np.random.default_rng(1)
    main, other = (Side(0, rng.normal(0, 0.3, (4, 4)).astype(np.float32), np.ones((4, 4), np.float32), b"") for _ in range(2))
    u, v = main.value.astype(float), other.value.astype(float)
    i, j, x = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 0]), np.array([5.0, 200.0, 1.5, 40.0], np.float32)
    du, dv, want = np.zeros((4, 4)), np.zeros((4, 4)), 0.0
    for a, b, n in zip(i, j, x.astype(float)):
        error = sum(u[a, d] * v[b, d] for d in range(3)) + u[a, 3] + v[b, 3] - math.log(n)
        weight = min(1.0, (n / 100) ** 0.75)
        want += 0.5 * weight * error**2
        for d in range(3):
            du[a, d] += weight * error * v[b, d]
            dv[b, d] += weight * error * u[a, d]
        du[a, 3] += weight * error
        dv[b, 3] += weight * error
    loss = cooccurrence.glove_pass(0.05, 100.0, 0.75)(i, j, x, main, other, None, rng)
    assert abs(loss - want) < 1e-5 * want
    assert np.allclose(main.value, u - 0.05 * du / np.sqrt(1 + du**2), atol=1e-5) and np.allclose(other.value, v - 0.05 * dv / np.sqrt(1 + dv**2), atol=1e-5)


def test_skip_gram_gradients_against_differences():
    rng = np.random.default_rng(2)
    u, v, asked, noise = rng.normal(0, 1, (5, 3)), rng.normal(0, 1, (5, 3)), rng.normal(0, 1, (2, 3)), rng.normal(0, 1, (4, 3))
    x = rng.uniform(0.2, 3, 5)

    def loss(u=u, v=v, asked=asked, noise=noise):
        total = sum(w * math.log(1 + math.exp(-sum(a * b for a, b in zip(p, q)))) for w, p, q in zip(x, u, v))
        return total + 0.7 * sum(math.log(1 + math.exp(sum(a * b for a, b in zip(p, q)))) for p in asked for q in noise)

    got = skipgram.gradients(u, v, x, asked, noise, 0.7)
    assert abs(got[0] - loss()) < 1e-9
    for name, g, start in zip(("u", "v", "asked", "noise"), got[1:], (u, v, asked, noise)):
        assert np.allclose(g, numeric(lambda z, name=name: loss(**{name: z}), start), atol=1e-6)


def test_alias_draws_by_mass():
    masses = np.array([5.0, 0.0, 1.0, 30.0, 4.0])
    alias = skipgram.Alias(masses)
    chance = np.bincount(np.arange(5), alias.keep, 5) / 5 + np.bincount(alias.other, (1 - alias.keep), 5) / 5
    assert np.allclose(chance, masses / masses.sum())
    assert set(alias.draw(1000, np.random.default_rng(0)).tolist()) == {0, 2, 3, 4}


def test_pieces_of_words_move_together():
    """A word's vector is the mean of its own and its n-grams'; a step moves each by its share of the gradient."""
    extra = np.array([1.0, 2.0], np.float32).tobytes() + np.array([2, 1], np.int32).tobytes() + np.array([0, 2, 2], np.int32).tobytes()
    side, grams = Side(0, np.eye(2, 3, dtype=np.float32), np.ones((2, 3), np.float32), extra), Side(0, np.arange(9, dtype=np.float32).reshape(3, 3), np.ones((3, 3), np.float32), b"")
    words = skipgram._Words(side, grams)
    assert np.allclose(words.vectors(np.array([0, 1])), [[(1 + 0 + 6) / 3, (0 + 1 + 7) / 3, (0 + 2 + 8) / 3], [3, (1 + 7) / 2, 4]])
    before = grams.value.copy()
    words.move(np.array([0, 1, 0]), np.array([[3, 0, 0], [2, 0, 0], [3, 0, 0]], np.float32), 0.1)
    move = lambda g: -0.1 * g / math.sqrt(1 + g * g)
    assert np.allclose(side.value[:, 0], [1 + move(2), move(1)]) and np.allclose((grams.value - before)[:, 0], [move(2), 0, move(3)], atol=1e-6)


def topics(spark, n=150):
    """Documents of two topics; words of a topic meet only each other."""
    r = random.Random(4)
    words = [["orange", "apple", "cherry", "banana", "melon", "grapes"], ["engine", "wheel", "brakes", "clutch", "piston", "valves"]]
    rows = [(k, [r.choice(words[k % 2]) for _ in range(12)]) for k in range(n)] + [(None, ["orange", "apple", "melon", "grapes", "cherry"]), (n, ["lonely", "two"]), (n + 1, None)]
    return words, spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_skip_gram_learns_topics(spark):
    words, docs = topics(spark)
    out = skipgram.train(docs, size=16, epochs=80, passes=20, rate=0.2, sample=0)
    v = {r.word: np.array(r.vector) for r in out["words"].collect()}
    assert set(v) == set(words[0] + words[1])
    same = np.mean([cosine(v[a], v[b]) for t in words for a in t for b in t if a != b])
    other = np.mean([cosine(v[a], v[b]) for a in words[0] for b in words[1]])
    assert same > other + 0.3
    losses = [r.loss for r in out["losses"].orderBy("epoch").collect()]
    assert len(losses) == 80 and losses[-1] < losses[0]
    again = skipgram.train(docs, size=16, epochs=80, passes=20, rate=0.2, sample=0)["words"]
    assert {r.word: r.vector for r in again.collect()} == {w: x.tolist() for w, x in v.items()}
    with pytest.raises(ValueError):
        skipgram.train(docs.filter("doc_id < 0"))


def test_n_grams_know_misspelt_words(spark):
    words, docs = topics(spark)
    out = skipgram.train(docs, size=16, epochs=80, passes=20, rate=0.2, n_buckets=2000, sample=0)
    v = {r.word: np.array(r.vector) for r in out["words"].collect()}
    asked = spark.createDataFrame([("orangge",), ("enginee",), ("appple",), ("orange",), ("#",)], "word string")
    got = {r.word: r.vector for r in skipgram.outside_words(asked, out["buckets"], 16, 2000).collect()}
    assert got["#"] is None
    for wrong, right in (("orangge", "orange"), ("enginee", "engine"), ("appple", "apple")):
        own = words[0] if right in words[0] else words[1]
        near = {w: cosine(got[wrong], x) for w, x in v.items()}
        assert max(near, key=near.get) == right and min(near[w] for w in own) > max(x for w, x in near.items() if w not in own)
    assert all(len(x) == 16 for x in v.values())


def test_rows_without_a_key_lose_their_rare_terms_too(spark):
    docs = spark.createDataFrame([(None, ["x", "a", "b"]), (None, ["a", "rare", "b"]), (1, ["a", "b", "rare"]), (2, ["a", "b"])], "doc_id long, tokens array<string>")
    got = {(r.center, r.context): r.weight for r in cooccurrence.cooccurrence(docs, least=3).collect()}
    assert got == {("a", "b"): 4.0, ("b", "a"): 4.0}


# --- a classifier's head ---------------------------------------------------------------------------------------------


def chunks(spark, n=60, width=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, c, f"c{k % 3}", (rng.normal(0, 0.6, width) + np.eye(width)[k % 3] * 2).tolist()) for k in range(n) for c in range(1 + k % 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, chunk_no int, label string, vector array<double>")


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    value = {n: rng.normal(0, 1, s) for n, s in (("w1", (4, 3)), ("b1", (3,)), ("w2", (3, 2)), ("b2", (2,)))}
    x, y, w = rng.normal(0, 1, (6, 4)), np.array([0, 1, 1, 0, 1, 1]), np.array([2.0, 0.5])

    def loss(v):
        total = 0.0
        for row, c in zip(x, y):
            h = [math.tanh(sum(row[k] * v["w1"][k, j] for k in range(4)) + v["b1"][j]) for j in range(3)]
            z = [sum(h[j] * v["w2"][j, c2] for j in range(3)) + v["b2"][c2] for c2 in range(2)]
            total -= w[c] * (z[c] - math.log(sum(map(math.exp, z))))
        return total

    got = finetune.gradient_sums(value, x, y, w)
    assert abs(got[0] - loss(value)) < 1e-9 and got[1] == w[y].sum() and got[2] == 6
    want = np.concatenate([numeric(lambda a, n=n: loss(value | {n: a}), value[n]).ravel() for n in finetune.NAMES])
    assert np.allclose(got[3:], want, atol=1e-6)


def test_one_step_of_adamw_by_hand():
    head = finetune.Head({"w1": np.array([[1.0, -2.0]]), "b1": np.array([0.5]), "w2": np.zeros((1, 1)), "b2": np.zeros(1)})
    grads = {"w1": np.array([[3.0, 4.0]]), "b1": np.array([0.0]), "w2": np.zeros((1, 1)), "b2": np.array([12.0])}
    finetune.adamw(head, grads, 1, 0.1, 0.01, 1.0)
    shrink = 1 / (13 + 1e-6)
    for name, at, old, g in (("w1", (0, 0), 1.0, 3.0), ("w1", (0, 1), -2.0, 4.0), ("b1", 0, 0.5, 0.0), ("b2", 0, 0.0, 12.0)):
        g *= shrink
        want = old * (1 - 0.1 * 0.01) - 0.1 * ((0.1 * g) / 0.1) / (math.sqrt(0.001 * g * g / 0.001) + 1e-8)
        assert abs(head.value[name][at] - want) < 1e-9
    finetune.adamw(head, grads, 2, 0.1, 0.01, 1.0)
    g = 12 * shrink
    m, s = 0.9 * 0.1 * g + 0.1 * g, 0.999 * 0.001 * g * g + 0.001 * g * g
    first = -0.1 * g / (math.sqrt(g * g) + 1e-8)
    assert abs(head.value["b2"][0] - (first * (1 - 0.001) - 0.1 * (m / (1 - 0.9**2)) / (math.sqrt(s / (1 - 0.999**2)) + 1e-8))) < 1e-9
    assert [round(finetune.rate_at(s, 10, 2, 1.0), 3) for s in (0, 1, 2, 6, 10)] == [0, 0.5, 1, 0.5, 0]


def test_training_restarts_and_shared_passes(spark, tmp_path):
    rows, data = chunks(spark)
    _, held = chunks(spark, 21, seed=1)
    settings = Settings(hidden=8, epochs=3, batch=16)
    runs = [Run("slow", 1e-3), Run("fast", 3e-2), Run("half", 3e-2, 0.5)]
    together = Trainer(data, held, runs, str(tmp_path / "all"), settings=settings)
    history = together.train().orderBy("run", "epoch").collect()
    assert len(history) == 9 and [r.learning_rate_end for r in history if r.epoch == 3] == [0, 0, 0]
    fast = [r for r in history if r.run == "fast"]
    assert fast[-1].train_loss < 0.6 * fast[0].train_loss and fast[-1].f1_macro > 0.9
    assert together.n_chunks == [90, 90, sum(1 + k % 2 for k in {r[0] for r in together.fit.filter("runs[2]").select("doc_id").collect()})] and together.n_chunks[2] < 60
    for run in runs:  # the same numbers as in a run of its own
        alone = Trainer(data, held, [run], str(tmp_path / run.name), settings=settings).train().orderBy("epoch").collect()
        for a, b in zip(alone, [r for r in history if r.run == run.name]):
            assert all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    # a run that broke after the first epoch
    import shutil

    shutil.copytree(tmp_path / "all", tmp_path / "broken")
    for e in (2, 3):
        shutil.rmtree(tmp_path / "broken" / f"epoch-{e}")
        shutil.rmtree(tmp_path / "broken" / f"history-{e}")
    again = Trainer(data, held, runs, str(tmp_path / "broken"), settings=settings)
    for a, b in zip(again.train().orderBy("run", "epoch").collect(), history):
        assert a[0] == b[0] and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    for a, b in zip(again._load(3), together._load(3)):
        assert all(np.allclose(a.value[n], b.value[n], atol=1e-9) for n in finetune.NAMES)
    best = together.best()
    assert best["fast"][0] == min(r.epoch for r in fast if r.f1_macro == max(x.f1_macro for x in fast))
    with pytest.raises(ValueError):
        Trainer(data.filter("label = 'c0'").limit(0), held, runs, str(tmp_path / "none"), settings=settings)


def test_experiment_scores_articles_by_their_mean_logits(spark, tmp_path):
    _, data = chunks(spark)
    rows, test = chunks(spark, 15, seed=2)
    runs = [Run("a", 1e-5), Run("b", 3e-2)]
    settings = Settings(hidden=8, epochs=6, batch=16)
    out = finetune.experiment(data, test, test, runs, str(tmp_path / "x"), settings=settings)
    result = {r.experiment_id: r for r in out["results"].collect()}
    assert result["b"].selected and not result["a"].selected and result["b"].f1_macro > 0.9 and result["a"].train_chunks == 90
    trainer = Trainer(data, test, runs, str(tmp_path / "x"), settings=settings)
    value = trainer.best()["b"][2]
    got = {r.doc_id: r for r in out["predictions"].filter("run = 'b'").collect()}
    for doc in {r[0] for r in rows}:
        z = np.mean([finetune.logits(value, np.array([r[3]]))[0] for r in rows if r[0] == doc], axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[doc].prediction == f"c{z.argmax()}" and abs(got[doc].confidence - p.max()) < 1e-9 and got[doc].truth == f"c{doc % 3}"
    assert {r.run: r.n for r in out["predictions"].groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 15, "b": 15}


def test_analysis_of_vectors(spark):
    from quillspark.plans.analysis import embedding_analysis

    words, docs = topics(spark, 60)
    rows = docs.filter("doc_id < 60").select(F.col("doc_id").cast("string").alias("article_id"), F.concat(F.lit("t"), F.col("doc_id") % 2).alias("document_id"), F.col("tokens").alias("lemmas"))
    idf = spark.createDataFrame([(w, 1.0) for t in words for w in t], "term string, idf double")
    out = embedding_analysis(rows, idf, size=8, epochs=20, n_buckets=500)
    every = set(words[0] + words[1])
    assert all({r.word for r in out[x].collect()} == every for x in ("word2vec", "fasttext", "glove"))
    assert out["glove_losses"].count() == 35 and out["article_vectors"].count() == 60 and out["plane"].count() == 60 and out["subwords"].count() > 100
    assert out["retrieval"].first().n_queries == 60 and out["retrieval"].first().precision_at_k > 0.9


def test_full_runs_come_first_and_are_one_gradient():
    rng = np.random.default_rng(4)
    i = rng.integers(0, 30, 700).astype(np.int32)
    for part in rotation.batches(i, 8, 128, rng):
        rows, w, v = i[part], rng.normal(size=len(part)).astype(np.float32), rng.normal(size=(len(part), 5)).astype(np.float32)
        got, grads = rotation.run_sums(rows, w, v, 8)
        m = len(rows) // 8
        full = (rows[: 8 * m].reshape(m, 8) == rows[: 8 * m : 8, None]).all(axis=1)
        lead = m if full.all() else int(full.argmin())
        assert lead >= 5 and len(got) == len(rows) - 7 * lead
        want, have = np.zeros((30, 5)), np.zeros((30, 5))
        np.add.at(want, rows, w[:, None] * v)
        np.add.at(have, got, grads)
        assert np.allclose(want, have, atol=1e-4)
    assert np.array_equal(rotation._sorted(np.array([70_000, 3, 3, 65_536, 0])), [4, 1, 2, 3, 0])


def test_glove_is_trained_in_eight_blocks(spark, monkeypatch):
    asked, blocks_for = [], rotation.blocks_for
    monkeypatch.setattr(rotation, "blocks_for", lambda *a: asked.append(blocks_for(*a)) or asked[-1])
    words = [f"w{k}" for k in range(12)]
    pairs = spark.createDataFrame([(a, b, 1.0) for a in words for b in words if a < b], "center string, context string, weight double")
    assert cooccurrence.train_glove(pairs, size=4, epochs=1)[0].count() == 12 and asked == [8]


def test_glove_makes_its_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0)], "center string, context string, weight double").coalesce(1)
    cooccurrence.train_glove(pairs.mapInArrow(rows, pairs.schema), size=4, epochs=1)
    assert made.value == 2


def test_passes_of_a_visit_share_their_tables(monkeypatch):
    made, alias = [], skipgram.Alias
    monkeypatch.setattr(skipgram, "Alias", lambda m: made.append(len(m)) or alias(m))
    rng = np.random.default_rng(6)
    sides = [Side(k, rng.normal(0, 0.1, (6, 4)).astype(np.float32), np.ones((6, 4), np.float32), np.ones(6, np.float32).tobytes()) for k in range(2)]
    i, j = np.arange(6), np.arange(6)[::-1].copy()
    one = skipgram.skip_pass(2, 6.0, 0.05)
    losses = [one(i, j, np.ones(6, np.float32), *sides, None, rng) for _ in range(30)]
    assert made == [6, 6] and losses[-1] < losses[0]


@pytest.mark.parametrize(("step", "weights"), [(1_000_000, None), (70, None), (70, [0.7310585, 0.1234567])])
def test_packed_pairs_are_those_of_the_tokens(monkeypatch, step, weights):
    monkeypatch.setattr(cooccurrence, "STEP", step)
    rng = np.random.default_rng(9)
    docs = [[f"w{k}" for k in rng.zipf(1.4, n) % 50] for n in (60, 0, 1, 90, 200)] + [None, ["é", "w1", "é"]]
    rare = [["w3"] if k % 2 else None for k in range(len(docs))]
    used = weights or [1 / d for d in range(1, 6)]
    scale = cooccurrence._scale(used)
    assert scale == (None if weights else 60)
    want = defaultdict(float)
    for doc, gone in zip(docs, rare):
        kept = [w for w in doc or [] if w not in (gone or [])]
        for at, a in enumerate(kept):
            for d, x in enumerate(used, 1):
                if at + d < len(kept):
                    want[a, kept[at + d]] += x
                    want[kept[at + d], a] += x
    kind = pa.list_(pa.string())
    batches = [pa.record_batch([pa.array(docs[s : s + 2], kind), pa.array(rare[s : s + 2], kind)], names=["tokens", "rare"]) for s in range(0, len(docs), 2)]
    rows = pa.Table.from_batches(list(cooccurrence._near_pairs(used, scale)(batches)))
    got = {}
    for bucket in set(rows.column("bucket").to_pylist()):
        for r in cooccurrence._unpacked(scale)(None, rows.filter(pc.equal(rows.column("bucket"), bucket))).to_pylist():
            assert (r["center"], r["context"]) not in got
            got[r["center"], r["context"]] = r["weight"]
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_packed_pairs_are_small_and_a_frequent_term_is_dealt_out():
    rng = np.random.default_rng(10)
    docs = [["aaa" if k % 2 else f"term{rng.integers(0, 5000)}" for k in range(400)] for _ in range(500)]
    batch = pa.record_batch([pa.array(docs), pa.nulls(500, pa.list_(pa.string()))], names=["tokens", "rare"])
    rows = pa.Table.from_batches(list(cooccurrence._near_pairs([1.0, 0.5], 2)([batch])))
    n = sum(cooccurrence._unpacked(2)(None, rows.slice(k, 1)).num_rows for k in range(rows.num_rows)) / 2
    hot = [k for k in range(rows.num_rows) if "aaa" in cooccurrence._unpacked(2)(None, rows.slice(k, 1)).column("center").to_pylist()]
    assert n > 100_000 and sum(len(x) for x in rows.column("data").to_pylist()) < 12 * n and len(hot) >= cooccurrence.SIDE - 1


def test_tokens_come_back_from_text_and_sizes(spark):
    docs = [["é", "w1", "\n", "日本"], [], None, ["a b", "a b"]]
    batch = pa.record_batch([pa.array(["".join(x) if x is not None else None for x in docs]), pa.array([[len(w.encode()) for w in x] if x is not None else None for x in docs], pa.list_(pa.int32())), pa.nulls(4, pa.list_(pa.string()))], names=["text", "sizes", "rare"])
    assert [b.column("tokens").to_pylist() for b in cooccurrence._apart([batch.slice(0, 1), batch.slice(1)])] == [[docs[0]], [[], [], docs[3]]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(docs)], "doc_id int, tokens array<string>")
    got = {(r.center, r.context): r.weight for r in cooccurrence.cooccurrence(rows, least=1, window=2).collect()}
    assert got == {("é", "w1"): 1, ("w1", "é"): 1, ("é", "\n"): 0.5, ("\n", "é"): 0.5, ("w1", "\n"): 1, ("\n", "w1"): 1, ("w1", "日本"): 0.5, ("日本", "w1"): 0.5, ("\n", "日本"): 1, ("日本", "\n"): 1, ("a b", "a b"): 2}


def test_a_large_bucket_is_summed_in_parts(monkeypatch):
    texts = [[f"t{(i * j) % 37}" for j in range(60)] for i in range(1, 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([None] * len(texts), pa.list_(pa.string()))], names=["tokens", "rare"])
    rows = pa.Table.from_batches(list(cooccurrence._near_pairs([1.0, 0.5], 2)([batch, batch])))
    want = [sorted(map(str, cooccurrence._unpacked(2)(None, rows.filter(pc.equal(rows.column("bucket"), b))).to_pylist())) for b in sorted(set(rows.column("bucket").to_pylist()))]
    monkeypatch.setattr(cooccurrence, "PAIRS", 2)
    monkeypatch.setattr(cooccurrence, "ROWS", 3)
    found = rows.sort_by("bucket").to_batches(max_chunksize=4)
    out = list(cooccurrence._streamed(2)(found))
    assert max(b.num_rows for b in out) <= 2 * 3  # not a table for each bucket
    assert sorted(str(r) for b in out for r in b.to_pylist()) == sorted(x for one in want for x in one)
