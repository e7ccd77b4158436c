"""Training of a classifier's head by gradient, of one or of several experiments in the same passes over the data.

The head is a hidden layer with tanh over features of chunks. A step's gradients are sums over the rows of its batch: each task
sums its rows', a tree of tasks adds the sums up, and the driver, which holds the weights and nothing of the data, moves
them by AdamW with a linear warm-up and decay, clipped gradients and balanced cross-entropy. Batches are dealt by hash once
and lie in folders of their own, so a step reads its batch alone; an epoch takes them in an order of its own. After each epoch
all weights and moments are written, so that a broken run goes on from its last epoch with the same numbers.

Experiments share steps: each has its own weights, rate and subset of the rows, and a row counts for those whose subset
holds it. Their numbers are those of separate runs over the same batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import splits
from quillspark.sources.models import exists

NAMES = ("w1", "b1", "w2", "b2")
#: Fixed values of AdamW.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
_TENSORS = "epoch int, run string, name string, shape array<int>, value binary, mean binary, square binary"
_HISTORY = "run string, epoch int, train_loss double, validation_loss double, accuracy double, precision_macro double, recall_macro double, f1_macro double, learning_rate_end double"


@dataclass(frozen=True)
class Run:
    """An experiment: a learning rate, and the share of each class's articles that it learns from."""

    name: str
    rate: float = 3e-5
    fraction: float = 1.0


@dataclass(frozen=True)
class Settings:
    hidden: int = 64
    epochs: int = 4
    batch: int = 8
    decay: float = 0.01
    warmup: float = 0.10
    clip: float = 1.0
    seed: int = 42


@dataclass
class Head:
    """The weights of one run, and AdamW's moments of them."""

    value: dict[str, np.ndarray]
    mean: dict[str, np.ndarray] = field(default_factory=dict)
    square: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        for name, v in self.value.items():
            self.mean.setdefault(name, np.zeros_like(v))
            self.square.setdefault(name, np.zeros_like(v))


def new_head(width: int, hidden: int, classes: int, seed: int) -> Head:
    rng = np.random.default_rng(seed)
    return Head({"w1": rng.normal(0, 1 / math.sqrt(width), (width, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / math.sqrt(hidden), (hidden, classes)), "b2": np.zeros(classes)})


def logits(value: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ value["w1"] + value["b1"]) @ value["w2"] + value["b2"]


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradient_sums(value: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(loss, weight, rows, gradients of w1, b1, w2, b2 one after another), summed over the rows; loss and gradients times the class's weight."""
    h = np.tanh(x @ value["w1"] + value["b1"])
    log_p = log_softmax(h @ value["w2"] + value["b2"])
    w = weights[y]
    d = np.exp(log_p)
    d[np.arange(len(y)), y] -= 1
    d *= w[:, None]
    dh = (d @ value["w2"].T) * (1 - h * h)
    parts = (x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))
    return np.concatenate([[-(w * log_p[np.arange(len(y)), y]).sum(), w.sum(), len(y)], *(p.ravel() for p in parts)])


def rate_at(step: int, total: int, warmup: int, rate: float) -> float:
    """The learning rate after `step` steps: from 0 up to the rate, then down to 0."""
    return rate * (step / max(1, warmup) if step < warmup else max(0.0, (total - step) / max(1, total - warmup)))


def adamw(head: Head, grads: dict[str, np.ndarray], step: int, rate: float, decay: float, clip: float) -> None:
    """The step-th step (from 1) of AdamW, with the gradients' norm clipped."""
    size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    shrink = min(1.0, clip / (size + 1e-6))
    for name, g in grads.items():
        g = g * shrink
        head.value[name] = head.value[name] * (1 - rate * decay)
        head.mean[name] = BETA_1 * head.mean[name] + (1 - BETA_1) * g
        head.square[name] = BETA_2 * head.square[name] + (1 - BETA_2) * g * g
        move = (head.mean[name] / (1 - BETA_1**step)) / (np.sqrt(head.square[name] / (1 - BETA_2**step)) + EPSILON)
        head.value[name] = head.value[name] - rate * move


def macro_of(counts: dict[tuple[int, int], int]) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1 of counts by (truth, prediction), over the labels among them; 0 without a denominator."""
    labels = sorted({x for pair in counts for x in pair})
    right = {c: counts.get((c, c), 0) for c in labels}
    truth = {c: sum(n for (a, _), n in counts.items() if a == c) for c in labels}
    told = {c: sum(n for (_, b), n in counts.items() if b == c) for c in labels}
    p = [right[c] / told[c] if told[c] else 0.0 for c in labels]
    r = [right[c] / truth[c] if truth[c] else 0.0 for c in labels]
    f = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(p, r)]
    mean = lambda v: sum(v) / max(1, len(v))
    return {"accuracy": sum(right.values()) / max(1, sum(truth.values())), "precision_macro": mean(p), "recall_macro": mean(r), "f1_macro": mean(f)}


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def tree_sum(rows: DataFrame, of, width: int, deep: bool = False) -> np.ndarray:
    """The sum over all Arrow batches of `of`(batch), `width` numbers: summed by task, then (deep) by a tree of tasks, always in the same order."""

    def part(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = np.zeros(width)
        for x in sorted(x for b in batches for x in b.column("part").to_pylist()):
            total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.mapInArrow(part, "part binary")
    if deep:
        parts = parts.repartition(math.isqrt(rows.rdd.getNumPartitions())).mapInArrow(add, "part binary")
    total = np.zeros(width)
    for x in sorted(bytes(r.part) for r in parts.collect()):
        total += np.frombuffer(x)
    return total


def evaluate(rows: DataFrame, heads: list[dict], weights: list[np.ndarray], key: str) -> tuple[list[dict], list[float], DataFrame]:
    """Of each head the metrics by article and the loss by chunk over rows (key, y, vector); and (run, key, y, prediction, confidence).

    A chunk's logits are summed by article where they lie, then across tasks; the article's class is that of its mean logits.
    """
    runs, classes = len(heads), heads[0]["w2"].shape[1]
    kind = rows.schema[key].dataType.simpleString()

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column("vector")), b.column("y").to_numpy()
            z = [logits(h, x) for h in heads]
            loss = [-(w[y] * log_softmax(v)[np.arange(len(y)), y]) for v, w in zip(z, weights)]
            told = np.concatenate([*z, np.stack(loss, axis=1), np.stack([w[y] for w in weights], axis=1)], axis=1)
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * told.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("y"), pa.ListArray.from_arrays(ends, pa.array(told.ravel()))], names=[key, "y", "told"])

    width = runs * (classes + 2)
    scored = rows.select(key, "y", "vector").mapInArrow(score, f"{key} {kind}, y int, told array<double>")
    sums = scored.groupBy(key, "y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.element_at("told", i + 1)).alias(f"s{i}") for i in range(width)])
    each = F.explode(F.array(*[
        F.struct(F.lit(r).alias("run"), F.array(*[F.col(f"s{r * classes + c}") / F.col("n") for c in range(classes)]).alias("z"), F.col(f"s{runs * classes + r}").alias("loss"), F.col(f"s{runs * (classes + 1) + r}").alias("weight"))
        for r in range(runs)
    ]))
    top = F.array_max("e.z")
    told = sums.select(key, "y", each.alias("e")).select("e.run", key, "y", (F.array_position("e.z", top) - 1).cast("int").alias("prediction"), (1 / F.aggregate("e.z", F.lit(0.0), lambda s, z: s + F.exp(z - top))).alias("confidence"), "e.loss", "e.weight")
    counts = told.groupBy("run", "y", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.sum("weight").alias("weight")).collect()  # classes squared, of each run
    metrics, losses = [], []
    for r in range(runs):
        own = [c for c in counts if c.run == r]
        metrics.append(macro_of({(c.y, c.prediction): c.n for c in own}))
        losses.append(sum(c.loss for c in own) / max(1e-300, sum(c.weight for c in own)))
    return metrics, losses, told.drop("loss", "weight")


class Trainer:
    """Trains the heads of some runs over chunks (key, chunk_no, label, vector), and keeps its state in a folder that all executors see."""

    def __init__(self, fit: DataFrame, validation: DataFrame, runs: list[Run], folder: str, label: str = "label", key: str = "doc_id", settings: Settings = Settings()):
        self.spark: SparkSession = fit.sparkSession
        self.runs, self.folder, self.key, self.settings = runs, folder.rstrip("/"), key, settings
        made = exists(self.spark, f"{self.folder}/fit/_SUCCESS")
        if not exists(self.spark, f"{self.folder}/raw/_SUCCESS"):  # what follows passes over it more than once
            fit.select(key, "chunk_no", label, "vector").write.mode("overwrite").parquet(f"{self.folder}/raw")
        fit = self.spark.read.parquet(f"{self.folder}/raw")
        labels = sorted(r[0] for r in fit.select(label).distinct().collect() if r[0] is not None)  # a class each
        if not labels:
            raise ValueError("there is no class to learn")
        self.labels = labels
        index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("int") - 1
        flags = fit.select(key, label).distinct()
        for n, fraction in enumerate(sorted({r.fraction for r in runs})):
            mark = f"_f{n}"
            flags = flags.withColumn(mark, F.lit(True)) if fraction == 1 else flags.join(splits.stratified_subset(flags.select(key, label), label, key, fraction, settings.seed).select(key, F.lit(True).alias(mark)), key, "left")
        order = sorted({r.fraction for r in runs})
        own = F.array(*[F.coalesce(F.col(f"_f{order.index(r.fraction)}"), F.lit(False)) for r in runs])
        marked = fit.join(flags.select(key, own.alias("runs")), key).select(key, "chunk_no", index.alias("y"), F.col("vector").cast("array<double>").alias("vector"), "runs")
        if not made:
            n = marked.count()
            steps = max(1, math.ceil(n / settings.batch))
            dealt = marked.withColumn("step", F.pmod(F.xxhash64(F.lit(settings.seed), key, "chunk_no"), F.lit(steps)).cast("int"))
            dealt.repartition("step").write.mode("overwrite").partitionBy("step").parquet(f"{self.folder}/fit")
            validation.select(key, index.alias("y"), F.col("vector").cast("array<double>").alias("vector")).write.mode("overwrite").parquet(f"{self.folder}/validation")
        self.fit, self.validation = (self.spark.read.parquet(f"{self.folder}/{x}") for x in ("fit", "validation"))
        sizes = self.fit.select("y", "step", F.posexplode("runs").alias("run", "own")).groupBy("run", "y").agg(F.count_if("own").alias("n"), F.max("step").alias("step")).collect()
        self.n_chunks = [sum(r.n for r in sizes if r.run == k) for k in range(len(runs))]
        counts = [[sum(r.n for r in sizes if r.run == k and r.y == c) for c in range(len(labels))] for k in range(len(runs))]
        if any(0 in c for c in counts):
            raise ValueError("each class needs a chunk to learn from, in each run")
        self.weights = [np.array([sum(c) / (len(labels) * x) for x in c]) for c in counts]
        self.steps = sorted(r.step for r in self.fit.select("step").distinct().collect())  # batches' numbers; some may be empty
        self.total = settings.epochs * len(self.steps)
        self.warmup = max(1, int(self.total * settings.warmup))
        self.width = len(self.fit.first()["vector"])
        self.deep = self.fit.rdd.getNumPartitions() > 64  # so many tasks' sums are added up by tasks first

    def _load(self, epoch: int) -> list[Head]:
        if not epoch:
            return [new_head(self.width, self.settings.hidden, len(self.labels), self.settings.seed) for _ in self.runs]
        rows = self.spark.read.schema(_TENSORS).parquet(f"{self.folder}/epoch-{epoch}").collect()  # the model, not the data
        got = {(r.run, r.name): r for r in rows}
        back = lambda r, c: np.frombuffer(bytes(r[c])).reshape(r.shape).copy()
        return [Head(*({n: back(got[run.name, n], c) for n in NAMES} for c in ("value", "mean", "square"))) for run in self.runs]

    def _save(self, epoch: int, heads: list[Head], history: list[tuple]) -> None:
        rows = [(epoch, run.name, n, list(h.value[n].shape), h.value[n].tobytes(), h.mean[n].tobytes(), h.square[n].tobytes()) for run, h in zip(self.runs, heads) for n in NAMES]
        self.spark.createDataFrame(history, _HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/history-{epoch}")
        self.spark.createDataFrame(rows, _TENSORS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/epoch-{epoch}")

    def _step(self, step: int, heads: list[Head]) -> list[np.ndarray]:
        values, weights, runs = [h.value for h in heads], self.weights, len(heads)
        width = 3 + sum(v.size for v in values[0].values())

        def of(b):
            x, y = _matrix(b.column("vector")), b.column("y").to_numpy()
            own = b.column("runs").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            return np.concatenate([gradient_sums(values[r], x[own[:, r]], y[own[:, r]], weights[r]) for r in range(runs)])

        return np.split(tree_sum(self.fit.filter(F.col("step") == step).select("y", "vector", "runs"), of, runs * width, self.deep), runs)

    def train(self) -> DataFrame:
        """The history: a row for each run and epoch. Goes on after the last epoch that was written."""
        s, done = self.settings, 0
        while done < s.epochs and exists(self.spark, f"{self.folder}/epoch-{done + 1}/_SUCCESS"):
            done += 1
        heads = self._load(done)
        for epoch in range(done + 1, s.epochs + 1):
            losses, seen = [0.0] * len(self.runs), [0.0] * len(self.runs)
            for k, place in enumerate(np.random.default_rng([s.seed, epoch]).permutation(len(self.steps))):
                at = (epoch - 1) * len(self.steps) + k
                for r, (head, sums) in enumerate(zip(heads, self._step(self.steps[place], heads))):
                    loss, weight, rows = sums[:3]
                    if not rows:
                        continue
                    cuts = np.cumsum([head.value[n].size for n in NAMES])[:-1]
                    grads = {n: g.reshape(head.value[n].shape) / weight for n, g in zip(NAMES, np.split(sums[3:], cuts))}
                    adamw(head, grads, at + 1, rate_at(at, self.total, self.warmup, self.runs[r].rate), s.decay, s.clip)
                    losses[r] += loss / weight * rows
                    seen[r] += rows
            metrics, validation_losses, _ = evaluate(self.validation, [h.value for h in heads], self.weights, self.key)
            end = epoch * len(self.steps)
            history = [
                (run.name, epoch, losses[r] / max(1.0, seen[r]), validation_losses[r], *(metrics[r][m] for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")), rate_at(end, self.total, self.warmup, run.rate))
                for r, run in enumerate(self.runs)
            ]
            self._save(epoch, heads, [tuple(float(x) if isinstance(x, (float, np.floating)) else x for x in row) for row in history])
        parts = [self.spark.read.schema(_HISTORY).parquet(f"{self.folder}/history-{e}") for e in range(1, s.epochs + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def best(self) -> dict[str, tuple[int, float, dict[str, np.ndarray]]]:
        """Of each run the first epoch of greatest macro F1 on the validation part, that F1, and the weights after it."""
        history = [r for e in range(1, self.settings.epochs + 1) for r in self.spark.read.schema(_HISTORY).parquet(f"{self.folder}/history-{e}").collect()]
        out = {}
        for r, run in enumerate(self.runs):
            top = max((h for h in history if h.run == run.name), key=lambda h: (h.f1_macro, -h.epoch))
            out[run.name] = (top.epoch, top.f1_macro, self._load(top.epoch)[r].value)
        return out

    def predict(self, rows: DataFrame, label: str) -> tuple[list[dict], DataFrame]:
        """Metrics of each run's best epoch over chunks (key, label, vector), and (run, key, truth, prediction, confidence) by article."""
        best = self.best()
        names = F.array(*[F.lit(x) for x in self.labels])
        ready = rows.select(self.key, (F.array_position(names, F.col(label)).cast("int") - 1).alias("y"), F.col("vector").cast("array<double>").alias("vector"))
        metrics, _, told = evaluate(ready, [best[r.name][2] for r in self.runs], self.weights, self.key)
        titles = F.array(*[F.lit(r.name) for r in self.runs])
        return metrics, told.select(F.element_at(titles, F.col("run") + 1).alias("run"), self.key, F.element_at(names, F.col("y") + 1).alias("truth"), F.element_at(names, F.col("prediction") + 1).alias("prediction"), "confidence")


def experiment(
    train: DataFrame, validation: DataFrame, test: DataFrame, runs: list[Run], folder: str, label: str = "label", key: str = "doc_id", settings: Settings = Settings(epochs=2)
) -> dict[str, DataFrame]:
    """results (a row for each run, `selected` for the first with the greatest validation F1), history, and predictions of the test part."""
    trainer = Trainer(train, validation, runs, folder, label, key, settings)
    history = trainer.train()
    metrics, predictions = trainer.predict(test, label)
    best = trainer.best()
    chosen = max(range(len(runs)), key=lambda r: (best[runs[r].name][1], -r))
    rows = [
        (run.name, run.fraction, trainer.n_chunks[r], run.rate, settings.epochs, best[run.name][0], float(best[run.name][1]), *(float(metrics[r][m]) for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")), r == chosen)
        for r, run in enumerate(runs)
    ]
    schema = "experiment_id string, data_fraction double, train_chunks long, learning_rate double, epochs int, best_epoch int, validation_f1_macro double, accuracy double, precision_macro double, recall_macro double, f1_macro double, selected boolean"
    return {"results": train.sparkSession.createDataFrame(rows, schema), "history": history, "predictions": predictions}
