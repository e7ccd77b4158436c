"""Text classification with Spark ML, and scoring through pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import confidence_level, valid_input
from quillspark.functions.vectors import softmax
from quillspark.operators.chunks import chunks
from quillspark.operators.embeddings import pooled
from quillspark.operators.metrics import class_weights
from quillspark.session import dropped_shuffles

#: array<string> of texts to a matrix; made once in a task.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hash_encoder(size: int = 64) -> Encoder:
    """A deterministic stand-in where no model can be loaded: signed counts of hashed words. It is no language model."""

    def make():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % size] += 1 if h >> 16 & 1 else -1
            return out

        return encode

    return make


def encode_chunks(docs: DataFrame, encoder: Encoder, size: int, key: str = "doc_id", most: int = 180, batch: int = 16, unit_chunks: bool = False) -> DataFrame:
    """(key, chunk_no, vector): texts cut into chunks and encoded in batches, with one encoder for each task."""
    rows = docs.select(key, F.posexplode(chunks(F.col("text"), most, hard_split=True)).alias("chunk_no", "chunk"))
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            parts = [np.asarray(encode(f["chunk"].iloc[s : s + batch].tolist()), float) for s in range(0, len(f), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, size))
            if unit_chunks:
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: f[key], "chunk_no": f["chunk_no"], "vector": v.tolist()})

    return rows.mapInPandas(run, f"{key} {kind}, chunk_no int, vector array<double>")


def encode_documents(docs: DataFrame, encoder: Encoder, size: int, key: str = "doc_id", most: int = 180) -> DataFrame:
    """(key, vector): unit means of chunk vectors."""
    return pooled(encode_chunks(docs, encoder, size, key, most), size, key)


def _ready(rows: DataFrame, vector: str) -> DataFrame:
    """rows with _x, a vector of Spark ML; arrays are made dense, vectors stay as they are."""
    made = isinstance(rows.schema[vector].dataType, VectorUDT)
    return rows.withColumn("_x", F.col(vector) if made else array_to_vector(F.col(vector).cast("array<double>")))


def fit_logistic(train: DataFrame, label: str, vector: str = "vector", c: float = 4.0, iterations: int = 3000, tolerance: float = 1e-6) -> tuple[StringIndexerModel, LogisticRegressionModel]:
    """Multinomial regression with balanced weights; regularisation 1 / (C * sum of weights), as the usual library has it."""
    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    weights = F.broadcast(class_weights(train, label).select(label, "weight"))  # a row a class, as the indexer holds on the driver
    weighed = names.transform(_ready(train, vector)).join(weights, label)
    # each step shuffles a gradient of each partition, so there are no more of them than cores
    weighed = weighed.coalesce(train.sparkSession.sparkContext.defaultParallelism)
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial", regParam=1 / (c * train.count()), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=tolerance)
    with dropped_shuffles(train.sparkSession):
        return names, lr.fit(weighed)


def predict(rows: DataFrame, model: tuple[StringIndexerModel, LogisticRegressionModel], vector: str = "vector") -> DataFrame:
    """rows with prediction (a label) and confidence."""
    from pyspark.ml.functions import vector_to_array

    names, lr = model
    out = lr.transform(_ready(rows, vector))
    labels = F.array(*[F.lit(x) for x in names.labels])
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).withColumn("prediction", F.element_at(labels, F.col("prediction").cast("int") + 1)).drop("_x", "rawPrediction", "probability")


def score_texts(texts: DataFrame, scorer: Encoder, labels: list[str], key: str = "doc_id", most: int = 180) -> DataFrame:
    """(key, label, probability, rank, level) for texts: checked, cut into chunks, scored; logits averaged by text, softmax, ranked."""
    ready = texts.select(key, valid_input(F.col("text")).alias("text"))
    logits = encode_chunks(ready, scorer, len(labels), key, most)
    means = logits.groupBy(key).agg(*[F.avg(F.element_at("vector", i + 1)).alias(f"_l{i}") for i in range(len(labels))])
    p = softmax(F.array(*[F.col(f"_l{i}") for i in range(len(labels))]))
    ranked = F.array_sort(F.zip_with(p, F.array(*[F.lit(x) for x in labels]), lambda x, name: F.struct((-x).alias("neg"), name.alias("label"))))
    rows = means.select(key, F.posexplode(ranked).alias("rank", "r"))
    return rows.select(key, "r.label", (-F.col("r.neg")).alias("probability"), (F.col("rank") + 1).alias("rank"), confidence_level(-F.col("r.neg")).alias("level"))
