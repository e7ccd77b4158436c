"""Trained models and vectors kept in a folder and read back."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StringIndexerModel, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

Classifier = tuple[StringIndexerModel, LogisticRegressionModel]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _found(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"there is no trained model at {path}")
    return path


def save_classifier(model: Classifier, path: str) -> None:
    for part, name in zip(model, ("labels", "regression")):
        part.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load_classifier(spark: SparkSession, path: str) -> Classifier:
    path = path.rstrip("/")
    return StringIndexerModel.load(_found(spark, f"{path}/labels")), LogisticRegressionModel.load(_found(spark, f"{path}/regression"))


def save_word2vec(model: Word2VecModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a saved model."""
    return Word2VecModel.load(_found(spark, path)).getVectors().select("word", vector_to_array("vector").alias("vector"))


def save_table(df: DataFrame, path: str) -> None:
    """Vectors of any kind (GloVe, subwords, documents), idf weights or articles, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_found(spark, path))
