"""Classification metrics as aggregates over (truth, prediction) rows: one pass, partial aggregation, class-sized results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _per_class(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(label, tp, support, predicted) for labels in truth or prediction."""
    pairs = rows.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))
    right = (F.col(truth) == F.col(prediction)).cast("long") * F.col("n")
    sides = pairs.select(F.col(truth).alias("label"), right.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("predicted")).union(
        pairs.select(F.col(prediction).alias("label"), F.lit(0), F.lit(0), F.col("n"))
    )
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scored(per_class: DataFrame) -> DataFrame:
    scored = per_class.withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(rows: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and unweighted means over labels in truth or prediction; 0 where a ratio has no denominator."""
    s = _scored(_per_class(rows, truth, prediction))
    return s.agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("precision"), 4).alias("precision_macro"),
        F.round(F.avg("recall"), 4).alias("recall_macro"), F.round(F.avg("f1"), 4).alias("f1_macro"),
    )


def report(rows: DataFrame, labels: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) for a fixed list of labels, and rows for the macro and weighted means."""
    zero = {"tp": 0, "support": 0, "predicted": 0}
    s = _scored(labels.select("label").join(_per_class(rows, truth, prediction), "label", "left").fillna(zero))
    each = s.select("label", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    plain = each.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    by = each.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    return each.withColumn("label", F.col("label").cast("string")).union(plain).union(by).select("label", *[F.round(c, 4).alias(c) for c in names], "support")


def confusion(rows: DataFrame, labels: list, truth: str = "truth", prediction: str = "prediction", normalise: bool = True) -> DataFrame:
    """A row for each label (also those without rows), a column p_<label> for each predicted label."""
    grid = rows.sparkSession.createDataFrame([(x,) for x in labels], rows.select(F.col(truth).alias("truth")).schema)
    wide = rows.groupBy(F.col(truth).alias("truth")).pivot(prediction, labels).agg(F.count(F.lit(1)))
    full = grid.join(wide, "truth", "left").fillna(0)
    total = sum((F.col(f"`{x}`") for x in labels[1:]), F.col(f"`{labels[0]}`"))
    cell = lambda x: F.round(F.when(total > 0, F.col(f"`{x}`") / total).otherwise(0.0), 4) if normalise else F.col(f"`{x}`")
    return full.select("truth", *[cell(x).alias(f"p_{x}") for x in labels])


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (K * n)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # a row for each class
    return n.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def mean_loss(batches: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    return batches.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def article_probabilities(logits: DataFrame, key: str) -> DataFrame:
    """(key, label, probability, rank): chunk logits (key, label, logit) averaged by owner, then softmax."""
    mean = logits.groupBy(key, "label").agg(F.avg("logit").alias("z"))
    own = Window.partitionBy(key)
    p = mean.withColumn("e", F.exp(F.col("z") - F.max("z").over(own))).withColumn("probability", F.round(F.col("e") / F.sum("e").over(own), 6))
    return p.withColumn("rank", F.row_number().over(own.orderBy(F.desc("probability"), "label"))).select(key, "label", "probability", "rank")


def best_run(history: DataFrame, score: str, order: str) -> DataFrame:
    """The first run with the greatest score."""
    return history.orderBy(F.desc(score), order).limit(1)


def crosstab(rows: DataFrame, a: str, b: str, total: str = "All") -> DataFrame:
    """Counts of (a, b) with margins, as long rows."""
    g = rows.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") >= 2, total).otherwise(F.col(a).cast("string")).alias(a), F.when(F.col("_g") % 2 == 1, total).otherwise(F.col(b).cast("string")).alias(b), "n")
