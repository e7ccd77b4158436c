"""What word vectors are worth: coverage, known pairs, thematic neighbours, nearest words and vector arithmetic.

Questions are small constant tables; they are joined with the vectors and never the vectors with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.vectors import added, cosine, dot, scaled, unit


def nearest(questions: DataFrame, vectors: DataFrame, n: int, ban: str = "ban") -> DataFrame:
    """(question, rank, word, cosine to four digits): the n nearest words to each question's vector by the full cosine, without the words in its array `ban`.

    Each question meets each word, so questions are meant to be few; Spark broadcasts them where its own size check allows it.
    """
    u = vectors.select("word", unit(F.col("vector")).alias("u"))
    scored = u.join(questions, ~F.array_contains(ban, F.col("word")), "inner").select("question", "word", dot(F.col("u"), unit(F.col("q"))).alias("cosine"))
    w = Window.partitionBy("question").orderBy(F.desc("cosine"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("question", "rank", "word", F.round("cosine", 4).alias("cosine"))


def word_questions(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """A question for each known word: its own vector, itself banned."""
    return vectors.join(words.select("word").distinct(), "word").select(F.col("word").alias("question"), F.col("vector").alias("q"), F.array("word").alias("ban"))


def equation_questions(vectors: DataFrame, equations) -> DataFrame:
    """A question for each equation whose words are all known: the signed mean of their unit vectors."""
    spark = vectors.sparkSession
    rows = [(name, w, s) for name, plus, minus in equations for s, part in ((1.0, plus), (-1.0, minus)) for w in part]
    sizes = {name: len(plus) + len(minus) for name, plus, minus in equations}
    terms = spark.createDataFrame(rows, "question string, word string, sign double")
    need = spark.createDataFrame(list(sizes.items()), "question string, n_terms int")
    found = vectors.join(terms, "word").select("question", "word", scaled(unit(F.col("vector")), F.col("sign")).alias("v"))
    sums = found.groupBy("question").agg(F.collect_list("v").alias("vs"), F.collect_list("word").alias("ban")).join(need, "question").filter(F.size("vs") == F.col("n_terms"))
    first = F.get("vs", F.lit(0))
    return sums.select("question", F.aggregate(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), first, added).alias("q"), "ban")


def evaluate(vectors: DataFrame, groups: DataFrame, pairs: DataFrame, name: str, subwords: DataFrame | None = None, typo: str | None = None) -> DataFrame:
    """One row for a model: vocabulary_size, evaluation_coverage, mean_association_cosine, mean_group_precision_at_5, oov_typo_supported.

    groups (grp, word), pairs (a, b); subwords: vectors of words outside the vocabulary, for models that make them.
    """
    words = groups.select("word").distinct()
    known = words.join(vectors.select("word"), "word", "left_semi")
    coverage = words.agg(F.count(F.lit(1)).alias("all")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))
    able = vectors if subwords is None else vectors.unionByName(subwords.join(vectors.select("word"), "word", "left_anti"))
    side = lambda c: able.select(F.col("word").alias(c), F.col("vector").alias("v" + c))
    association = pairs.join(side("a"), "a").join(side("b"), "b").agg(F.round(F.avg(cosine(F.col("va"), F.col("vb"))), 4).alias("mean_association_cosine"))
    near = nearest(word_questions(vectors, groups), vectors, 5)
    hits = groups.withColumnRenamed("word", "question").join(known.withColumnRenamed("word", "question"), "question", "left_semi").join(near, "question", "left")
    hits = hits.join(groups.select("grp", "word", F.lit(1).alias("hit")), ["grp", "word"], "left").groupBy("grp", "question").agg((F.sum(F.coalesce("hit", F.lit(0))) / 5).alias("p"))
    precision = hits.agg(F.round(F.avg("p"), 4).alias("mean_group_precision_at_5"))
    supported = able.filter(F.col("word") == typo).agg((F.count(F.lit(1)) > 0).alias("oov_typo_supported")) if typo else vectors.sparkSession.createDataFrame([(False,)], "oov_typo_supported boolean")
    size = vectors.agg(F.count(F.lit(1)).alias("vocabulary_size"))
    one = reduce(lambda x, y: x.crossJoin(y), [size, coverage, association, precision, supported])  # one row each
    return one.select(F.lit(name).alias("model"), "vocabulary_size", F.round(F.col("known") / F.col("all"), 3).alias("evaluation_coverage"), "mean_association_cosine", "mean_group_precision_at_5", "oov_typo_supported")


def compare(models: dict[str, DataFrame], groups: DataFrame, pairs: DataFrame, **more) -> DataFrame:
    return reduce(DataFrame.unionByName, [evaluate(v, groups, pairs, name, **more.get(name, {})) for name, v in models.items()])
