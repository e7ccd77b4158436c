"""Requirement sentences, error analysis and Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SENTENCES, error_cause, markers, preview, sentences
from quillspark.operators.sections import section_array
from quillspark.profiles import RUSSIAN, Profile

WARNING = "Кандидаты найдены по правилам; это не юридическое заключение."


def candidates(rows: DataFrame, profile: Profile = RUSSIAN, text: str = "text") -> DataFrame:
    """rows with sentence_no, sentence, markers for each sentence that holds a marker."""
    s = rows.select(*[c for c in rows.columns if c != text], F.posexplode(sentences(F.col(text), SENTENCES)).alias("sentence_no", "sentence"))
    return s.withColumn("markers", markers(F.col("sentence"), profile)).filter(F.size("markers") > 0)


def analyse(texts: DataFrame, profile: Profile = RUSSIAN) -> DataFrame:
    """source_file and text to one analysis row for each text: articles, candidates, counts, warning. All inside the row."""
    parts = section_array(F.col("text"), profile)
    found = lambda a: F.filter(
        F.transform(sentences(a["text"], SENTENCES), lambda s: F.struct(a["number"].alias("article_number"), s.alias("sentence"), markers(s, profile).alias("markers"))), lambda c: F.size(c["markers"]) > 0
    )
    rows = texts.withColumn("articles", parts).withColumn("candidate_requirements", F.flatten(F.transform("articles", found)))
    return rows.select("source_file", F.size("articles").cast("long").alias("article_count"), F.size("candidate_requirements").cast("long").alias("candidate_count"), "articles", "candidate_requirements", F.lit(WARNING).alias("warning"))


def markdown(analysis: DataFrame) -> DataFrame:
    """source_file, markdown. Articles meet candidates by number, where two missing numbers are equal."""
    # The report's phrases.
    line = lambda c: F.concat(F.lit("- "), F.coalesce(c["sentence"], F.lit("")), F.lit(" (маркер: "), F.array_join(c["markers"], ", "), F.lit(")"))

    def section(a: Column) -> Column:
        own = F.transform(F.filter("candidate_requirements", lambda c: c["article_number"].eqNullSafe(a["number"])), line)
        numbered = F.length(F.coalesce(a["number"], F.lit(""))) > 0
        title = F.when(F.length(F.coalesce(a["title"], F.lit(""))) > 0, F.concat(F.lit(". "), a["title"])).otherwise("")
        body = F.when(F.length(F.coalesce(a["text"], F.lit(""))) > 0, a["text"]).otherwise("Текст статьи отсутствует.")
        heading = F.concat(F.lit("## "), F.when(numbered, F.concat(F.lit("Статья "), a["number"])).otherwise("Фрагмент без номера"), title)
        return F.concat(F.lit("\n"), heading, F.lit("\n\n"), body, F.lit("\n\n### Найденные предложения\n\n"), F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise("Явных маркеров не найдено."))

    source = F.when(F.length(F.coalesce("source_file", F.lit(""))) > 0, F.col("source_file")).otherwise("не указан")
    head = F.concat(F.lit("# Анализ текста НПА\n\nИсточник: "), source, F.lit("\nСтатей: "), F.size("articles").cast("string"), F.lit("\nПредложений-кандидатов: "), F.size("candidate_requirements").cast("string"), F.lit("\n"))
    tail = F.when(F.length(F.coalesce("warning", F.lit(""))) > 0, F.concat(F.lit("\n\nПримечание: "), F.col("warning"))).otherwise("")
    return analysis.select("source_file", F.concat(head, F.array_join(F.transform("articles", section), "\n"), tail, F.lit("\n")).alias("markdown"))


def error_analysis(predictions: DataFrame, articles: DataFrame, train_counts: DataFrame, n: int = 10, profile: Profile = RUSSIAN, key: str = "article_id", label: str = "document_id", names: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The n most confident wrong predictions with the likely cause of each.

    A prediction without an article is an error; fewer than n wrong predictions are one if strict.
    """
    median = train_counts.agg(F.median("n").alias("median_n"))
    wrong = predictions.filter(~F.col("correct")).orderBy(F.desc("confidence"), key).limit(n)
    if strict and (found := wrong.count()) < n:
        raise ValueError(f"there are only {found} wrong predictions, at least {n} are needed")
    known = wrong.join(articles.select(key, label, "text", "clean_word_count", F.lit(True).alias("_known")), key, "left")
    known = known.filter(F.coalesce("_known", F.raise_error(F.concat(F.lit("there is no article "), F.col(key).cast("string"))).cast("boolean"))).drop("_known")
    rows = known.join(train_counts.select(label, F.col("n").alias("train_n")), label, "left").crossJoin(F.broadcast(median))  # one row
    cause = error_cause(F.col("text"), F.col("clean_word_count").cast("int"), F.col("train_n"), F.col("median_n"), profile)
    out = rows.withColumn("_c", cause).select(key, "true_label", "predicted_label", "confidence", F.col("_c.cause").alias("cause"), F.col("_c.explanation").alias("explanation"), F.col("clean_word_count").alias("word_count"), preview(F.col("text"), 420).alias("text_preview"))
    if names is not None:
        for c in ("true_label", "predicted_label"):
            side = names.select(F.col("label").alias(c), F.col("label_name").alias("_n"))
            out = out.join(side, c, "left").withColumn(c + "_name", F.coalesce("_n", c)).drop("_n")
    return out


def cause_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).orderBy("cause")


def compact_sentence(rows: DataFrame, word: str, strong: tuple[str, ...], order: str, text: str = "text", low: int = 80, high: int = 360) -> DataFrame:
    """One sentence with a word: the first that also holds all strong words, else the first at all. An empty result means there is none."""
    s = rows.select(order, F.posexplode(sentences(F.col(text), SENTENCES)).alias("n", "sentence"))
    fit = s.filter(F.col("sentence").rlike(rf"(?iuU)\b{word}\w*\b") & F.length("sentence").between(low, high) & ~F.col("sentence").contains("\n"))
    good = F.lit(True)
    for w in strong:
        good = good & F.lower("sentence").contains(w)
    return fit.withColumn("strong", good.cast("int")).orderBy(F.desc("strong"), order, "n").limit(1)
