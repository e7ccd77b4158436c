"""Texts to sections, inside the row: an array function finds the headings, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import n_words, normal_lines
from quillspark.profiles import RUSSIAN, Profile


def section_array(text: Column, profile: Profile = RUSSIAN) -> Column:
    """array<struct(number, title, text)>: what stands before the first heading is dropped; without headings, one section with null number and title."""
    lines = normal_lines(text)
    # each line is marked as a heading (H) or text (T) and the text is cut at its headings, once for all sections
    marked = F.array_join(F.transform(lines, lambda x: F.concat(F.when(x.rlike(profile.heading), "H").otherwise("T"), x)), "\n")
    parts = F.split(marked, r"(?:^|\n)H")

    def section(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        rest = F.substr(part, F.length(head) + 2)
        of = lambda k: F.regexp_extract(head, profile.heading, k)
        return F.struct(of(1).alias("number"), of(2).alias("title"), F.regexp_replace(rest, r"(^|\n)T", "$1").alias("text"))

    whole = F.array(F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"), F.array_join(lines, "\n").alias("text")))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, F.array().cast("array<struct<number:string,title:string,text:string>>")).when(marked.rlike(r"(?:^|\n)H"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), section)).otherwise(whole)


def sections(docs: DataFrame, profile: Profile = RUSSIAN) -> DataFrame:
    """A row for each section; ordinal counts from 1 within a document, before any filter."""
    exploded = docs.select("*", F.posexplode(section_array(F.col("text"), profile)).alias("_pos", "_section"))
    return exploded.select(*[c for c in docs.columns if c != "text"], (F.col("_pos") + 1).alias("ordinal"), F.col("_section.number").alias("number"), F.col("_section.title").alias("section_title"), F.col("_section.text").alias("text"))


def articles(docs: DataFrame, profile: Profile = RUSSIAN, least_words: int = 10) -> DataFrame:
    """Articles of documents (id, title, text): those with enough words keep the ordinal they had before the filter."""
    parts = sections(docs.select("id", "title", "text"), profile).filter(n_words(F.col("text")) >= least_words)
    return parts.select(F.concat_ws(":", "id", "ordinal").alias("article_id"), F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("number").alias("article_number"), F.col("section_title").alias("article_title"), "text")
