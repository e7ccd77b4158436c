"""Each SQL function equals its column function."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import sql, text
from quillspark.operators.chunks import chunks
from quillspark.operators.sections import section_array, sections
from quillspark.profiles import GENERIC, RUSSIAN

TEXTS = [
    None, "", " \n\t ", "no heading\nsecond  line", "preamble\nСтатья 1. Первая\nОператор обязан. Иное запрещается; прочее вправе!\n\nСтатья 2-1.\nHТекст\nTекст  и $1 \\n", "Статья 3. Одна",
    "Section 1. One\r\nIt must be so. It may not be so here.\nArticle 2. Two\nIt requires. " + "word " * 25 + "end. Short one. Another one.", "a. b. c. d e f g. h",
]


@pytest.mark.parametrize("profile", [RUSSIAN, GENERIC])
def test_sql_equals_columns(spark, profile):
    sql.register(spark, profile)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    df.createOrReplaceTempView("texts_for_sql")
    t = F.col("text")
    pairs = {
        "text_words(text)": text.words(t), "text_lines(text)": text.normal_lines(t), "text_sentences(text)": text.sentences(t), "text_markers(text)": text.markers(t, profile),
        "text_chunks(text, 4)": chunks(t, 4), "text_hard_chunks(text, 4)": chunks(t, 4, hard_split=True), "text_hard_chunks(text, 10)": chunks(t, 10, hard_split=True), "text_sections(text)": section_array(t, profile),
    }
    for call, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {call} FROM texts_for_sql ORDER BY id").collect()]
        assert got == [r[0] for r in df.orderBy("id").select(column).collect()], call
    rows = spark.sql("SELECT id, s.* FROM texts_for_sql, LATERAL section_rows(text) AS s")
    assert sorted(map(str, rows.collect())) == sorted(map(str, sections(df, profile).select("id", "ordinal", "number", F.col("section_title").alias("title"), "text").collect()))
    assert spark.sql("SELECT lang FROM VALUES ('Оператор обязан.', 'ru'), ('x', 'en') AS v(t, lang) WHERE size(text_markers(t)) > 0").count() == (profile is RUSSIAN)
