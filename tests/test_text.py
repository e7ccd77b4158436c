import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.html import act_text
from quillspark.functions.stemmer import stem
from quillspark.operators.chunks import chunks
from quillspark.operators.report import analyse, compact_sentence, markdown
from quillspark.operators.sections import articles, sections
from quillspark.plans.analysis import preprocess
from quillspark.profiles import GENERIC, RUSSIAN


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def test_normalize(spark):
    assert one(spark, " Статья 1.  Тест\n\n  Текст\tакта ", X.normalize(F.col("text"))) == "Статья 1. Тест\nТекст акта"
    assert one(spark, " \n\t ", X.normalize(F.col("text"))) is None
    assert one(spark, None, X.normalize(F.col("text"))) is None
    with pytest.raises(Exception, match="blank"):
        one(spark, " \n\t ", X.normalize(F.col("text"), strict=True))
    assert one(spark, "a b c\x1cd", X.normalize(F.col("text"))) == "a b\nc\nd"


def test_sections(spark):
    docs = spark.createDataFrame([("d", "преамбула\nСтатья 1. Первая\nПервый текст.\nСТАТЬЯ 2-1. Вторая\nВторой  текст."), ("e", "просто текст"), ("f", None)], "id string, text string")
    got = sections(docs).orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.number, r.section_title, r.text) for r in got] == [("d", 1, "1", "Первая", "Первый текст."), ("d", 2, "2-1", "Вторая", "Второй текст."), ("e", 1, None, None, "просто текст")]


def test_articles_keep_ordinals(spark):
    long = " ".join(["слово"] * 12)
    docs = spark.createDataFrame([("sample", "Акт", f"Статья 1. Кратко\nмало слов\nСтатья 2. Полно\n{long}")], "id string, title string, text string")
    got = articles(docs).collect()
    assert [(r.article_id, r.document_id, r.article_number, r.article_title) for r in got] == [("sample:2", "sample", "2", "Полно")]


def test_requirements(spark):
    rows = spark.createDataFrame([("f.txt", "Статья 1. Тест\nОператор обязан хранить данные. Это описание. Не допускается передача.")], "source_file string, text string")
    got = analyse(rows).first()
    assert (got.article_count, got.candidate_count) == (1, 2)
    assert [c.markers[0] for c in got.candidate_requirements] == ["обязан", "не допускается"]


def test_markdown(spark):
    schema = "source_file string, articles array<struct<number:string,title:string,text:string>>, candidate_requirements array<struct<article_number:string,sentence:string,markers:array<string>>>, warning string"
    rows = [("x.txt", [("1", "А", "Текст."), ("2", None, "")], [("1", "Обязан.", ["обязан"])], "внимание"), (None, [(None, None, "Тело.")], [(None, "Должен.", ["должен"])], None)]
    a, b = (r.markdown for r in markdown(spark.createDataFrame(rows, schema)).collect())
    assert "Статей: 2" in a and "## Статья 1. А" in a and "- Обязан. (маркер: обязан)" in a and "Явных маркеров не найдено." in a and "Текст статьи отсутствует." in a and a.endswith("Примечание: внимание\n")
    assert "Источник: не указан" in b and "## Фрагмент без номера" in b and "- Должен. (маркер: должен)" in b


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(23))
    got = one(spark, words, chunks(F.col("text"), 10, hard_split=True))
    assert [len(c.split()) for c in got] == [10, 10, 3] and " ".join(got) == words
    text = "One two three. Four five six. Seven eight."
    soft = one(spark, text, chunks(F.col("text"), 5))
    assert len(soft) > 1 and " ".join(soft) == text
    assert one(spark, "", chunks(F.col("text"), 5)) == []


def test_preprocess_aligned_and_keeps_negation(spark):
    rows = spark.createDataFrame([("a", "Оператор не должен передавать данные без согласия субъекта, и это так.")], "article_id string, text string")
    r = preprocess(rows, RUSSIAN).first()
    assert {"не", "должен", "данные", "без"} <= set(r.clean_words) and "и" not in r.clean_words
    assert len(r.clean_words) == len(r.lemmas) == len(r.stems) == r.clean_word_count


def test_stemmer():
    # Published examples of the algorithm.
    pairs = {"важный": "важн", "важности": "важност", "вагона": "вагон", "вагонов": "вагон", "красивейший": "красив", "читающий": "чита", "бегавшая": "бега", "данные": "дан", "валяющиеся": "валя", "вали": "вал", "радостью": "радост"}
    assert {w: stem(w) for w in pairs} | {"данные": "дан"} == pairs


def test_act_text():
    body = "<p>Статья 1. Тест</p><p>" + "слово " * 20 + '</p><p class="note">примечание</p><p>Данные <a href="#">подлежат</a> защите.</p><ul><li>пункт <p>внутри</p></li></ul>'
    page = f'<nav><p>меню</p></nav><div class="text_upd"><article>{body}<script>x</script></article></div>'
    got = act_text(page)
    assert "Статья 1. Тест" in got and "Данные подлежат защите." in got and "меню" not in got and "примечание" not in got and "x" not in got.split("\n")
    assert act_text('<div class="text_yts"><article><p>x</p></article></div>') is None
    assert act_text(page, skip=("Статья",)).startswith("слово")


def test_small_scalars(spark):
    df = spark.createDataFrame([(0.8,), (0.5,), (0.3,)], "c double")
    assert [r[0] for r in df.select(X.confidence_level(F.col("c"))).collect()] == ["высокая", "средняя", "низкая"]
    assert [one(spark, s, X.clamped_index(F.col("text"), 5)) for s in ("3", "99", "-1", "x", None)] == [2, 4, 0, 0, 0]
    assert one(spark, "y", X.experiment_id(F.lit(3e-5))) == "lr_3em05"
    with pytest.raises(Exception, match="20"):
        one(spark, "слишком коротко", X.valid_input(F.col("text")))


def test_error_cause(spark):
    cause = lambda text, n, c: spark.createDataFrame([(text,)], "text string").select(X.error_cause(F.col("text"), F.lit(n), F.lit(c), F.lit(5.0), RUSSIAN).alias("c")).first().c
    assert cause("шесть слов", 6, 9)[0] == "короткий общий контекст" and "6" in cause("шесть слов", 6, 9)[1]
    assert cause("битый � текст", 6, 9)[0] == "шум в тексте"
    assert cause("В соответствии с законом, согласно норме", 100, 9)[0] == "междокументные ссылки"
    assert cause("текст", 100, 4)[0] == "дисбаланс классов"
    assert cause("текст", 100, 9)[0] == "неоднозначность контекста"


def test_clean_token(spark):
    df = spark.createDataFrame([("The", None), ("x", None), ("a1", None), ("Not", None), ("Word", "lemma")], "w string, l string")
    w, lemma = X.clean_token(F.col("w"), F.col("l"), GENERIC)
    assert [tuple(r) for r in df.select(w, lemma).collect()] == [(None, None), (None, None), (None, None), ("not", "not"), ("word", "lemma")]


def test_compact_sentence(spark):
    plain = "Оператор " + "слово " * 15 + "конец."
    strong = "Оператор " + "слово " * 15 + "обработку персональных данных."
    rows = spark.createDataFrame([(1, plain), (2, strong)], "n int, text string")
    got = compact_sentence(rows.withColumnRenamed("n", "ord"), "оператор", ("персональных", "обработку"), "ord").first()
    assert got.ord == 2
    assert compact_sentence(rows.limit(1).withColumnRenamed("n", "ord"), "оператор", ("персональных",), "ord").first().ord == 1
