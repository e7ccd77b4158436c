"""Registered queries of readers, writers, filters and small functions, each with its SQL beside it.

What writes, writes in the shared folder and reads it back.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quillspark import constants
from quillspark.functions.text import clamped_index, collapse, confidence_level, n_words, normal_lines, pattern_words, percent, skips, valid_input
from quillspark.operators import experiments, frequency, metrics, report, sections, tfidf
from quillspark.plans.analysis import corpus_analysis, preprocess
from quillspark.profiles import GENERIC, RUSSIAN
from quillspark.queries import _STOP, FIT, GRID_SQL, LINES_SQL, SECTIONS, TF, W, _headed, _tf, _weights, grid_sizes, query, t
from quillspark.session import work_dir
from quillspark.sources import io

_WORD = r"\p{L}+(?:-\p{L}+)*"
_N_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_CLEAN = rf"list_filter(list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


# --- readers and writers -------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS title, r_name AS topic, 'https://example.org/rus/' || n_nationkey AS url FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_list(spark, d):
    """A JSON list of sources (one small file), read with all its checks."""
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("topic"), F.concat(F.lit("https://example.org/rus/"), F.col("n_nationkey").cast("string")).alias("url"))
    path = work_dir(spark, "sources")
    io.summary_json(rows).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).write.text(path)
    return io.read_sources(spark, path, "example.org", "/rus/")


@query(f"SELECT doc_id::VARCHAR AS id, source AS title, lang AS topic, sha256(text) AS sha256, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS word_count, text FROM documents")
def documents_jsonl(spark, d):
    docs = t(spark, d, "documents").filter("text is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("topic"), F.sha2("text", 256).alias("sha256"), F.size(pattern_words(F.col("text"), GENERIC.word)).cast("long").alias("word_count"), "text")
    path = work_dir(spark, "documents")
    io.write_jsonl(rows, path)
    return io.read_documents(spark, path).select("id", "title", "topic", "sha256", "word_count", "text")


def _processed(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("document_id"), "text")
    return preprocess(docs, GENERIC)


@query(f"SELECT doc_id::VARCHAR AS article_id, source AS document_id, len({_CLEAN})::BIGINT AS clean_word_count, array_to_string({_CLEAN}, ' ') AS lemmas FROM documents WHERE len({_CLEAN}) >= 20")
def processed_articles(spark, d):
    path = work_dir(spark, "processed")
    io.write_jsonl(_processed(spark, d), path)
    return io.read_processed(spark, path, 20).select("article_id", "document_id", "clean_word_count", F.array_join("lemmas", " ").alias("lemmas"))


@query("SELECT n_name AS text FROM nation")
def text_files(spark, d):
    """A file for each text."""
    path = work_dir(spark, "texts")
    t(spark, d, "nation").select(F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return io.read_text(spark, path + "/*.txt").select(F.rtrim("text").alias("text")).withColumn("text", F.regexp_replace("text", "\n$", ""))


@query("SELECT n_name AS source_file, 2::BIGINT AS article_count, 1::BIGINT AS candidate_count, 'Оператор ' || n_name || ' обязан.' AS sentence FROM nation")
def analysis_json(spark, d):
    """An analysis for each text, each in a JSON file of its own, read with its schema and checks."""
    texts = t(spark, d, "nation").select(F.col("n_name").alias("source_file"), F.concat(F.lit("Статья 1. Первая\nОператор "), F.col("n_name"), F.lit(" обязан.\nСтатья 2.\nКонец.")).alias("text"))
    path = work_dir(spark, "analysis")
    io.summary_json(report.analyse(texts, RUSSIAN)).write.option("maxRecordsPerFile", 1).text(path)
    found = io.read_analysis(spark, path)
    return found.select("source_file", "article_count", "candidate_count", F.col("candidate_requirements")[0]["sentence"].alias("sentence"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, 'a \"quoted\", line' || chr(10) || o_orderstatus AS note FROM orders")
def csv_round_trip(spark, d):
    rows = t(spark, d, "orders").withColumn("note", F.concat(F.lit('a "quoted", line\n'), F.col("o_orderstatus")))
    path = work_dir(spark, "csv")
    io.write_csv(rows, path, ["o_orderkey", "o_orderpriority", "o_totalprice", "note"], allow_empty=False)
    return io.read_csv(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double, note string")


@query("WITH s AS (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY lang) SELECT to_json({'lang': lang, 'n': n, 'characters': characters})::VARCHAR AS value FROM s")
def json_summaries(spark, d):
    rows = t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters"))
    path = work_dir(spark, "json")
    io.write_json(rows, path)
    return spark.read.text(path)


@query(f"WITH {W} SELECT doc_id, term, round(w, 6) AS value FROM w")
def sparse_matrix(spark, d):
    path = work_dir(spark, "sparse")
    io.write_matrix(_weights(spark, d)[2].select("doc_id", "term", F.round("w", 6).alias("value")), path)
    return io.read_matrix(spark, path)


@query("SELECT vec_id, len(embedding)::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def dense_matrix(spark, d):
    path = work_dir(spark, "dense")
    io.write_matrix(t(spark, d, "embeddings").select("vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return io.read_matrix(spark, path).select("vec_id", F.size("embedding").alias("size"), F.round(total, 4).alias("total"))


@query(
    "WITH v(label, label_name) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in constants.LABEL_NAMES.items()) + "), "
    "c AS (SELECT label, label_name, row_number() OVER (ORDER BY label) - 1 AS i FROM v) SELECT label, label_name, count(*) AS n_documents FROM c JOIN documents ON doc_id % (SELECT count(*) FROM c) = i GROUP BY label, label_name"
)
def label_names(spark, d):
    """Documents dealt to the fixed classes by their numbers, with the classes' names."""
    names = constants.label_names(spark)
    order = sorted(constants.LABEL_NAMES)
    label = F.element_at(F.array(*[F.lit(x) for x in order]), (F.col("doc_id") % len(order) + 1).cast("int"))
    return t(spark, d, "documents").select(label.alias("label")).join(names, "label").groupBy("label", "label_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "WITH v(grp, word) AS (VALUES " + ", ".join(f"('{g}', '{w}')" for g, words in constants.EVALUATION_GROUPS.items() for w in words) + "), "
    r"k AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM k GROUP BY word) SELECT grp, v.word, coalesce(n, 0) AS n FROM v LEFT JOIN n USING (word)"
)
def evaluation_groups(spark, d):
    """The fixed groups' words, and how often the documents hold each."""
    counts = frequency.counts(frequency.term_rows(t(spark, d, "documents").select("doc_id", "text")), "term", name="n").withColumnRenamed("term", "word")
    return constants.groups(spark).join(counts, "word", "left").select("grp", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_PAGE = "'<html><body><p>menu</p><div class=\"a text_upd\"><article><h1>Act <b>' || item_id || '</b></h1><p>' || replace(text, chr(10), '<br>') || '</p><ul><li><p>One</p>two</li></ul><div class=\"note\"><p>no</p></div><p>Note. left out</p><script>no</script></article></div></body></html>'"


@query(
    rf"WITH x AS (SELECT item_id::VARCHAR AS id, {_PAGE} AS html, 'Act ' || item_id || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10) || 'One two' AS text FROM benchmark) "
    f"SELECT id, sha256(html) AS sha256, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS word_count, text FROM x"
)
def built_documents(spark, d):
    """Sources, saved pages and their metadata to documents: checksums, the act's blocks, skipped lines, words counted."""
    items = t(spark, d, "benchmark").withColumn("html", F.expr(_PAGE.replace("chr(10)", "'\\n'")))
    own = items.select(F.col("item_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("p").alias("topic"), F.lit("https://example.org/x").alias("url"), F.encode("html", "UTF-8").alias("html"))
    meta = own.select("id", F.lit("2026-01-01T00:00:00Z").alias("fetched_at_utc"), F.sha2("html", 256).alias("sha256"))
    made = io.build_documents(own.drop("html"), own.select("id", "html"), meta, replace(GENERIC, skip_prefixes=("Note.",)), least_words=5)
    return made.select("id", "sha256", "word_count", "text")


# --- filters and derived columns -----------------------------------------------------------------------------------


@query(f"WITH l AS (SELECT doc_id, unnest({LINES_SQL}) AS line FROM documents) SELECT doc_id, count(*) AS n_lines FROM l WHERE NOT (starts_with(line, 'The') OR starts_with(line, 'Den ')) GROUP BY doc_id")
def skipped_lines(spark, d):
    profile = replace(GENERIC, skip_prefixes=("The", "Den "))
    lines = t(spark, d, "documents").select("doc_id", F.explode(normal_lines(F.col("text"))).alias("line"))
    return frequency.counts(lines.filter(~skips(F.col("line"), profile)), "doc_id", name="n_lines")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}'))::INT AS n FROM documents WHERE len(regexp_extract_all(text, '{_WORD}')) >= 1000")
def long_documents(spark, d):
    n = F.size(pattern_words(F.col("text"), GENERIC.word))
    return t(spark, d, "documents").select("doc_id", n.alias("n")).filter("n >= 1000")


@query(f"SELECT doc_id::VARCHAR AS article_id, len({_CLEAN})::BIGINT AS clean_word_count FROM documents WHERE len({_CLEAN}) >= 5")
def clean_documents(spark, d):
    return _processed(spark, d).filter("clean_word_count >= 5").select("article_id", "clean_word_count")


@query(rf"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 40) AS head FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 20")
def accepted_inputs(spark, d):
    rows = t(spark, d, "documents").filter(F.length(collapse(F.col("text"))) >= 20)
    return rows.select("doc_id", F.substring(valid_input(F.col("text")), 1, 40).alias("head"))


@query(f"WITH {GRID_SQL} SELECT 'learning_rate' AS factor, experiment_id, train_documents FROM g WHERE fraction = 1 UNION ALL SELECT 'fraction', experiment_id, train_documents FROM g WHERE learning_rate = 3e-5")
def experiment_factors(spark, d):
    sizes = grid_sizes(spark, d)
    history = sizes.withColumn("source", F.lit("run")).unionByName(sizes.withColumn("source", F.lit("earlier")))
    one = lambda name: experiments.factor(history, name, "run").select(F.lit(name).alias("factor"), "experiment_id", "train_documents")
    return one("learning_rate").unionByName(one("fraction"))


@query(f"WITH w AS (SELECT doc_id, lang, {_N_WORDS}::INT AS n FROM documents) SELECT lang, doc_id, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id)::INT AS rank FROM w QUALIFY rank <= 3")
def longest_by_language(spark, d):
    rows = t(spark, d, "documents").select("lang", "doc_id", n_words(F.col("text")).alias("n"))
    return frequency.top_in_groups(rows, "lang", F.col("n"), 3, "doc_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def best_run(spark, d):
    return metrics.best_run(t(spark, d, "events").filter("value is not null").select("event_id", "value"), "value", "event_id")


@query(f"WITH {TF} SELECT term, round(ln((1.0 + max(n)) / (count(*) + 1)) + 1, 6) AS idf FROM tf, nd GROUP BY term")
def idf_recovered(spark, d):
    docs, tf = _tf(spark, d)
    return tfidf.idf_from_counts(tf, t(spark, d, "documents").count()).select("term", F.round("idf", 6).alias("idf"))


@query("WITH x AS (SELECT n_name AS x FROM nation UNION ALL SELECT (n_nationkey - 3)::VARCHAR FROM nation) SELECT x, greatest(0, least(4, coalesce(TRY_CAST(x AS INT), 1) - 1))::INT AS place FROM x")
def clamped_choices(spark, d):
    n = t(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("x")).union(n.select((F.col("n_nationkey") - 3).cast("string")))
    return rows.select("x", clamped_index(F.col("x"), 5).alias("place"))


@query("SELECT lang, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share FROM documents GROUP BY lang")
def percent_shares(spark, d):
    docs = t(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", percent(F.col("n") / docs.count()).alias("share"))


@query("SELECT event_id, CASE WHEN event_id % 101 / 100.0 >= 0.75 THEN 'высокая' WHEN event_id % 101 / 100.0 >= 0.45 THEN 'средняя' ELSE 'низкая' END AS level FROM events")
def confidence_levels(spark, d):
    return t(spark, d, "events").select("event_id", confidence_level(F.col("event_id") % 101 / 100.0).alias("level"))


# --- whole analyses ------------------------------------------------------------------------------------------------

_ARTICLES = SECTIONS + f", art AS (SELECT doc_id || ':' || ordinal AS article_id, doc_id, number AS article_number, section_title AS article_title, text FROM sections WHERE {_N_WORDS} >= 10)"


def _acts(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")


@query(f"WITH {_ARTICLES} SELECT article_id, doc_id::VARCHAR AS document_id, article_number, article_title, text FROM art")
def document_articles(spark, d):
    return sections.articles(_acts(spark, d), _headed()).select("article_id", "document_id", "article_number", "article_title", "text")


@query(
    f"WITH {_ARTICLES}, c AS (SELECT len(regexp_extract_all(text, '{_WORD}')) AS n, len({_CLEAN}) AS k FROM art) SELECT count(*) AS articles, count(*) FILTER (k >= 5) AS articles_in_matrices, sum(n)::BIGINT AS tokens_before, sum(k)::BIGINT AS tokens_after FROM c"
)
def corpus_summary(spark, d):
    return corpus_analysis(_acts(spark, d), _headed())["summary"]


@query(f"WITH {_ARTICLES}, w AS (SELECT unnest({_CLEAN}) AS word FROM art) SELECT word, count(*) AS frequency FROM w GROUP BY word ORDER BY frequency DESC, word LIMIT 50")
def corpus_top_words(spark, d):
    return corpus_analysis(_acts(spark, d), _headed())["top50_words"]


@query(f"WITH {FIT} SELECT term, total, df FROM voc QUALIFY row_number() OVER (ORDER BY total DESC, term) <= 500")
def pruned_vocabulary(spark, d):
    """The max_features most frequent terms of those that document frequency leaves."""
    return tfidf.fit(_tf(spark, d)[1], t(spark, d, "documents").count(), 2, 0.95, 500).select("term", "total", "df")
