"""Registered queries of dictionaries, saved models, search and experiment arms, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import n_words, preview
from quillspark.functions.vectors import doubles
from quillspark.operators import context, frequency, lemmas, retrieval
from quillspark.plans import search
from quillspark.queries import DIMS, FIT, _mean_vectors, _tokens, query, t
from quillspark.session import work_dir
from quillspark.sources import models

#: A dictionary for the driver's texts: the benchmark's words ending in s, without it.
_FORMS = r"forms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS form FROM benchmark), dict AS (SELECT form, substr(form, 1, length(form) - 1) AS lemma, 'noun' AS pos, CASE WHEN length(form) % 2 = 0 THEN 'even' ELSE 'odd' END AS kase FROM forms WHERE form LIKE '%s')"
_TAGGED = r"tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS term, generate_subscripts(regexp_extract_all(lower(text), '\p{L}{2,}'), 1) AS i FROM documents), tagged AS (SELECT doc_id, i, coalesce(lemma, term) AS lemma, pos, kase FROM tk LEFT JOIN dict ON form = term)"


def _tagged(spark, d):
    forms = frequency.term_rows(t(spark, d, "benchmark"), "item_id").select(F.col("term").alias("form")).filter("form like '%s'").distinct()
    dictionary = forms.select("form", F.expr("substr(form, 1, length(form) - 1)").alias("lemma"), F.lit("noun").alias("pos"), F.when(F.length("form") % 2 == 0, "even").otherwise("odd").alias("case"))
    return lemmas.tag(_tokens(spark, d), dictionary, "doc_id")


@query(f"WITH {_FORMS}, {_TAGGED} SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS lemmas, count(pos) AS n_known FROM tagged GROUP BY doc_id")
def dictionary_lemmas(spark, d):
    rows = _tagged(spark, d).filter("size(tokens) > 0")
    return rows.select("doc_id", F.array_join("tags.lemma", " ").alias("lemmas"), F.size(F.filter("tags", lambda x: x["pos"].isNotNull())).cast("long").alias("n_known"))


@query(f'WITH {_FORMS}, {_TAGGED} SELECT pos, kase AS "case", count(*) AS n FROM tagged GROUP BY pos, kase')
def part_of_speech_counts(spark, d):
    return lemmas.tag_counts(_tagged(spark, d), "pos", "case")


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def saved_vectors(spark, d):
    path = work_dir(spark, "vectors")
    models.save_table(t(spark, d, "embeddings").select("vec_id", "embedding"), path)
    return models.load_table(spark, path).select("vec_id", F.round(F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_ASKED = ("the", "and", "with", "que", "und")


@query(
    f"WITH {FIT}, r AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS vec_id FROM voc), k AS (SELECT doc_id, vec_id, tf.tf * voc.idf AS k FROM tf JOIN r USING (term) JOIN voc USING (term)), "
    + DIMS
    + ", s AS (SELECT doc_id, i, sum(x * k) AS s FROM k JOIN e USING (vec_id) GROUP BY ALL), n AS (SELECT doc_id, i, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS u FROM s), "
    + f"q0 AS (SELECT i, sum(x * idf) AS s FROM r JOIN voc USING (term) JOIN e USING (vec_id) WHERE term IN {_ASKED} GROUP BY i), q AS (SELECT i, s / sqrt(sum(s * s) OVER ()) AS q FROM q0), "
    "b AS (SELECT doc_id, sum(u * q) AS similarity FROM n JOIN q USING (i) GROUP BY doc_id ORDER BY similarity DESC, doc_id LIMIT 10) "
    r"SELECT row_number() OVER (ORDER BY similarity DESC, doc_id)::INT AS rank, doc_id, round(similarity, 4) AS similarity, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 220) AS preview FROM b JOIN documents USING (doc_id)"
)
def text_search(spark, d):
    """The ten documents nearest to a few words by weighted word vectors."""
    docs = t(spark, d, "documents")
    vectors, known = _mean_vectors(spark, d)
    words, idf = known.select(F.col("term").alias("word"), "vector"), known.select("term", "idf")
    asked = spark.createDataFrame([(w,) for w in _ASKED], "term string")
    found = retrieval.search(vectors, search.query_vector(asked, words, idf), 10, "doc_id").select("doc_id", "similarity", "rank")
    return docs.join(found, "doc_id").select("rank", "doc_id", "similarity", preview(F.col("text"), 220).alias("preview"))


# --- trained models: held to their properties by tests, not by SQL ---------------------------------------------------


@query()
def saved_classifier(spark, d):
    """Predictions of all vectors by a regression that was saved and read back."""
    from quillspark.operators.classify import fit_logistic, predict

    e, path = t(spark, d, "embeddings"), work_dir(spark, "classifier")
    models.save_classifier(fit_logistic(e, "label", "embedding", iterations=100), path)
    out = predict(e, models.load_classifier(spark, path), "embedding")
    return out.select("vec_id", "label", "prediction", F.round("confidence", 4).alias("confidence"))


@query()
def tfidf_logreg_metrics(spark, d):
    from quillspark.plans.analysis import tfidf_experiment

    return tfidf_experiment(_long_enough(spark, d), "lang", "doc_id", pattern=frequency.TOKEN)["metrics"]


@query()
def model_comparison(spark, d):
    from quillspark.operators.classify import hash_encoder
    from quillspark.plans.analysis import model_comparison as both

    return both(_long_enough(spark, d), hash_encoder(), 64, "lang", "doc_id")


def _long_enough(spark, d):
    return t(spark, d, "documents").filter(n_words(F.col("text")) >= 20).select("doc_id", "text", "lang")


@query()
def context_vectors(spark, d):
    """The word of every benchmark passage that begins with "the", in its passage."""
    rows = t(spark, d, "benchmark").filter(F.col("text").rlike("(?i)the"))
    return context.word_in_context(rows, "the", context.hash_token_encoder(), "item_id")
