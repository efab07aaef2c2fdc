"""Models on phrase features and embeddings, class weights and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from termweave.catalog.registry import documents, query, table
from termweave.catalog.scanning import SQL_VOCABULARY, sql_tfidf, vocabulary
from termweave.operators import models
from termweave.operators import tfidf as tf
from termweave.operators.compare import class_report, class_weights


def labelled_documents(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf).join(labels, "doc_id").select("doc_id", "text", "label")


@query(
    "class_weights",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def weights(spark, sf):
    return class_weights(table(spark, sf, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query(
    "class_report",
    """WITH p AS (SELECT label AS l, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS p FROM embeddings),
    cls AS (SELECT l AS class FROM p UNION SELECT p FROM p),
    agg AS (SELECT class, (SELECT count(*) FROM p WHERE l = class) AS support, (SELECT count(*) FROM p WHERE p = class) AS predicted,
                   (SELECT count(*) FROM p WHERE p = class AND l = class) AS hit FROM cls),
    pr AS (SELECT class, support, hit / predicted AS precision, hit / support AS recall FROM agg)
    SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM pr""",
)
def report(spark, sf):
    shifted = (F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10
    predictions = table(spark, sf, "embeddings").select(F.col("label").alias("label"), shifted.alias("prediction"))
    scored = class_report(predictions, "label", "prediction")
    return scored.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def sql_fit(steps: int, reg_param: float = 0.01) -> str:
    """CTEs `fit_idf` and `s{steps}(keyword, w, v)` after `sql_tfidf`; the intercept has an empty keyword."""
    steepest = 0.5 + reg_param
    flat = math.sqrt(reg_param / steepest)
    chain = f"""labelled AS MATERIALIZED (SELECT doc_id, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    fit_idf AS MATERIALIZED (
        SELECT keyword, ln((1 + (SELECT count(*) FROM labelled)) / (1 + count(*))) + 1 AS idf FROM tf JOIN labelled USING (doc_id) GROUP BY keyword),
    fit_w AS (SELECT doc_id, keyword, tf * idf AS w FROM tf JOIN labelled USING (doc_id) JOIN fit_idf USING (keyword)),
    x AS MATERIALIZED (SELECT doc_id, keyword, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM fit_w),
    s0 AS MATERIALIZED (SELECT keyword, 0::DOUBLE AS w, 0::DOUBLE AS v FROM (SELECT keyword FROM fit_idf UNION ALL SELECT ''))"""
    for i in range(1, steps + 1):
        chain += f""",
    e{i} AS MATERIALIZED (
        SELECT doc_id, 1 / (1 + exp(-(coalesce(m, 0) + (SELECT v FROM s{i - 1} WHERE keyword = '')))) - y AS e
        FROM labelled LEFT JOIN (SELECT doc_id, sum(x * v) AS m FROM x JOIN s{i - 1} USING (keyword) GROUP BY doc_id) USING (doc_id)),
    g{i} AS (SELECT keyword, sum(x * e) AS g FROM x JOIN e{i} USING (doc_id) GROUP BY keyword UNION ALL SELECT '', sum(e) FROM e{i}),
    s{i} AS MATERIALIZED (
        SELECT keyword, w2 AS w, w2 + {(1 - flat) / (1 + flat)!r} * (w2 - w) AS v
        FROM (SELECT keyword, w, v - (g / (SELECT count(*) FROM labelled) + CASE WHEN keyword = '' THEN 0 ELSE {reg_param} * v END) / {steepest!r} AS w2
              FROM s{i - 1} JOIN g{i} USING (keyword)))"""
    return chain


FIT_STEPS = 30


@query(
    "batch_score",
    f"""WITH {sql_tfidf()}, {sql_fit(FIT_STEPS)},
    used AS (SELECT doc_id, keyword, tf * coalesce(f.idf, ln(1 + (SELECT count(*) FROM labelled)) + 1) AS u FROM tf LEFT JOIN fit_idf f USING (keyword)),
    scaled AS (SELECT doc_id, keyword, u / sqrt(sum(u * u) OVER (PARTITION BY doc_id)) AS u FROM used),
    margins AS (SELECT doc_id, sum(u * w) AS m FROM scaled JOIN s{FIT_STEPS} USING (keyword) GROUP BY doc_id),
    scored AS (SELECT doc_id, 1 / (1 + exp(-(coalesce(m, 0) + (SELECT w FROM s{FIT_STEPS} WHERE keyword = '')))) AS p FROM documents LEFT JOIN margins USING (doc_id))
    SELECT doc_id, (p > 0.5)::INT AS prediction, round(p, 6) AS probability FROM scored""",
)
def batch_score(spark, sf):
    """Logistic regression on TF-IDF of the vocabulary, fitted on the labelled documents and applied to every document."""
    vocab = vocabulary(spark, sf)
    model = models.fit_text_classifier(labelled_documents(spark, sf), "doc_id", "text", "label", vocab, steps=FIT_STEPS)
    scored = models.score_texts(model, documents(spark, sf).select("doc_id", "text"), "doc_id", "text", vocab)
    return scored.withColumn("probability", F.round("probability", 6))


@query(
    "linear_score",
    f"""WITH {sql_tfidf()}, {SQL_VOCABULARY},
    weighted AS (SELECT doc_id, phrase_id, tf * idf AS w FROM tf JOIN idf USING (keyword) JOIN vocab USING (keyword)),
    lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM weighted GROUP BY doc_id)
    SELECT doc_id, round(1 / (1 + exp(-(sum(w / length * CASE WHEN phrase_id % 3 = 0 THEN 0 ELSE (phrase_id % 7 - 3) / 2 END) + 0.25))), 6) AS probability
    FROM weighted JOIN lengths USING (doc_id) GROUP BY doc_id""",
)
def linear_score(spark, sf):
    """The scoring step by itself, with given coefficients; every third phrase has none."""
    vocab = vocabulary(spark, sf)
    ids = vocab.entries.select(F.col("value").alias("phrase_id")).where("phrase_id % 3 <> 0")
    coefficients = ids.select("phrase_id", ((F.col("phrase_id") % 7 - 3) / 2).alias("weight"))
    features = tf.tfidf(documents(spark, sf), "doc_id", "text", vocab)
    scored = models.linear_scores(features, "doc_id", coefficients, 0.25, vocab)
    return scored.withColumn("probability", F.round("probability", 6))


@query("source_classifier")
def source_classifier(spark, sf):
    source = F.element_at(F.array(F.lit("cso"), F.lit("method"), F.lit("task")), (F.col("label") % 3 + 1).cast("int"))
    vectors = table(spark, sf, "embeddings").select("vec_id", source.alias("source"), "embedding")
    _, predictions = models.fit_source_classifier(vectors, "vec_id", "embedding", "source", balanced=True)
    return class_report(predictions, "source", "predicted")


@query(
    "covariance",
    """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS i FROM embeddings)
    SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0 AS covariance FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i""",
)
def covariance(spark, sf):
    found = models.covariance(table(spark, sf, "embeddings"), "embedding")
    return found.withColumn("covariance", F.round("covariance", 6) + 0.0)


@query("pca2")
def pca2(spark, sf):
    return models.principal_components(table(spark, sf, "embeddings"), "vec_id", "embedding")[0]
