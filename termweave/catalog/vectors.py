"""Embedding queries: similarity join, threshold sweep, extended dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.registry import documents, query, sql_words, table
from termweave.functions.text import dictionary_words
from termweave.functions.vectors import as_doubles, parse_vector, trigram_vector
from termweave.operators.similarity import best_similar, pair_cosines, similar_keywords, threshold_sweep
from termweave.operators.words import word_counts
from termweave.plans import dictionaries as dic
from termweave.session import durable

# The test vectors are random: their cosines stay below 0.5, far under those of real phrase embeddings.
LOWEST = 0.25
THRESHOLDS = [0.25, 0.28, 0.3, 0.33, 0.36, 0.4]


def core_vectors(spark, sf):
    """The even half of the vectors plays the core dictionary, all of them the candidates."""
    source = F.element_at(F.array(F.lit("cso"), F.lit("method"), F.lit("task")), (F.col("label") % 3 + 1).cast("int"))
    even = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == 0)
    return even.select(F.concat(F.lit("k"), "vec_id").alias("keyword"), source.alias("source"), "embedding")


def ext_vectors(spark, sf):
    """All vectors under upper-case names: the even ones equal a core keyword after lower-casing."""
    return table(spark, sf, "embeddings").select(F.concat(F.lit("K"), "vec_id").alias("keyword"), "embedding")


SQL_SIMILAR = f"""similar_rows AS (
    SELECT 'k' || e.vec_id AS keyword, ['cso', 'method', 'task'][c.label % 3 + 1] AS source, 'k' || c.vec_id AS core_keyword,
           list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cos
    FROM embeddings c JOIN embeddings e ON c.vec_id <> e.vec_id
    WHERE c.vec_id % 2 = 0 AND list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) > {LOWEST})"""


def similar(spark, sf, threshold=LOWEST, **limits):
    return similar_keywords(core_vectors(spark, sf), ext_vectors(spark, sf), threshold, **limits)


@query("similar_phrases", f"WITH {SQL_SIMILAR} SELECT keyword, source, core_keyword, round(cos, 6) AS cos FROM similar_rows")
def similar_phrases(spark, sf):
    return similar(spark, sf).withColumn("cos", F.round("cos", 6))


@query("similar_phrases_cells", f"WITH {SQL_SIMILAR} SELECT keyword, source, core_keyword, round(cos, 6) AS cos FROM similar_rows")
def similar_phrases_cells(spark, sf):
    """The form for two sides that are both too large to be sent to every task."""
    return similar(spark, sf, max_bytes=0, rows_per_cell=200).withColumn("cos", F.round("cos", 6))


@query(
    "threshold_sweep",
    f"""WITH {SQL_SIMILAR}, t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold),
    owner AS (SELECT threshold, keyword, min(list_position(['cso', 'method', 'task'], source)) AS rank FROM similar_rows, t WHERE cos > threshold GROUP BY ALL)
    SELECT threshold, count(*) AS n_keywords, count(*) FILTER (rank = 1) AS n_cso, count(*) FILTER (rank = 2) AS n_method, count(*) FILTER (rank = 3) AS n_task
    FROM owner GROUP BY threshold""",
)
def sweep(spark, sf):
    best = best_similar(core_vectors(spark, sf), ext_vectors(spark, sf), LOWEST)
    return threshold_sweep(best, THRESHOLDS, ("cso", "method", "task"))


@query(
    "extended_dictionary",
    f"""WITH {SQL_SIMILAR}, d AS (SELECT DISTINCT keyword, source, core_keyword FROM similar_rows WHERE cos > 0.3)
    SELECT keyword, source, core_keyword FROM d
    QUALIFY list_position(['cso', 'method', 'task'], source) = min(list_position(['cso', 'method', 'task'], source)) OVER (PARTITION BY keyword)""",
)
def extended_dictionary(spark, sf):
    return dic.extended_dictionary(similar(spark, sf, 0.3), 0.3)


@query(
    "cosine_expression",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_expression(spark, sf):
    vectors = table(spark, sf, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = pair_cosines(vectors.join(following, "vec_id"), "embedding", "other")
    return pairs.select("vec_id", F.round("cos", 6).alias("cos"))


@query("text_vector_parse", "SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings")
def text_vector_parse(spark, sf):
    texts = table(spark, sf, "embeddings").select("vec_id", F.to_json(as_doubles("embedding")).alias("text"))
    return texts.select("vec_id", parse_vector("text").alias("vector"))


@query("vector_lookup", "SELECT DISTINCT 'k' || doc_id AS keyword, vec_id, label FROM documents JOIN embeddings ON vec_id = doc_id")
def vector_lookup(spark, sf):
    """Embeddings from a stored vector table, joined by keyword."""
    stored = table(spark, sf, "embeddings").select(F.concat(F.lit("k"), "vec_id").alias("keyword"), "vec_id", "label")
    wanted = documents(spark, sf).select(F.concat(F.lit("k"), "doc_id").alias("keyword")).distinct()
    return wanted.join(stored, "keyword")


SQL_TRIGRAMS = f"""all_words AS (SELECT unnest({sql_words('text')}) AS keyword FROM documents),
    core_words AS (SELECT keyword, min(item_id) AS item FROM (SELECT item_id, unnest({sql_words('text')}) AS keyword FROM benchmark) GROUP BY keyword),
    keywords AS (SELECT keyword FROM all_words UNION SELECT keyword FROM core_words),
    numbers AS (SELECT keyword, ('0x' || substr(md5(substr('  ' || keyword || '  ', i, 3)), 1, 7))::INT AS h
                FROM (SELECT keyword, unnest(range(1, length(keyword) + 3)) AS i FROM keywords)),
    counts AS (SELECT keyword, h % 64 AS slot, sum(CASE WHEN h // 64 % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS n FROM numbers GROUP BY ALL),
    lengths AS (SELECT keyword, sqrt(sum(n * n)) AS length FROM counts GROUP BY keyword),
    trigrams AS (
        SELECT keyword, list(CASE WHEN length = 0 THEN 0 ELSE coalesce(n, 0) / length END ORDER BY s.slot) AS embedding
        FROM (SELECT * FROM lengths, (SELECT unnest(range(64)) AS slot)) s LEFT JOIN counts USING (keyword, slot) GROUP BY keyword)"""


def document_words(spark, sf):
    return documents(spark, sf).select(F.explode(dictionary_words("text")).alias("keyword"))


@query("trigram_vectors", f"WITH {SQL_TRIGRAMS} SELECT keyword, embedding FROM trigrams WHERE keyword IN (SELECT keyword FROM all_words)")
def trigram_vectors(spark, sf):
    """Hashed trigram vectors of all distinct document words."""
    words = document_words(spark, sf).distinct()
    return words.select("keyword", trigram_vector("keyword").alias("embedding"))


# Cosines of these vectors are whole numbers over square roots of whole numbers; none lies at this limit.
NEAR_WORDS = 0.7501


@query(
    "similar_words",
    f"""WITH {SQL_TRIGRAMS}, near_words AS (
        SELECT e.keyword, ['cso', 'method', 'task'][item % 3 + 1] AS source, c.keyword AS core_keyword
        FROM core_words JOIN trigrams c USING (keyword) JOIN trigrams e ON e.keyword <> c.keyword
        WHERE e.keyword IN (SELECT keyword FROM all_words) AND list_inner_product(c.embedding, e.embedding) > {NEAR_WORDS})
    SELECT keyword, source, core_keyword FROM near_words
    QUALIFY list_position(['cso', 'method', 'task'], source) = min(list_position(['cso', 'method', 'task'], source)) OVER (PARTITION BY keyword)""",
)
def similar_words(spark, sf):
    """Extended dictionary end to end on trigram vectors: all document words near a word of the benchmark texts."""
    source = F.element_at(F.array(F.lit("cso"), F.lit("method"), F.lit("task")), (F.col("item") % 3 + 1).cast("int"))
    held = table(spark, sf, "benchmark").select("item_id", F.explode(dictionary_words("text")).alias("keyword"))
    core = held.groupBy("keyword").agg(F.min("item_id").alias("item")).select("keyword", source.alias("source"), trigram_vector("keyword").alias("embedding"))
    # The texts are read once, vectors made once and pairs found once; each is read several times below.
    words = durable(word_counts(documents(spark, sf), "text").groupBy("keyword").agg(F.sum("times").alias("times")))
    vectors = words.select("keyword", trigram_vector("keyword").alias("embedding"))
    ext = dic.extended_candidates(words.withColumn("score", F.lit(0.0)), vectors, times="times")
    similar = similar_keywords(durable(core), durable(ext.select("keyword", "embedding")), NEAR_WORDS)
    return dic.extended_dictionary(durable(similar), NEAR_WORDS)
