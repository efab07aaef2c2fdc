"""Projections, filters, samples, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.registry import documents, query, sql_words, table
from termweave.functions.text import dictionary_words
from termweave.operators.frequency import by_precedence, keyword_documents, keyword_frequency, subtract
from termweave.operators.skew import keep_first, smallest_n, with_group_count
from termweave.plans.samples import bernoulli_sample, labelled, plot_range, seeded_sample
from termweave.sources.readers import first_rows


def hash_of(column, seed="42"):
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(column).cast("string")))


def doc_keywords(spark, sf):
    """`(doc_id, keyword, score, source)`: every word occurrence of more than three letters.

    The score is one over the word's length; sources come from the document source.
    """
    source = F.element_at(F.array(F.lit("cso"), F.lit("task"), F.lit("method")), (F.col("doc_id") % 3 + 1).cast("int"))
    words = documents(spark, sf).select("doc_id", source.alias("source"), F.explode(dictionary_words("text")).alias("keyword"))
    return words.where(F.length("keyword") > 3).select("doc_id", "keyword", (F.lit(1.0) / F.length("keyword")).alias("score"), "source")


SQL_KEYWORDS = f"""doc_keywords AS (
    SELECT doc_id, keyword, 1.0::DOUBLE / length(keyword) AS score, ['cso', 'task', 'method'][doc_id % 3 + 1] AS source
    FROM (SELECT doc_id, unnest({sql_words('text')}) AS keyword FROM documents) WHERE length(keyword) > 3)"""


@query(
    "schema_ops",
    "SELECT l_orderkey::VARCHAR AS id, l_partkey AS part, l_quantity AS quantity, 'line' AS dict FROM lineitem",
)
def schema_ops(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_tax")
    renamed = lines.drop("l_tax").toDF("part", "id", "quantity").withColumn("id", F.col("id").cast("string"))
    return renamed.select("id", "part", "quantity").withColumn("dict", F.lit("line"))


@query(
    "predicates",
    """SELECT doc_id, lang, source FROM documents WHERE n_chars BETWEEN 200 AND 4000 AND nullif(lang, 'es') IS NOT NULL
    AND source LIKE '%1%' AND length(text) > 20 AND (lang = 'en' AND source <> 'src11' OR lang = 'fr')""",
)
def predicates(spark, sf):
    is_en, is_fr = F.col("lang") == "en", F.col("lang") == "fr"
    kept = table(spark, sf, "documents").where(
        F.col("n_chars").between(200, 4000) & F.col("source").like("%1%") & (F.length("text") > 20) & (is_en & (F.col("source") != "src11") | is_fr)
    )
    return kept.select("doc_id", F.nullif(F.col("lang"), F.lit("es")).alias("lang"), "source").dropna(subset=["lang"])


@query(
    "or_and_precedence",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' OR o_orderstatus = 'O' AND o_totalprice > 250000",
)
def or_and_precedence(spark, sf):
    status = F.col("o_orderstatus")
    wanted = (status == "F") | (status == "P") | ((status == "O") & (F.col("o_totalprice") > 250000))
    return table(spark, sf, "orders").where(wanted).select("o_orderkey")


@query("score_threshold", f"WITH {SQL_KEYWORDS} SELECT doc_id, keyword, round(score, 6) AS score FROM doc_keywords WHERE score <= 0.1")
def score_threshold(spark, sf):
    return doc_keywords(spark, sf).where(F.col("score").cast("double") <= 0.1).select("doc_id", "keyword", F.round("score", 6).alias("score"))


@query("first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_n(spark, sf):
    return first_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey")


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('42/' || o_orderkey), o_orderkey LIMIT 500")
def sample_n(spark, sf):
    return seeded_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(
    "bernoulli_sample",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('42/' || l_orderkey), 1, 8))::BIGINT < 10 * 4294967296 // 100",
)
def bernoulli(spark, sf):
    return bernoulli_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 10)


@query(
    "balanced_sample",
    """WITH m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
    SELECT o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42/' || o_orderkey), o_orderkey) <= (SELECT n FROM m)""",
)
def balanced_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    smallest = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return smallest_n(orders, hash_of("o_orderkey"), "o_orderkey", smallest, by=["o_orderstatus"])


@query("min_class", "SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def min_class(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest"))


@query(
    "plot_filter",
    "SELECT l_orderkey, l_linenumber, l_tax AS total_weight, l_discount * 10 AS mean_weight FROM lineitem WHERE l_tax > 0.01 AND l_discount * 10 < 0.9",
)
def plot_filter(spark, sf):
    scored = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_tax").alias("total_weight"), (F.col("l_discount") * 10).alias("mean_weight")
    )
    return plot_range(scored)


@query(
    "keyword_frequency",
    f"""WITH {SQL_KEYWORDS}, c AS (SELECT keyword, count(*) AS frequency FROM doc_keywords GROUP BY keyword)
    SELECT keyword, frequency, round(frequency / (SELECT max(frequency) FROM c), 6) AS frequency_normalized FROM c""",
)
def keyword_frequencies(spark, sf):
    return keyword_frequency(doc_keywords(spark, sf)).withColumn("frequency_normalized", F.round("frequency_normalized", 6))


@query(
    "max_share",
    f"""WITH {SQL_KEYWORDS}, c AS (SELECT source, keyword, count(*) AS frequency FROM doc_keywords GROUP BY ALL)
    SELECT source, keyword, frequency, round(frequency / max(frequency) OVER (PARTITION BY source), 6) AS frequency_normalized FROM c""",
)
def max_share(spark, sf):
    return keyword_frequency(doc_keywords(spark, sf), by=["source"]).withColumn("frequency_normalized", F.round("frequency_normalized", 6))


@query(
    "keyword_papers",
    f"""WITH {SQL_KEYWORDS} SELECT keyword, frequency, doc_id FROM (SELECT keyword, doc_id, count(*) OVER (PARTITION BY keyword) AS frequency FROM doc_keywords)
    WHERE frequency BETWEEN 2 AND 50""",
)
def keyword_papers(spark, sf):
    return keyword_documents(doc_keywords(spark, sf).select("doc_id", "keyword"), "doc_id", 2, 50)


@query(
    "freq_range",
    f"WITH {SQL_KEYWORDS} SELECT keyword, count(*) AS frequency FROM doc_keywords GROUP BY keyword HAVING count(*) BETWEEN 7 AND 1000",
)
def freq_range(spark, sf):
    counts = doc_keywords(spark, sf).groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.where(F.col("frequency").between(7, 1000))


@query(
    "group_count_rows",
    f"WITH {SQL_KEYWORDS} SELECT doc_id, keyword, source, count(*) OVER (PARTITION BY keyword) AS frequency FROM doc_keywords",
)
def group_count_rows(spark, sf):
    return with_group_count(doc_keywords(spark, sf).select("doc_id", "keyword", "source"), "keyword").select("doc_id", "keyword", "source", "frequency")


@query(
    "dedup_keep_first",
    f"WITH {SQL_KEYWORDS} SELECT keyword, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM doc_keywords GROUP BY keyword",
)
def dedup_keep_first(spark, sf):
    return keep_first(doc_keywords(spark, sf).select("keyword", "doc_id", "source"), "keyword", ["doc_id"])


@query(
    "keep_first_window",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) = 1",
)
def keep_first_window(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return keep_first(lines, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"])


@query("full_row_dedup", f"WITH {SQL_KEYWORDS} SELECT DISTINCT keyword, source FROM doc_keywords")
def full_row_dedup(spark, sf):
    return doc_keywords(spark, sf).select("keyword", "source").dropDuplicates()


@query(
    "source_precedence",
    f"""WITH {SQL_KEYWORDS}, d AS (SELECT DISTINCT keyword, source FROM doc_keywords)
    SELECT keyword, source FROM d WHERE source = 'cso'
    UNION ALL SELECT keyword, source FROM d WHERE source = 'method' AND keyword NOT IN (SELECT keyword FROM d WHERE source = 'cso')
    UNION ALL SELECT keyword, source FROM d WHERE source = 'task' AND keyword NOT IN (SELECT keyword FROM d WHERE source IN ('cso', 'method'))""",
)
def source_precedence(spark, sf):
    distinct = doc_keywords(spark, sf).select("keyword", "source").distinct()
    return by_precedence(distinct, ("cso", "method", "task"))


@query(
    "freq_sort",
    f"WITH {SQL_KEYWORDS} SELECT keyword, count(*) AS frequency FROM doc_keywords GROUP BY keyword ORDER BY frequency DESC, keyword",
)
def freq_sort(spark, sf):
    counts = doc_keywords(spark, sf).groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "keyword")


@query(
    "topk_keywords",
    f"""WITH {SQL_KEYWORDS}, d AS (SELECT DISTINCT doc_id, keyword, round(score, 9) AS score FROM doc_keywords)
    SELECT doc_id, keyword, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, keyword) <= 10""",
)
def topk_keywords(spark, sf):
    # The list of one document's words is bounded by the document itself.
    best = F.slice(F.array_sort(F.collect_set(F.struct(F.round("score", 9).alias("score"), "keyword"))), 1, 10)
    lists = doc_keywords(spark, sf).groupBy("doc_id").agg(best.alias("best"))
    return lists.select("doc_id", F.inline("best")).select("doc_id", "keyword", F.round("score", 6).alias("score"))


@query(
    "union_tagged",
    "SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark",
)
def union_tagged(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    return docs.unionByName(items)


@query(
    "labelled_union",
    "SELECT d.doc_id, quality AS label FROM documents d JOIN labels USING (doc_id)",
)
def labelled_union(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels")
    positive = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id")
    negative = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id")
    return labelled(positive, negative)


@query(
    "list_difference",
    f"""SELECT conv_id, turn, list_sort(list_filter(list_distinct({sql_words('text')}), lambda x: NOT list_contains({sql_words('role')}, x) AND length(x) > 3)) AS words FROM conversations""",
)
def list_difference(spark, sf):
    words = F.filter(F.array_except(dictionary_words("text"), dictionary_words("role")), lambda w: F.length(w) > 3)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_sort(words).alias("words"))


@query(
    "keyword_subtraction",
    f"WITH {SQL_KEYWORDS} SELECT DISTINCT keyword FROM doc_keywords WHERE keyword NOT IN (SELECT unnest({sql_words('text')}) FROM benchmark)",
)
def keyword_subtraction(spark, sf):
    known = table(spark, sf, "benchmark").select(F.explode(dictionary_words("text")).alias("keyword"))
    return subtract(doc_keywords(spark, sf).select("keyword").distinct(), known)


@query("flatten_distinct", f"SELECT DISTINCT unnest({sql_words('text')}) AS keyword FROM conversations")
def flatten_distinct(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(dictionary_words("text")).alias("keyword")).distinct()


@query("keyword_total", f"SELECT sum(len({sql_words('text')}))::BIGINT AS n_keywords FROM documents")
def keyword_total(spark, sf):
    return documents(spark, sf).agg(F.sum(F.size(dictionary_words("text"))).alias("n_keywords"))
