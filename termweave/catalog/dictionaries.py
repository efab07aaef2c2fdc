"""Core, extended, merged and negative dictionaries; samples and keyword lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.cleaning import SQL_ABSTRACT, SQL_FULLTEXT, SQL_GATE, SQL_SPLIT
from termweave.catalog.enrichment import papers_raw
from termweave.catalog.extraction import sql_keyphrases
from termweave.catalog.graphs import SQL_TOPICS, topics
from termweave.catalog.registry import SQL_CORE_RULES, SQL_STOP_WORDS, documents, query, sql_id, sql_words, table
from termweave.catalog.shaping import SQL_KEYWORDS, doc_keywords
from termweave.functions.text import dictionary_words
from termweave.operators.frequency import subtract
from termweave.operators.keyphrase import extract_keywords, keyword_rows
from termweave.operators.patterns import substring_hits
from termweave.plans import dictionaries as dic
from termweave.plans import keyword_graph, samples

SQL_CORE = f"{SQL_KEYWORDS}, {SQL_CORE_RULES}"

SQL_EXTENDED = """extended AS (
    SELECT DISTINCT d.keyword, d.source FROM doc_keywords d WHERE score <= 0.125
    AND list_position(['cso', 'method', 'task'], d.source) =
        (SELECT min(list_position(['cso', 'method', 'task'], o.source)) FROM doc_keywords o WHERE o.keyword = d.keyword AND o.score <= 0.125))"""

SQL_MERGED = f"""{SQL_CORE}, {SQL_EXTENDED},
    merged AS (
        SELECT keyword, source, dict, row_number() OVER (ORDER BY dict, place, source, keyword) - 1 AS trie_id FROM (
            SELECT keyword, source, 'core' AS dict, trie_id AS place FROM core
            UNION ALL SELECT keyword, source, 'extended', 0 FROM extended WHERE keyword NOT IN (SELECT keyword FROM core)))"""


def core_dictionary(spark, sf):
    return dic.core_dictionary(doc_keywords(spark, sf).select("keyword", "score", "source"))


def extended_dictionary(spark, sf):
    """Words of eight letters and more stand in for keywords similar to core keywords."""
    similar = doc_keywords(spark, sf).where("score <= 0.125").select("keyword", "source", F.col("keyword").alias("core_keyword"), F.lit(1.0).alias("cos"))
    return dic.extended_dictionary(similar.distinct(), 0.5)


def merged_dictionary(spark, sf, core=None):
    return dic.merged_dictionary(core_dictionary(spark, sf) if core is None else core, extended_dictionary(spark, sf))


@query(
    "core_dictionary",
    f"WITH {SQL_CORE} SELECT keyword, frequency, round(frequency_normalized, 6) AS frequency_normalized, source, trie_id FROM core",
)
def core(spark, sf):
    return core_dictionary(spark, sf).withColumn("frequency_normalized", F.round("frequency_normalized", 6))


@query("merged_dictionary", f"WITH {SQL_MERGED} SELECT * FROM merged")
def merged(spark, sf):
    return merged_dictionary(spark, sf)


@query("dict_counts", f"WITH {SQL_MERGED} SELECT source, dict, count(*) AS n_keywords FROM merged GROUP BY source, dict")
def dict_counts(spark, sf):
    return dic.dictionary_counts(merged_dictionary(spark, sf))


@query(
    "ngram_sizes",
    "SELECT len(string_split(p_name, ' '))::INT AS n_words, count(*) AS n_phrases FROM (SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part) GROUP BY 1",
)
def ngram_sizes(spark, sf):
    part = table(spark, sf, "part")
    names = part.select("p_name").union(part.select(F.concat_ws(" ", "p_name", F.lower("p_type")))).distinct()
    return names.groupBy(F.size(F.split("p_name", " ")).alias("n_words")).agg(F.count(F.lit(1)).alias("n_phrases"))


@query(
    "topic_keywords",
    f"""WITH {SQL_TOPICS},
    labelled AS (SELECT start_id, regexp_replace(end_id, '#0*', ' number ', 'g') AS end_id FROM topics),
    t1 AS (SELECT end_id FROM labelled WHERE start_id = 'ASIA'),
    t2 AS (SELECT end_id FROM labelled WHERE start_id IN (SELECT end_id FROM t1)),
    t3 AS (SELECT end_id FROM labelled WHERE start_id IN (SELECT end_id FROM t2)),
    met AS (SELECT end_id AS doc_id, end_id AS text, count(*) AS times FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3) GROUP BY end_id),
    {sql_keyphrases('met')}
    SELECT keyword, score, 'cso' AS source FROM (SELECT keyword, score, unnest(range(times)) FROM keyphrase_rows JOIN met USING (doc_id))""",
)
def topic_keywords(spark, sf):
    """Keywords extracted from the labels of all topics below a region; word names need letters."""
    labelled = topics(spark, sf).withColumn("end_id", F.regexp_replace("end_id", "#0*", " number "))
    return dic.topic_keywords(labelled, "ASIA")


def benchmark_words(spark, sf, longer_than):
    words = table(spark, sf, "benchmark").select(F.explode(dictionary_words("text")).alias("keyword"))
    return words.where(F.length("keyword") > longer_than).distinct()


def _sql_found(patterns: str, text: str, source: str, key: str) -> str:
    return f"""pattern AS (SELECT '(' || string_agg(keyword, '|' ORDER BY length(keyword) DESC, keyword) || ')' AS p FROM {patterns}),
    found AS (SELECT {key}, regexp_extract_all({text}, p) AS hits FROM {source}, pattern)"""


def _sql_hits(longer_than: int, text: str, source: str, key: str) -> str:
    words = f"(SELECT DISTINCT unnest({sql_words('text')}) AS keyword FROM benchmark) WHERE length(keyword) > {longer_than}"
    return _sql_found(words, text, source, key)


@query("multi_pattern_hits", f"WITH {_sql_hits(3, 'lower(text)', 'documents', 'doc_id')} SELECT doc_id, hits FROM found")
def multi_pattern_hits(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    return substring_hits(docs, "doc_id", "text", benchmark_words(spark, sf, 3))


FIRST_WORDS = f"(SELECT DISTINCT ({sql_words('text')})[1] AS keyword FROM benchmark)"


@query("few_pattern_hits", f"WITH {_sql_found(FIRST_WORDS, 'lower(text)', 'documents', 'doc_id')} SELECT doc_id, len(hits) AS n_hits, hits FROM found")
def few_pattern_hits(spark, sf):
    """The form for pattern sets that fit one regular expression: the words that open the benchmark texts."""
    openings = table(spark, sf, "benchmark").select(F.try_element_at(dictionary_words("text"), F.lit(1)).alias("keyword")).dropna().distinct()
    docs = documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    found = substring_hits(docs, "doc_id", "text", openings, max_alternatives=1000)
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), "hits")


@query(
    "hit_cap",
    f"""WITH {_sql_hits(3, 'lower(text)', 'documents', 'doc_id')} SELECT doc_id, len(hits) AS n_hits FROM found WHERE len(hits) < 3 ORDER BY n_hits DESC, doc_id""",
)
def hit_cap(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    hits = substring_hits(docs, "doc_id", "text", benchmark_words(spark, sf, 3))
    counted = hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"))
    return counted.where(F.col("n_hits") < 3).orderBy(F.desc("n_hits"), "doc_id")


# Follows SQL_CORE.
SQL_NEGATIVE = f"""cleaned AS (SELECT doc_id, {SQL_ABSTRACT.format('text')} AS t FROM documents WHERE lang = 'en'),
    long_enough AS (SELECT * FROM cleaned WHERE len({SQL_SPLIT.format('t')}) > 10),
    {_sql_found('core', 't', 'long_enough', 'doc_id, t')},
    neg_docs AS (SELECT doc_id, t FROM found WHERE len(hits) < 3),
    negative AS (SELECT keyword, count(*) AS frequency FROM (SELECT unnest(list_filter(string_split(t, ' '), lambda w: length(w) > 3)) AS keyword FROM neg_docs)
                 GROUP BY keyword HAVING count(*) >= 7)"""


def negative_documents(spark, sf, core=None):
    english = documents(spark, sf).where("lang = 'en'").select("doc_id", "text")
    return dic.negative_documents(english, "doc_id", "text", (core_dictionary(spark, sf) if core is None else core).select("keyword"))


@query("negative_documents", f"WITH {SQL_CORE}, {SQL_NEGATIVE} SELECT doc_id, t AS text FROM neg_docs")
def negative_docs(spark, sf):
    return negative_documents(spark, sf)


@query(
    "negative_dictionary",
    f"""WITH {SQL_MERGED}, {SQL_NEGATIVE}
    SELECT keyword, source, dict, keyword IN (SELECT keyword FROM negative) AS removed FROM merged""",
)
def negative_dictionary(spark, sf):
    core = core_dictionary(spark, sf)
    words = negative_documents(spark, sf, core).select(F.explode(F.split("text", " ")).alias("keyword")).where(F.length("keyword") > 3)
    negative = dic.negative_keywords(words)
    kept, removed = dic.split_by_negative(merged_dictionary(spark, sf, core).drop("trie_id"), negative)
    both = kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
    return both.select("keyword", "source", "dict", "removed")


SQL_NEGATIVE_PHRASES = f"{SQL_CORE}, {SQL_NEGATIVE}, neg_texts AS (SELECT doc_id, t AS text FROM neg_docs), {sql_keyphrases('neg_texts')}"


@query("negative_dictionary_extracted", f"WITH {SQL_NEGATIVE_PHRASES} SELECT keyword, count(*) AS frequency FROM keyphrase_rows GROUP BY keyword HAVING count(*) >= 7")
def negative_dictionary_extracted(spark, sf):
    """The same chain with extracted key phrases instead of words."""
    extracted = keyword_rows(extract_keywords(negative_documents(spark, sf), "doc_id", "text"), "doc_id")
    return dic.negative_keywords(extracted)


SQL_CLEAN = f"array_to_string(list_filter({SQL_SPLIT}, lambda w: w NOT IN ({SQL_STOP_WORDS})), ' ')"


@query(
    "positive_sample",
    f"""WITH texts AS (
        SELECT 'd' || doc_id AS id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1
        UNION ALL SELECT 'p' || p_partkey, p_name || ' ' || nullif(p_type, 'ECONOMY') FROM part)
    SELECT id, lower({SQL_CLEAN.format('text')}) AS text FROM texts WHERE length(text) > 20""",
)
def positive_sample(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    papers = documents(spark, sf).join(good, "doc_id").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("abstract"))
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("description")
    )
    return samples.positive_sample(papers, parts)


@query(
    "negative_sample",
    f"""WITH kept AS (SELECT doc_id AS id, {SQL_ABSTRACT.format('text')} AS t FROM documents WHERE lang = 'en'
        AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09))
    SELECT id, lower({SQL_CLEAN.format('t')}) AS text FROM kept WHERE len({SQL_SPLIT.format('t')}) > 10""",
)
def negative_sample(spark, sf):
    works = documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang")
    known = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    tagged = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("id"))
    return samples.negative_sample(works, known, tagged)


@query(
    "samples",
    f"""WITH kept AS (SELECT doc_id AS id, {SQL_ABSTRACT.format('text')} AS t FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
    SELECT doc_id AS id, lower({SQL_CLEAN.format('text')}) AS text, 1 AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND length(text) > 20
    UNION ALL SELECT id, lower({SQL_CLEAN.format('t')}), 0 FROM kept WHERE len({SQL_SPLIT.format('t')}) > 10""",
)
def both_samples(spark, sf):
    docs = documents(spark, sf)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    positive = samples.positive_sample(docs.join(good, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract")))
    nothing = good.where(F.lit(False)).select(F.col("doc_id").alias("id"))
    negative = samples.negative_sample(docs.select(F.col("doc_id").alias("id"), "text", "lang"), good.withColumnRenamed("doc_id", "id"), nothing)
    return samples.labelled(positive, negative)


@query(
    "keyword_lists",
    f"WITH {SQL_KEYWORDS} SELECT doc_id AS n_id, keyword FROM doc_keywords WHERE score <= 0.1",
)
def keyword_lists(spark, sf):
    rows = doc_keywords(spark, sf)
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    targets = rows.select(F.col("keyword").alias("id"), "keyword").distinct()
    edges = rows.select(F.col("doc_id").alias("src"), F.col("keyword").alias("dst"), F.lit("HAS_KEYWORD").alias("type"), "score")
    return samples.positive_keyword_lists(nodes, edges, targets)


@query(
    "negative_keyword_lists",
    f"WITH {SQL_NEGATIVE_PHRASES} SELECT doc_id, list_transform(list_filter(keywords, lambda x: x.score <= 0.1), lambda x: x.keyword) AS keywords FROM keyphrases",
)
def negative_keyword_lists(spark, sf):
    return samples.negative_keyword_lists(negative_documents(spark, sf), "doc_id", "text")


@query(
    "keyword_edges",
    f"""WITH {SQL_KEYWORDS} SELECT doc_id::VARCHAR AS ":START_ID", {sql_id("'keyword/' || keyword")} AS ":END_ID", round(score, 6) AS score, 'abstract' AS source, 'HAS_KEYWORD' AS ":TYPE"
    FROM doc_keywords WHERE score <= 0.1""",
)
def keyword_edges(spark, sf):
    rows = doc_keywords(spark, sf).where("score <= 0.1").select(F.col("doc_id").alias("node_id"), "keyword", F.round("score", 6).alias("score"), F.lit("abstract").alias("source"))
    return keyword_graph.keyword_edges(rows)


@query(
    "keyword_nodes",
    f"""SELECT {sql_id("'keyword/' || keyword")} AS id, keyword
    FROM (SELECT DISTINCT unnest({sql_words('text')}) AS keyword FROM documents UNION SELECT DISTINCT unnest({sql_words('text')}) FROM conversations)""",
)
def keyword_nodes(spark, sf):
    def scored(df, key, source):
        words = F.transform(F.array_distinct(dictionary_words("text")), lambda w: F.struct(w.alias("keyword"), F.lit(0.0).alias("score")))
        return keyword_graph.keyword_list(df.select(key, words.alias("keywords")), key, "keywords", source)

    both = keyword_graph.all_keywords(scored(documents(spark, sf), "doc_id", "abstract"), scored(table(spark, sf, "conversations"), "conv_id", "title"))
    return keyword_graph.keyword_nodes(both)


@query(
    "fulltext_graph",
    f"""WITH {SQL_FULLTEXT},
    gated AS (SELECT doc_id, CASE WHEN {SQL_GATE} THEN trim(t) END AS text FROM body),
    papers AS (SELECT {sql_id("'paper-' || o_orderkey")} AS id, o_orderkey::VARCHAR AS arxiv_id FROM orders)
    SELECT {sql_id("'fulltext/' || arxiv_id")} AS id, text, papers.id AS paper FROM gated JOIN papers ON arxiv_id = doc_id::VARCHAR""",
)
def fulltext_graph(spark, sf):
    files = documents(spark, sf).select(F.concat(F.col("doc_id"), F.lit("v2.pdf")).alias("file"), "text")
    nodes, edges = samples.fulltext_graph(samples.fulltext_files(files, papers_raw(spark, sf).select("id", "arxiv_id")))
    joined = nodes.join(edges, nodes["id:ID"] == edges[":END_ID"])
    return joined.select(F.col("id:ID").alias("id"), "text", F.col(":START_ID").alias("paper"))


@query("dictionary_disjoint", f"WITH {SQL_MERGED} SELECT count(*) AS n, count(DISTINCT keyword) AS n_distinct FROM merged")
def dictionary_disjoint(spark, sf):
    """Core and extended keywords never overlap."""
    found = merged_dictionary(spark, sf)
    ext = found.where("dict = 'extended'")
    clean = subtract(ext, found.where("dict = 'core'"))
    both = clean.unionByName(found.where("dict = 'core'"))
    return both.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
