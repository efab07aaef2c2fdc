"""Key-phrase extraction: term statistics, scores and the final lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.cleaning import SQL_EXTRACTION, SQL_KEYWORD
from termweave.catalog.registry import SQL_CORE_RULES, SQL_STOP_WORDS, documents, query, sql_id, table
from termweave.functions import fixed
from termweave.operators import keyphrase as kp
from termweave.plans import dictionaries as dic
from termweave.plans import keyword_graph


def sql_tokens(rows: str) -> str:
    """Tokens of `rows(doc_id, text)`."""
    return f"""
    plain AS (SELECT doc_id, {SQL_EXTRACTION} AS t FROM {rows}),
    parsed AS (
        SELECT doc_id, list_filter(list_transform(string_split_regex(t, '[.!?]+'),
            lambda s: list_filter(string_split_regex(replace(s, ',', ' '), '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z]'))), lambda x: len(x) > 0) AS sents
        FROM plain),
    sent_rows AS (SELECT doc_id, len(sents) AS n_sents, unnest(sents) AS words, generate_subscripts(sents, 1) - 1 AS sent FROM parsed),
    tok AS (SELECT doc_id, n_sents, sent, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM sent_rows)"""


def sql_stats(rows: str) -> str:
    return f"""{sql_tokens(rows)},
    own AS (
        SELECT doc_id, lower(word) AS term, sent, count(*) AS n, sum((length(word) > 1 AND upper(word) = word)::INT) AS up,
               sum((place > 0 AND word[1] BETWEEN 'A' AND 'Z')::INT) AS cap, max(n_sents) AS n_sents
        FROM tok GROUP BY ALL),
    occ AS (
        SELECT doc_id, term, sum(n)::BIGINT AS tf, sum(up)::BIGINT AS tf_upper, sum(cap)::BIGINT AS tf_capital, count(*) AS sents,
               median(sent) AS median_sent, max(n_sents)::BIGINT AS n_sents
        FROM own GROUP BY doc_id, term),
    lows AS (SELECT doc_id, sent, place, lower(word) AS term FROM tok),
    before AS (
        SELECT doc_id, term, unnest([lag(term, 1) OVER o, lag(term, 2) OVER o, lag(term, 3) OVER o, lag(term, 4) OVER o, lag(term, 5) OVER o]) AS other
        FROM lows WINDOW o AS (PARTITION BY doc_id, sent ORDER BY place)),
    pairs AS (SELECT doc_id, term, other, count(*) AS n FROM before WHERE other IS NOT NULL GROUP BY ALL),
    lefts AS (SELECT doc_id, term, count(*) AS left_terms, sum(n)::BIGINT AS left_total FROM pairs GROUP BY ALL),
    rights AS (SELECT doc_id, other AS term, count(*) AS right_terms, sum(n)::BIGINT AS right_total FROM pairs GROUP BY ALL),
    stats AS (
        SELECT doc_id, term, tf, tf_upper, tf_capital, sents, median_sent, n_sents, coalesce(left_terms, 0) AS left_terms, coalesce(left_total, 0) AS left_total,
               coalesce(right_terms, 0) AS right_terms, coalesce(right_total, 0) AS right_total
        FROM occ LEFT JOIN lefts USING (doc_id, term) LEFT JOIN rights USING (doc_id, term))"""


def sql_scores(rows: str) -> str:
    return f"""{sql_stats(rows)},
    spread AS (SELECT doc_id, max(tf) AS max_tf, coalesce(avg(tf) FILTER (term NOT IN ({SQL_STOP_WORDS})) + stddev_pop(tf) FILTER (term NOT IN ({SQL_STOP_WORDS})), 0) AS spread
               FROM stats GROUP BY doc_id),
    parts AS (
        SELECT stats.*, greatest(tf_upper, tf_capital) / (1 + ln(tf)) AS tcase, ln(ln(3 + median_sent)) AS tpos, CASE WHEN spread > 0 THEN tf / spread ELSE tf END AS tfreq,
               1 + (CASE WHEN left_total > 0 THEN left_terms / left_total ELSE 0 END + CASE WHEN right_total > 0 THEN right_terms / right_total ELSE 0 END) * tf / max_tf AS rel
        FROM stats JOIN spread USING (doc_id)),
    scores AS (SELECT doc_id, term, tf, rel * tpos / (tcase + tfreq / rel + (sents / n_sents) / rel) AS score FROM parts)"""


SQL_CANDIDATES = f"""
    run_words AS (SELECT doc_id, lower(word) AS w1, lower(lead(word, 1) OVER o) AS w2, lower(lead(word, 2) OVER o) AS w3 FROM tok WINDOW o AS (PARTITION BY doc_id, sent ORDER BY place)),
    runs AS (
        SELECT doc_id, [w1] AS terms FROM run_words WHERE w1 NOT IN ({SQL_STOP_WORDS})
        UNION ALL SELECT doc_id, [w1, w2] FROM run_words WHERE w1 NOT IN ({SQL_STOP_WORDS}) AND w2 IS NOT NULL AND w2 NOT IN ({SQL_STOP_WORDS})
        UNION ALL SELECT doc_id, [w1, w2, w3] FROM run_words WHERE w1 NOT IN ({SQL_STOP_WORDS}) AND w3 IS NOT NULL AND w3 NOT IN ({SQL_STOP_WORDS})),
    candidates AS (SELECT doc_id, terms, count(*) AS tf FROM runs GROUP BY ALL)"""


SQL_PHRASES = f"""{SQL_CANDIDATES},
    phrase_terms AS (SELECT doc_id, terms, tf, unnest(terms) AS term FROM candidates),
    phrases AS (
        SELECT doc_id, array_to_string(terms, ' ') AS phrase, p.tf, product(score) / (p.tf * (1 + sum(score))) AS score
        FROM phrase_terms p JOIN scores USING (doc_id, term) GROUP BY doc_id, terms, p.tf)"""


def sql_keyphrases(rows: str) -> str:
    """`keyphrases(doc_id, keywords)` of `rows(doc_id, text)`: the best phrases in order, near copies of a taken one left out, cleaned, short ones dropped."""
    return f"""{sql_scores(rows)}, {SQL_PHRASES},
    ranked AS (SELECT doc_id, list([{{'keyword': phrase, 'score': s}}] ORDER BY s, phrase) AS r FROM (SELECT doc_id, phrase, round(score, 9) AS s FROM phrases) GROUP BY doc_id),
    taken AS (
        SELECT doc_id, list_reduce(r, lambda kept, c: CASE WHEN len(kept) < {kp.TOP} AND len(list_filter(kept, lambda k:
            1 - levenshtein(k.keyword, c[1].keyword) / greatest(length(k.keyword), length(c[1].keyword)) > {kp.DEDUP_LIMIT})) = 0 THEN list_concat(kept, c) ELSE kept END) AS k FROM ranked),
    named AS (SELECT doc_id, list_transform(k, lambda x: {{'keyword': {SQL_KEYWORD.format("x.keyword")}, 'score': x.score}}) AS k FROM taken),
    keyphrases AS (
        SELECT i.doc_id, coalesce(list_filter(k, lambda x: length(x.keyword) > {fixed.MIN_KEYWORD_CHARS}), []) AS keywords FROM {rows} i LEFT JOIN named ON named.doc_id = i.doc_id),
    keyphrase_rows AS (SELECT doc_id, x.keyword, x.score FROM (SELECT doc_id, unnest(keywords) AS x FROM keyphrases))"""


def texts(spark, sf):
    return documents(spark, sf).select("doc_id", "text")


@query("keyphrases_term_stats", f"WITH {sql_stats('documents')} SELECT * FROM stats")
def term_stats(spark, sf):
    return kp.term_statistics(texts(spark, sf), "doc_id", "text")


@query("keyphrases_term_scores", f"WITH {sql_scores('documents')} SELECT doc_id, term, tf, round(score, 6) AS score FROM scores")
def term_scores(spark, sf):
    return kp.scored_terms(texts(spark, sf), "doc_id", "text").withColumn("score", F.round("score", 6))


@query("keyphrases_candidates", f"WITH {sql_tokens('documents')}, {SQL_CANDIDATES} SELECT doc_id, array_to_string(terms, ' ') AS phrase, tf FROM candidates")
def candidates(spark, sf):
    return kp.candidate_phrases(texts(spark, sf), "doc_id", "text")


@query(
    "keyphrases_phrase_scores",
    f"WITH {sql_scores('documents')}, {SQL_PHRASES} SELECT doc_id, phrase, tf, round(score, 6) AS score FROM phrases",
)
def phrase_scores(spark, sf):
    return kp.scored_phrases(texts(spark, sf), "doc_id", "text").withColumn("score", F.round("score", 6))


@query("keyphrases_top10", f"WITH {sql_keyphrases('documents')} SELECT * FROM keyphrases")
def top10(spark, sf):
    return kp.extract_keywords(texts(spark, sf), "doc_id", "text")


@query(
    "keyphrases_in_chunks",
    f"""WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, text, string_split_regex(lower(text), '[.!?]') AS chunks FROM conversations), {sql_keyphrases('turns')}
    SELECT k.doc_id AS id, list_filter(keywords, lambda x: len(list_filter(chunks, lambda c: contains(c, x.keyword))) > 0) AS keywords
    FROM keyphrases k JOIN turns USING (doc_id)""",
)
def keyphrases_in_chunks(spark, sf):
    """Extraction with noun chunks from an input column; whole sentences stand in for them."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.split(F.lower("text"), "[.!?]").alias("chunks")
    )
    return kp.extract_keywords(turns, "id", "text", chunks="chunks")


@query(
    "extracted_keyword_edges",
    f"""WITH {sql_keyphrases('documents')}
    SELECT doc_id::VARCHAR AS ":START_ID", {sql_id("'keyword/' || keyword")} AS ":END_ID", score, 'abstract' AS source, 'HAS_KEYWORD' AS ":TYPE" FROM keyphrase_rows""",
)
def extracted_keyword_edges(spark, sf):
    found = kp.extract_keywords(texts(spark, sf), "doc_id", "text")
    return keyword_graph.keyword_edges(keyword_graph.keyword_list(found, "doc_id", "keywords", "abstract"))


@query(
    "extracted_core_dictionary",
    f"""WITH {sql_keyphrases('documents')}, doc_keywords AS (SELECT keyword, score, {list(fixed.SOURCE_PRECEDENCE_CORE)}[doc_id % 3 + 1] AS source FROM keyphrase_rows), {SQL_CORE_RULES}
    SELECT * FROM core""",
)
def extracted_core_dictionary(spark, sf):
    """Core dictionary from extracted key phrases of three document groups."""
    found = kp.keyword_rows(kp.extract_keywords(texts(spark, sf), "doc_id", "text"), "doc_id")
    source = F.element_at(F.array(*[F.lit(s) for s in fixed.SOURCE_PRECEDENCE_CORE]), (F.col("doc_id") % 3 + 1).cast("int"))
    return dic.core_dictionary(found.select("keyword", "score", source.alias("source")))
