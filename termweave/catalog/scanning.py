"""Phrase-dictionary scans, per-document metrics and sample comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.catalog.registry import documents, phrase_dictionary, phrase_table, query, sql_greedy, sql_phrases, sql_prefixes, sql_words, table
from termweave.functions.text import dictionary_words, split_words
from termweave.operators import tfidf as tf
from termweave.operators.compare import five_numbers, metric_histogram, sample_statistics
from termweave.operators.dictionary import PhraseDictionary
from termweave.operators.skew import dense_id
from termweave.plans.samples import METRICS, plot_range, score_corpus
from termweave.session import scratch_path
from termweave.sources import store

SQL_DICT = sql_phrases() + "," + sql_prefixes()

SQL_WORD_METRICS = f"""{sql_phrases()},
    tok AS (SELECT doc_id, unnest(w) AS word FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [NULL] ELSE w END AS w FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents))),
    scored AS (
        SELECT doc_id, count(weight) AS n_hits, CASE WHEN count(word) > 0 THEN count(weight) / count(word) ELSE 0 END AS ratio,
               coalesce(avg(weight), 0) AS mean_weight, coalesce(sum(weight), 0) AS total_weight
        FROM tok LEFT JOIN phrases ON phrases.n = 1 AND phrases.keyword = tok.word GROUP BY doc_id)"""


def rounded(*names):
    return [F.round(c, 6).alias(c) for c in names]


SQL_ROUNDED = "n_hits, round(ratio, 6) AS ratio, round(mean_weight, 6) AS mean_weight, round(total_weight, 6) AS total_weight"


def quarter(dictionary):
    return dictionary.size().prefixes // 4 + 1


def scored_documents(spark, sf):
    return score_corpus(documents(spark, sf), "doc_id", "text", phrase_dictionary(spark, sf))


def scored_samples(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("sample"))
    return plot_range(scored_documents(spark, sf)).join(labels, "doc_id")


@query("aggregate_search_info", f"WITH {SQL_WORD_METRICS} SELECT doc_id, {SQL_ROUNDED} FROM scored")
def aggregate_search_info(spark, sf):
    return scored_documents(spark, sf).select("doc_id", "n_hits", *rounded("ratio", "mean_weight", "total_weight"))


@query("aggregate_search_info_joined", f"WITH {SQL_WORD_METRICS} SELECT doc_id, {SQL_ROUNDED} FROM scored")
def aggregate_search_info_joined(spark, sf):
    """The same with the dictionary cut into four slices, as one too large for a task is."""
    dictionary = phrase_dictionary(spark, sf)
    scored = score_corpus(documents(spark, sf), "doc_id", "text", dictionary, max_prefixes=quarter(dictionary))
    return scored.select("doc_id", "n_hits", *rounded("ratio", "mean_weight", "total_weight"))


@query("search_ratio", f"WITH {SQL_WORD_METRICS} SELECT doc_id, n_hits, round(ratio, 6) AS ratio FROM scored")
def search_ratio(spark, sf):
    unweighted = PhraseDictionary.build(phrase_table(spark, sf), "keyword", "value")
    return unweighted.word_metrics(documents(spark, sf), "doc_id", "text").select("doc_id", "n_hits", F.round("ratio", 6).alias("ratio"))


SQL_SAMPLES = f"""{SQL_WORD_METRICS},
    plotted AS (SELECT quality AS sample, scored.* FROM scored JOIN labels USING (doc_id) WHERE total_weight > 0.01 AND mean_weight < 0.9)"""


@query(
    "sample_stats",
    f"WITH {SQL_SAMPLES} SELECT sample, count(*) AS n_docs, "
    + ", ".join(f"round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS std_{m}" for m in METRICS)
    + " FROM plotted GROUP BY sample",
)
def sample_stats(spark, sf):
    stats = sample_statistics(scored_samples(spark, sf), "sample", METRICS)
    return stats.select("sample", "n_docs", *rounded(*stats.columns[2:]))


@query(
    "metric_histogram",
    f"""WITH {SQL_SAMPLES} SELECT sample, CASE WHEN ratio < 0 THEN 0 WHEN ratio >= 1 THEN 21 ELSE floor(ratio * 20)::INT + 1 END AS bin, count(*) AS n_docs
    FROM plotted GROUP BY ALL""",
)
def ratio_histogram(spark, sf):
    binned = metric_histogram(scored_samples(spark, sf), "sample", "ratio", 0.0, 1.0, 20)
    return binned.withColumn("bin", F.col("bin").cast("int"))


@query(
    "metric_quartiles",
    f"""WITH {SQL_SAMPLES} SELECT sample, round(min(total_weight), 6) AS minimum, round(quantile_cont(total_weight, 0.25), 6) AS quartile1, round(median(total_weight), 6) AS median,
    round(quantile_cont(total_weight, 0.75), 6) AS quartile3, round(max(total_weight), 6) AS maximum FROM plotted GROUP BY sample""",
)
def metric_quartiles(spark, sf):
    numbers = five_numbers(scored_samples(spark, sf), "sample", "total_weight")
    return numbers.select("sample", *rounded(*numbers.columns[1:]))


@query("prefix_table", f"WITH {SQL_DICT} SELECT prefix, depth::INT AS depth, is_terminal, value, round(weight, 6) AS weight FROM prefixes")
def prefix_table(spark, sf):
    rows = phrase_dictionary(spark, sf).prefixes
    return rows.select("prefix", "depth", "is_terminal", "value", F.round("weight", 6).alias("weight"))


@query(
    "dictionary_fold",
    f"""SELECT phrase, list_reduce(list(p_partkey ORDER BY p_partkey), lambda old, new: (3 * old + new) % 1000003) AS value
    FROM (SELECT p_partkey, array_to_string({sql_words('p_type')}, ' ') AS phrase FROM part) GROUP BY phrase""",
)
def dictionary_fold(spark, sf):
    """Values of a repeated phrase folded in the order of insertion, by a rule that depends on it."""
    built = PhraseDictionary.build(table(spark, sf, "part"), "p_type", "p_partkey", fold=lambda old, new: (3 * old + new) % 1000003)
    return built.entries.select("phrase", "value")


@query("trie_counts", f"WITH {SQL_DICT} SELECT count(*) + 1 AS nodes, count(*) FILTER (is_terminal) AS phrases FROM prefixes")
def trie_counts(spark, sf):
    return phrase_dictionary(spark, sf).counts()


def ordered_dictionary(spark, sf):
    """Phrases inserted by falling frequency."""
    rows = phrase_table(spark, sf)
    return PhraseDictionary.build(dense_id(rows, [F.desc("frequency"), "keyword"], "trie_id"), weight="weight")


SQL_PHRASE_IDS = f"""{sql_phrases()},
    inserted AS (SELECT keyword, n, row_number() OVER (ORDER BY frequency DESC, keyword) - 1 AS ord FROM phrases),
    steps AS (SELECT keyword, k, array_to_string(string_split(keyword, ' ')[1:k], ' ') AS prefix, ord FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM inserted)),
    firsts AS (SELECT prefix, min(ord) AS first FROM steps GROUP BY prefix),
    paths AS (SELECT keyword, list(first ORDER BY k) AS path FROM steps JOIN firsts USING (prefix) GROUP BY keyword),
    phrase_ids AS (SELECT row_number() OVER (ORDER BY path) - 1 AS phrase_id, keyword AS phrase FROM paths)"""


@query("phrase_ids", f"WITH {SQL_PHRASE_IDS} SELECT phrase_id, phrase FROM phrase_ids")
def phrase_ids(spark, sf):
    return ordered_dictionary(spark, sf).phrase_ids()


@query(
    "phrase_match",
    f"""WITH {sql_phrases()}, t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT page_id, url FROM pages UNION ALL SELECT p_partkey, p_name FROM part UNION ALL SELECT item_id, unnest({sql_words('text')}) FROM benchmark)
    SELECT id, text, phrases.keyword IS NOT NULL AS matched, value, round(weight, 6) AS weight
    FROM t LEFT JOIN phrases ON phrases.keyword = array_to_string({sql_words('t.text')}, ' ')""",
)
def phrase_match(spark, sf):
    """Look-up of whole texts of any kind; most are no phrase, the words of the benchmark are."""
    parts = [
        documents(spark, sf).select(F.col("doc_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, sf, "pages").select("page_id", "url"),
        table(spark, sf, "part").select("p_partkey", "p_name"),
        table(spark, sf, "benchmark").select("item_id", F.explode(dictionary_words("text"))),
    ]
    found = phrase_dictionary(spark, sf).match(reduce(DataFrame.union, parts), "text")
    return found.select("id", "text", "matched", "value", F.round("weight", 6).alias("weight"))


SQL_DOC_HITS = f"{SQL_DICT}, docs AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), {sql_greedy('docs', 'doc_id')}"
SQL_SEARCH = f"WITH RECURSIVE {SQL_DOC_HITS} SELECT doc_id, pos::INT AS pos, n::INT AS n, phrase, value FROM hits"


def exploded(found, key):
    return found.select(key, F.inline("hits")).select(key, "pos", "n", "phrase", "value")


@query("trie_search", SQL_SEARCH)
def trie_search(spark, sf):
    return exploded(phrase_dictionary(spark, sf).search(documents(spark, sf), "doc_id", "text"), "doc_id")


@query("trie_search_joined", SQL_SEARCH)
def trie_search_joined(spark, sf):
    """The same with the dictionary cut into four slices, as one too large for a task is."""
    dictionary = phrase_dictionary(spark, sf)
    return exploded(dictionary.search(documents(spark, sf), "doc_id", "text", max_prefixes=quarter(dictionary)), "doc_id")


_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
SQL_LEMMAS = f"""{sql_phrases().replace('phrases AS', 'plain_phrases AS')},
    lemmas AS (SELECT DISTINCT word, substr(word, 1, length(word) - 1) AS lemma FROM (SELECT unnest({_TOKENS}) AS word FROM documents) WHERE word LIKE '%s'),
    tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
    joined AS (SELECT doc_id, string_agg(coalesce(lemma, tokens.word), ' ' ORDER BY pos) AS text FROM tokens LEFT JOIN lemmas USING (word) GROUP BY doc_id),
    docs AS (SELECT documents.doc_id, CASE WHEN joined.text IS NULL THEN [] ELSE {sql_words('joined.text')} END AS w FROM documents LEFT JOIN joined USING (doc_id)),
    said AS (SELECT keyword, n, value, weight, unnest(string_split(keyword, ' ')) AS word, unnest(range(n)) AS pos FROM plain_phrases),
    renamed AS (SELECT keyword, n, value, weight, string_agg(coalesce(lemma, said.word), ' ' ORDER BY pos) AS phrase FROM said LEFT JOIN lemmas USING (word) GROUP BY keyword, n, value, weight),
    phrases AS (SELECT phrase AS keyword, n, arg_max(value, ord) AS value, arg_max(weight, ord) AS weight
                FROM (SELECT *, row_number() OVER (ORDER BY keyword) AS ord FROM renamed) WHERE phrase <> '' GROUP BY phrase, n)"""


def plural_words(spark, sf):
    """Lemma table: every token of the documents that ends in "s", without it."""
    tokens = table(spark, sf, "documents").select(F.explode(split_words("text")).alias("word")).distinct()
    return tokens.where(F.endswith("word", F.lit("s"))).select("word", F.expr("substr(word, 1, length(word) - 1)").alias("lemma"))


def lemma_dictionary(spark, sf):
    """Phrases inserted in alphabetical order, compared by lemmas."""
    rows = dense_id(phrase_table(spark, sf), ["keyword"], "at")
    return PhraseDictionary.build(rows, "keyword", "value", "weight", order="at", lemmas=plural_words(spark, sf))


@query(
    "trie_search_lemmas",
    f"WITH RECURSIVE {SQL_LEMMAS}, {sql_prefixes()}, {sql_greedy('docs', 'doc_id')} SELECT doc_id, pos::INT AS pos, n::INT AS n, phrase, value FROM hits",
)
def trie_search_lemmas(spark, sf):
    return exploded(lemma_dictionary(spark, sf).search(documents(spark, sf), "doc_id", "text"), "doc_id")


@query(
    "aggregate_search_info_lemmas",
    f"""WITH {SQL_LEMMAS}, tok AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM docs),
    scored AS (
        SELECT doc_id, count(weight) AS n_hits, CASE WHEN count(word) > 0 THEN count(weight) / count(word) ELSE 0 END AS ratio,
               coalesce(avg(weight), 0) AS mean_weight, coalesce(sum(weight), 0) AS total_weight
        FROM tok LEFT JOIN phrases ON phrases.n = 1 AND phrases.keyword = tok.word GROUP BY doc_id)
    SELECT doc_id, {SQL_ROUNDED} FROM scored""",
)
def aggregate_search_info_lemmas(spark, sf):
    scored = lemma_dictionary(spark, sf).word_metrics(documents(spark, sf), "doc_id", "text")
    return scored.select("doc_id", "n_hits", *rounded("ratio", "mean_weight", "total_weight"))


@query("trie_search_stored", SQL_SEARCH)
def trie_search_stored(spark, sf):
    """The scan with a dictionary whose prefix table was written and read again, weights included."""
    path = scratch_path(spark)
    rows = phrase_table(spark, sf).select("keyword", "weight", F.col("value").alias("trie_id"), F.lit("core").alias("dict"), F.lit("benchmark").alias("source"))
    store.save_store(rows, path, weight="weight")
    dictionary = PhraseDictionary.from_prefixes(store.load_part(spark, path, dict_name="core"), weighted=True)
    return exploded(dictionary.search(documents(spark, sf), "doc_id", "text"), "doc_id")


@query(
    "search_metrics",
    f"""WITH RECURSIVE {SQL_DOC_HITS}, m AS (SELECT doc_id, count(*) AS n_hits, avg(weight) AS mean_weight, sum(weight) AS total_weight FROM hits GROUP BY doc_id)
    SELECT doc_id, coalesce(n_hits, 0) AS n_hits, round(coalesce(mean_weight, 0), 6) AS mean_weight, round(coalesce(total_weight, 0), 6) AS total_weight
    FROM documents LEFT JOIN m USING (doc_id)""",
)
def search_metrics(spark, sf):
    found = phrase_dictionary(spark, sf).search_metrics(documents(spark, sf), "doc_id", "text")
    return found.select("doc_id", "n_hits", *rounded("mean_weight", "total_weight"))


@query(
    "search_absolute",
    f"""WITH RECURSIVE {SQL_DOC_HITS}, m AS (SELECT doc_id, count(*) AS n_hits FROM hits GROUP BY doc_id)
    SELECT doc_id, coalesce(n_hits, 0) AS n_hits FROM documents LEFT JOIN m USING (doc_id)""",
)
def search_absolute(spark, sf):
    return phrase_dictionary(spark, sf).search_count(documents(spark, sf), "doc_id", "text")


@query(
    "search_list",
    f"""WITH RECURSIVE {SQL_DICT},
    docs AS (SELECT conv_id * 1000 + turn AS element, {sql_words('text')} AS w FROM conversations),
    {sql_greedy('docs', 'element')}
    SELECT element // 1000 AS conv_id, phrase, value, count(*) AS n FROM hits GROUP BY ALL""",
)
def search_list(spark, sf):
    """Conversations as lists of turns; no phrase crosses a turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("texts"))
    found = phrase_dictionary(spark, sf).search_list(lists, "conv_id", "texts")
    return exploded(found, "conv_id").groupBy("conv_id", "phrase", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "phrase_doc_matrix",
    f"""WITH RECURSIVE {SQL_PHRASE_IDS}, {sql_prefixes()}, docs AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), {sql_greedy('docs', 'doc_id')}
    SELECT doc_id, phrase_id, count(*) AS n FROM hits JOIN phrase_ids USING (phrase) GROUP BY ALL""",
)
def phrase_doc_matrix(spark, sf):
    return ordered_dictionary(spark, sf).document_matrix(documents(spark, sf), "doc_id", "text")


@query(
    "phrase_list_matrix",
    f"""WITH {SQL_PHRASE_IDS}, d AS (SELECT doc_id, unnest({sql_words('text')}) AS phrase FROM documents)
    SELECT doc_id, phrase_id, count(*) AS n FROM d JOIN phrase_ids USING (phrase) GROUP BY ALL""",
)
def phrase_list_matrix(spark, sf):
    lists = documents(spark, sf).select("doc_id", dictionary_words("text").alias("phrases"))
    return ordered_dictionary(spark, sf).document_matrix(lists, "doc_id", "phrases")


def sql_tfidf() -> str:
    from termweave.catalog.cleaning import SQL_FOLD
    from termweave.catalog.registry import SQL_STOP_WORDS

    return f"""{sql_phrases(4)},
    words AS (SELECT doc_id, list_filter(regexp_extract_all(lower({SQL_FOLD.format('text')}), '\\b\\w\\w+\\b'), lambda w: w NOT IN ({SQL_STOP_WORDS})) AS w FROM documents),
    tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
    grams AS (SELECT doc_id, word AS g1, word || ' ' || lead(word, 1) OVER o AS g2, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g3,
                     word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS g4
              FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    tf AS (SELECT doc_id, keyword, count(*) AS tf
           FROM (SELECT doc_id, g1 AS keyword FROM grams UNION ALL SELECT doc_id, g2 FROM grams UNION ALL SELECT doc_id, g3 FROM grams UNION ALL SELECT doc_id, g4 FROM grams) JOIN phrases USING (keyword)
           GROUP BY ALL),
    idf AS (SELECT keyword, count(*) AS df, (SELECT count(*) FROM documents) AS n_docs, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY keyword)"""


def vocabulary(spark, sf):
    """All phrases of one to four words; their ids are their alphabetical positions."""
    return tf.vocabulary(dense_id(phrase_table(spark, sf, longest=4), ["keyword"], "trie_id"))


SQL_VOCABULARY = "vocab AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS phrase_id FROM phrases)"


@query("doc_freq", f"WITH {sql_tfidf()}, {SQL_VOCABULARY} SELECT phrase_id, df, n_docs, round(idf, 6) AS idf FROM idf JOIN vocab USING (keyword)")
def doc_freq(spark, sf):
    docs = documents(spark, sf)
    counts = tf.term_counts(docs, "doc_id", "text", vocabulary(spark, sf))
    return tf.document_frequency(counts, docs).withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_vocab",
    f"""WITH {sql_tfidf()}, {SQL_VOCABULARY}
    SELECT doc_id, phrase_id, tf, round(idf, 6) AS idf, round(tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)), 6) AS tfidf
    FROM tf JOIN idf USING (keyword) JOIN vocab USING (keyword)""",
)
def tfidf_vocab(spark, sf):
    found = tf.tfidf(documents(spark, sf), "doc_id", "text", vocabulary(spark, sf))
    return found.select("doc_id", "phrase_id", "tf", F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))
