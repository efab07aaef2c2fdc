"""Ids, text clean-up and row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.registry import SQL_STOP_WORDS, documents, query, sql_id, sql_list, sql_words, table
from termweave.functions import fixed, text
from termweave.functions.ids import hashed_id, slug
from termweave.operators.language import identify_language, keep_language
from termweave.operators.lemma import clean_sample, lemmatise

# SQL forms of the text functions.
SQL_SPLIT = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
SQL_FOLD = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')"
SQL_PLAIN = r"regexp_replace(lower(text), '[0-9!-/:-@\[-`{-~]+', '', 'g')"
SQL_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQL_EXTRACTION = (
    "regexp_replace(regexp_replace("
    + SQL_STRIP.format(SQL_FOLD.format("text"))
    + ", 'https?:\\/\\/\\S+', '', 'g'), '[^a-zA-Z0-9\\- .,!?]', '', 'g')"
)
SQL_KEYWORD = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '\[.*?\]|\(.*?\)|\{{.*?\}}', '', 'g'), '[^a-zA-Z\- ]', '', 'g')), '^\s+|\s+$', '', 'g')"
SQL_ABSTRACT = (
    "lower(regexp_replace(trim(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9 ]', ' ', 'g'), 'abstract', '', 'gi')), '\\s+', ' ', 'g'))"
)


@query(
    "node_ids",
    f"""SELECT 'method' AS kind, p_name || ' ' || p_partkey AS key, {sql_id("'method/' || replace(lower(p_name || ' ' || p_partkey), ' ', '-')")} AS id FROM part
    UNION ALL SELECT 'paper', url, {sql_id('url')} FROM pages
    UNION ALL SELECT 'author', c_name, {sql_id("'author/' || c_name")} FROM customer""",
)
def node_ids(spark, sf):
    name = F.concat_ws(" ", "p_name", "p_partkey")
    methods = table(spark, sf, "part").select(F.lit("method").alias("kind"), name.alias("key"), hashed_id(slug(name), "method/").alias("id"))
    papers = table(spark, sf, "pages").select(F.lit("paper").alias("kind"), F.col("url").alias("key"), hashed_id("url").alias("id"))
    authors = table(spark, sf, "customer").select(F.lit("author").alias("kind"), F.col("c_name").alias("key"), hashed_id("c_name", "author/").alias("id"))
    return methods.unionByName(papers).unionByName(authors)


@query("slugify", "SELECT p_partkey, replace(lower(p_name || ' ' || p_brand), ' ', '-') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(
    "markup_clean",
    r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^<]+?>|\*|\n|\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM pages",
)
def markup_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.markup_clean("html").alias("plain"))


@query("url_tail", "SELECT page_id, regexp_extract(url, '[^/]*$') AS tail FROM pages")
def url_tail(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.last_path_part("url").alias("tail"))


@query(
    "file_paper_id",
    "SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$') || 'v' || (page_id % 3) || '.pdf', '.pdf', '', 'g'), 'v.*', '', 'g') AS paper_id FROM pages",
)
def file_paper_id(spark, sf):
    name = F.concat(text.last_path_part("url"), F.lit("v"), (F.col("page_id") % 3).cast("string"), F.lit(".pdf"))
    return table(spark, sf, "pages").select("page_id", text.paper_id_of_file(name).alias("paper_id"))


@query(
    "uri_local_name",
    "SELECT c_custkey, lower(c_mktsegment) || ' (' || c_custkey || ')' AS topic, 'superTopicOf' AS relationship FROM customer",
)
def uri_local_name(spark, sf):
    uri = F.concat(F.lit("<https://topics.example/topics/"), F.lower("c_mktsegment"), F.lit("_%28"), F.col("c_custkey"), F.lit("%29>"))
    relation = F.lit("<http://topics.example/schema/cso#superTopicOf>")
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.topic_label(text.uri_local_name(uri, "topics/")).alias("topic"),
        text.uri_local_name(relation, "cso#").alias("relationship"),
    )


@query("abstract_clean", f"SELECT doc_id, {SQL_ABSTRACT.format('text')} AS abstract FROM documents")
def abstract_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.abstract_clean("text").alias("abstract"))


@query("ascii_fold", f"SELECT doc_id, {SQL_FOLD.format('text')} AS folded FROM documents")
def ascii_fold(spark, sf):
    return documents(spark, sf).select("doc_id", text.ascii_fold("text").alias("folded"))


@query("ascii_fold_full", f"SELECT doc_id, {SQL_FOLD.format('text')} AS folded FROM documents")
def ascii_fold_full(spark, sf):
    """Ligatures and signs that fold to several letters, put in the place of those letters, give them back."""
    return documents(spark, sf).select("doc_id", text.ascii_fold(F.replace(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit("No"), F.lit("\u2116"))).alias("folded"))


@query("extraction_clean", f"SELECT doc_id, {SQL_EXTRACTION} AS plain FROM documents")
def extraction_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.extraction_clean("text").alias("plain"))


@query(
    "keyword_clean",
    f"SELECT page_id, {SQL_KEYWORD.format('html')} AS keyword FROM pages",
)
def keyword_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.keyword_clean("html").alias("keyword"))


@query("dictionary_words", f"SELECT doc_id, {sql_words('text')} AS words FROM documents")
def dictionary_words(spark, sf):
    return documents(spark, sf).select("doc_id", text.dictionary_words("text").alias("words"))


@query(
    "text_lengths",
    f"SELECT doc_id, len({SQL_SPLIT.format('text')})::BIGINT AS n_words, length(text)::BIGINT AS n_letters, length(text) > 20 AND len({SQL_SPLIT.format('text')}) > 10 AS long_enough FROM documents",
)
def text_lengths(spark, sf):
    words, letters = text.word_count("text"), F.length("text")
    return documents(spark, sf).select(
        "doc_id",
        words.cast("long").alias("n_words"),
        letters.cast("long").alias("n_letters"),
        ((letters > fixed.MIN_SAMPLE_CHARS) & (words > fixed.MIN_ABSTRACT_WORDS)).alias("long_enough"),
    )


@query("name_desc_concat", "SELECT p_partkey, p_name || ' ' || nullif(p_type, 'ECONOMY') AS text FROM part")
def name_desc_concat(spark, sf):
    description = F.nullif(F.col("p_type"), F.lit("ECONOMY"))
    return table(spark, sf, "part").select("p_partkey", text.name_and_description("p_name", description).alias("text"))


@query(
    "word_window",
    f"SELECT doc_id, list_filter({sql_words('text')}, lambda x: length(x) BETWEEN 3 AND 29) AS words FROM documents",
)
def word_window(spark, sf):
    return documents(spark, sf).select("doc_id", text.words_in_window(text.dictionary_words("text")).alias("words"))


SQL_MARKED = r"regexp_replace(regexp_replace(lower(text), '\bthe\b', 'introduction', 'g'), '\bof\b', 'abstract', 'g')"


@query(
    "body_cut",
    f"""SELECT doc_id, CASE WHEN greatest(instr(t, 'abstract'), instr(t, 'introduction')) > 1
        THEN substr(t, greatest(instr(t, 'abstract'), instr(t, 'introduction')) + 12) ELSE t END AS body
        FROM (SELECT doc_id, {SQL_MARKED} AS t FROM documents)""",
)
def body_cut(spark, sf):
    # The texts hold no section names, so two frequent words stand in for them.
    marked = F.regexp_replace(F.regexp_replace(F.lower("text"), r"(?U)\bthe\b", "introduction"), r"(?U)\bof\b", "abstract")
    return documents(spark, sf).select("doc_id", text.body_cut(marked).alias("body"))


# CTE `body(doc_id, t)`: the full-text chain up to its gate.
SQL_FULLTEXT = f"""letters AS (SELECT doc_id, {SQL_SPLIT.format(SQL_PLAIN)} AS w FROM documents),
    whole AS (SELECT doc_id, array_to_string(list_filter(w, lambda x: x NOT IN ({SQL_STOP_WORDS}) AND length(x) BETWEEN 3 AND 29), ' ') AS t FROM letters),
    kept AS (SELECT doc_id, trim(regexp_replace(t, '[^a-z\\s]+', ' ', 'g')) AS t FROM whole),
    body AS (SELECT doc_id, CASE WHEN greatest(instr(t, 'abstract'), instr(t, 'introduction')) > 1
             THEN substr(t, greatest(instr(t, 'abstract'), instr(t, 'introduction')) + 12) ELSE t END AS t FROM kept)"""
SQL_GATE = f"len({SQL_SPLIT.format('t')}) > 100 AND len(list_filter(string_split(t, ' '), lambda x: length(x) > 30)) = 0"


@query(
    "fulltext_gate",
    f"""WITH {SQL_FULLTEXT}
    SELECT doc_id, trim(t) AS text FROM body
    WHERE {SQL_GATE}""",
)
def fulltext_gate(spark, sf):
    cleaned = documents(spark, sf).select("doc_id", text.fulltext_clean("text").alias("text"))
    return cleaned.where(F.col("text").isNotNull())


@query(
    "stopword_removal",
    f"SELECT doc_id, list_filter({sql_words('text')}, lambda x: x NOT IN ({SQL_STOP_WORDS})) AS words FROM documents",
)
def stopword_removal(spark, sf):
    return documents(spark, sf).select("doc_id", text.without_stop_words(text.dictionary_words("text")).alias("words"))


def plural_lemmas(spark, sf):
    """Lemma table: benchmark words that end in s, without it."""
    words = table(spark, sf, "benchmark").select(F.explode(text.dictionary_words("text")).alias("word")).distinct()
    return words.where(F.endswith("word", F.lit("s"))).select("word", F.expr("substr(word, 1, length(word) - 1)").alias("lemma"))


SQL_LEMMAS = f"""lemmas AS (SELECT DISTINCT word, substr(word, 1, length(word) - 1) AS lemma
    FROM (SELECT unnest({sql_words('text')}) AS word FROM benchmark) WHERE word LIKE '%s')"""


@query(
    "lemma_map",
    f"""WITH {SQL_LEMMAS},
    tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)),
    mapped AS (SELECT doc_id, list(coalesce(lemma, tok.word) ORDER BY pos) AS words FROM tok LEFT JOIN lemmas ON lemmas.word = tok.word GROUP BY doc_id)
    SELECT doc_id, coalesce(words, []) AS words FROM documents LEFT JOIN mapped USING (doc_id)""",
)
def lemma_map(spark, sf):
    words = documents(spark, sf).select("doc_id", text.dictionary_words("text").alias("words"))
    return lemmatise(words, "words", plural_lemmas(spark, sf))


@query(
    "sample_clean",
    f"""WITH {SQL_LEMMAS},
    tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {SQL_SPLIT.format('text')} AS w FROM documents)),
    mapped AS (SELECT doc_id, pos, coalesce(lemma, tok.word) AS word FROM tok LEFT JOIN lemmas ON lemmas.word = tok.word),
    kept AS (SELECT doc_id, lower(string_agg(word, ' ' ORDER BY pos)) AS text FROM mapped WHERE word NOT IN ({SQL_STOP_WORDS}) GROUP BY doc_id)
    SELECT doc_id, coalesce(kept.text, '') AS text FROM documents LEFT JOIN kept USING (doc_id)""",
)
def sample_clean(spark, sf):
    return clean_sample(documents(spark, sf).select("doc_id", "text"), "doc_id", "text", plural_lemmas(spark, sf))


@query(
    "chunk_filter",
    rf"""SELECT conv_id, turn, list_sort(list_filter(list_distinct({sql_words('text')}),
        lambda k: len(list_filter(list_filter(string_split_regex(text, '[.!?]'), lambda c: length(c) > 80), lambda c: contains(lower(c), k))) > 0)) AS keywords
    FROM conversations""",
)
def chunk_filter(spark, sf):
    # Long sentences stand in for noun chunks.
    chunks = F.filter(F.split("text", "[.!?]"), lambda c: F.length(c) > 80)
    keywords = F.array_distinct(text.dictionary_words("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_sort(text.keywords_in_chunks(keywords, chunks)).alias("keywords")
    )


@query(
    "array_score_filter",
    f"""SELECT doc_id, list_filter({sql_words('text')}, lambda x: length(x) > 3 AND 1.0 / length(x) <= 0.1) AS keywords FROM documents""",
)
def array_score_filter(spark, sf):
    scored = F.transform(
        text.dictionary_words("text"), lambda w: F.struct(w.alias("keyword"), (F.lit(1.0) / F.length(w)).alias("score"))
    )
    lists = documents(spark, sf).select("doc_id", text.long_keywords(scored).alias("scored"))
    return lists.select("doc_id", text.keywords_up_to_score("scored", fixed.SCORE_THRESHOLD).alias("keywords"))


@query("null_to_empty", "SELECT doc_id, coalesce(nullif(lang, 'en'), '') AS lang FROM documents")
def null_to_empty(spark, sf):
    return documents(spark, sf).select("doc_id", text.null_to_empty(F.nullif(F.col("lang"), F.lit("en"))).alias("lang"))


@query("keyword_string", f"SELECT doc_id, substr(array_to_string({sql_words('text')}, ', '), 1, 2000) AS label FROM documents")
def keyword_string(spark, sf):
    return documents(spark, sf).select("doc_id", text.keyword_string(text.dictionary_words("text"), 2000).alias("label"))


@query("list_guard", "SELECT event_id, user_id AS item FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, event_id FROM events WHERE event_type <> 'error'")
def list_guard(spark, sf):
    items = F.when(F.col("event_type") != "error", F.array("user_id", "event_id"))
    listed = table(spark, sf, "events").select("event_id", items.alias("items"))
    return listed.where(F.col("items").isNotNull()).select("event_id", F.explode("items").alias("item"))


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def lang_filter(spark, sf):
    return keep_language(documents(spark, sf), "en").select("doc_id", "lang")


def _sql_language() -> str:
    counts = [
        f"{{'n': -len(list_filter(w, lambda x: x IN ({sql_list(words)}))), 'language': '{language}'}}"
        for language, words in sorted(fixed.LANGUAGE_WORDS.items())
    ]
    return f"""WITH words AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ') AS w FROM documents),
    best AS (SELECT doc_id, list_sort([{', '.join(counts)}])[1] AS b FROM words)
    SELECT doc_id, CASE WHEN b.n = 0 THEN 'und' ELSE b.language END AS detected FROM best"""


@query("language_id", _sql_language())
def language_id(spark, sf):
    return identify_language(documents(spark, sf), "text").select("doc_id", "detected")
