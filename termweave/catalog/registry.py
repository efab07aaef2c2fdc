"""Registration of queries and the inputs and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.fixed import ENGLISH_STOP_WORDS
from termweave.functions.text import dictionary_words
from termweave.operators.dictionary import PhraseDictionary
from termweave.sources.readers import balanced_scan, read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spread over the cores where the file has fewer splits than that."""
    return balanced_scan(table(spark, sf_dir, "documents"), "doc_id")


def ngrams(words: str, longest: int):
    """All runs of one to `longest` words of a list column, as text."""
    positions = F.sequence(F.lit(1), F.lit(longest))
    runs = F.transform(
        positions,
        lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words)),
            lambda i: F.array_join(F.slice(words, i, n), " "),
        ),
    )
    return F.flatten(runs)


def phrase_table(spark: SparkSession, sf_dir: str, longest: int = 3) -> DataFrame:
    """`(keyword, frequency, weight, value)`: phrases of the benchmark texts.

    Single words need more than three letters. The weight is the share of the most
    frequent phrase, the value the first benchmark item that holds the phrase.
    """
    words = table(spark, sf_dir, "benchmark").select("item_id", dictionary_words("text").alias("words"))
    runs = words.select("item_id", F.explode(ngrams("words", longest)).alias("keyword"))
    kept = runs.where((F.instr("keyword", " ") > 0) | (F.length("keyword") > 3))
    counts = kept.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"), F.min("item_id").alias("value"))
    top = counts.agg(F.max("frequency")).scalar()
    return counts.withColumn("weight", F.col("frequency") / top)


def phrase_dictionary(spark: SparkSession, sf_dir: str, longest: int = 3) -> PhraseDictionary:
    return PhraseDictionary.build(phrase_table(spark, sf_dir, longest), "keyword", "value", "weight")


def sql_words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')"


def sql_id(text: str) -> str:
    return f"('0x' || md5({text}))::UHUGEINT::VARCHAR"


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SQL_STOP_WORDS = sql_list(ENGLISH_STOP_WORDS)


def sql_phrases(longest: int = 3) -> str:
    """CTEs `phrases(keyword, n, frequency, value, weight)`."""
    return f"""
    bench_words AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark),
    bench_runs AS (
        SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS keyword
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM bench_words, (SELECT unnest(range(1, {longest + 1})) AS n))
    ),
    bench_counts AS (
        SELECT keyword, n, count(*) AS frequency, min(item_id) AS value
        FROM bench_runs WHERE n > 1 OR length(keyword) > 3 GROUP BY keyword, n
    ),
    phrases AS (
        SELECT *, frequency / (SELECT max(frequency) FROM bench_counts) AS weight FROM bench_counts
    )"""


def sql_prefixes(longest: int = 3) -> str:
    """CTE `prefixes(prefix, depth, is_terminal, value, weight)` after `sql_phrases`."""
    return """
    prefixes AS (
        SELECT array_to_string(string_split(keyword, ' ')[1:k], ' ') AS prefix, k AS depth,
               max(k = n) AS is_terminal, max(CASE WHEN k = n THEN value END) AS value,
               max(CASE WHEN k = n THEN weight END) AS weight
        FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM phrases)
        GROUP BY prefix, depth
    )"""


def sql_greedy(source: str, key: str) -> str:
    """CTE `hits(key, pos, n, phrase, value, weight)` of the greedy scan of `source(key, w)`; phrases of up to 3 words.

    Only prefixes of two and more words cover other positions. They form islands that
    no earlier one reaches into; inside an island the next visited one is among the
    next three.
    """
    return f"""
    tok AS (SELECT {key} AS k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM {source}),
    grams AS (
        SELECT k, pos, word AS g1,
               word || ' ' || lead(word, 1) OVER o AS g2,
               word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g3
        FROM tok WINDOW o AS (PARTITION BY k ORDER BY pos)
    ),
    longest AS (
        SELECT k, pos, CASE WHEN p3.prefix IS NOT NULL THEN 3 WHEN p2.prefix IS NOT NULL THEN 2 ELSE 1 END AS len,
               coalesce(p3.prefix, p2.prefix, p1.prefix) AS phrase
        FROM grams JOIN prefixes p1 ON g1 = p1.prefix
        LEFT JOIN prefixes p2 ON g2 = p2.prefix LEFT JOIN prefixes p3 ON g3 = p3.prefix
    ),
    jumps AS (
        SELECT *, coalesce(pos >= max(pos + len) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens,
               CASE WHEN lead(pos, 1) OVER o >= pos + len THEN lead(pos, 1) OVER o
                    WHEN lead(pos, 2) OVER o >= pos + len THEN lead(pos, 2) OVER o
                    ELSE lead(pos, 3) OVER o END AS next_pos
        FROM longest WHERE len > 1 WINDOW o AS (PARTITION BY k ORDER BY pos)
    ),
    visited(k, pos, len, next_pos) AS (
        SELECT k, pos, len, next_pos FROM jumps WHERE opens
        UNION ALL
        SELECT j.k, j.pos, j.len, j.next_pos FROM visited v JOIN jumps j ON j.k = v.k AND j.pos = v.next_pos WHERE NOT j.opens
    ),
    covered AS (SELECT k, unnest(range(pos + 1, pos + len)) AS pos FROM visited),
    hits AS (
        SELECT l.k AS {key}, l.pos, l.len AS n, l.phrase, p.value, p.weight
        FROM longest l JOIN prefixes p ON p.prefix = l.phrase AND p.is_terminal
        ANTI JOIN covered c ON c.k = l.k AND c.pos = l.pos
    )"""

# The core dictionary from `doc_keywords(keyword, score, source)`.
SQL_CORE_RULES = """
    core_counts AS (SELECT source, keyword, count(*) AS frequency FROM doc_keywords WHERE score <= 0.1 GROUP BY ALL),
    core_owned AS (SELECT * FROM core_counts QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY list_position(['cso', 'task', 'method'], source)) = 1),
    core AS (
        SELECT keyword, frequency, frequency / top AS frequency_normalized, source,
               row_number() OVER (ORDER BY list_position(['task', 'method', 'cso'], source), frequency DESC, keyword) - 1 AS trie_id
        FROM (SELECT *, max(frequency) OVER (PARTITION BY source) AS top FROM core_owned) WHERE length(keyword) > 3)"""
