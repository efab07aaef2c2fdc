"""Core, extended, merged and negative dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.fixed import (
    MIN_ABSTRACT_WORDS,
    MIN_KEYWORD_CHARS,
    NEGATIVE_MAX_HITS,
    NEGATIVE_MIN_FREQUENCY,
    SCORE_THRESHOLD,
    SOURCE_PRECEDENCE_CORE,
    SOURCE_PRECEDENCE_EXTENDED,
)
from termweave.functions.text import abstract_clean, topic_label, uri_local_name, word_count
from termweave.operators.frequency import by_precedence, keyword_frequency, occurrences, subtract
from termweave.operators.graph import topic_levels
from termweave.operators.keyphrase import extract_keywords, keyword_rows
from termweave.operators.patterns import substring_hits
from termweave.operators.skew import dense_id, keep_first
from termweave.session import durable, release


def topic_triples(raw: DataFrame) -> DataFrame:
    """Readable `(start_id, relationship, end_id)` from URI triples."""
    return raw.select(
        topic_label(uri_local_name("start_id", "topics/")).alias("start_id"),
        uri_local_name("relationship", "cso#").alias("relationship"),
        topic_label(uri_local_name("end_id", "topics/")).alias("end_id"),
    )


def topic_keywords(triples: DataFrame, root: str) -> DataFrame:
    """`(keyword, score, source)` extracted from the labels of all topics below `root`.

    A topic met on two levels counts twice, so its extracted keywords are repeated
    by its number of occurrences instead of being extracted again.
    """
    met = topic_levels(triples, root).groupBy("end_id").agg(F.count(F.lit(1)).alias("times"))
    found = keyword_rows(extract_keywords(met, "end_id", "end_id"), "end_id").join(met, "end_id")
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("keyword", "score", F.lit("cso").alias("source"))


def core_dictionary(
    keywords: DataFrame,
    threshold: float = SCORE_THRESHOLD,
    order: Sequence[str] = SOURCE_PRECEDENCE_CORE,
    min_chars: int = MIN_KEYWORD_CHARS,
    times: str | None = None,
) -> DataFrame:
    """`(keyword, frequency, frequency_normalized, source, trie_id)` from `(keyword, score, source)`.

    A keyword belongs to its strongest source only. Frequencies are counted before
    sources are compared, so precedence works on distinct keywords. The counts are read
    four times, so they are made durable: the keywords are found once. With `times`, a
    row of the keywords stands for so many.
    """
    good = keywords.where(F.col("score").cast("double") <= threshold)
    counts = durable(good.groupBy("source", "keyword").agg(occurrences(times).alias("frequency")))
    owned = by_precedence(counts, order)
    tops = owned.groupBy("source").agg(F.max("frequency").alias("_top"))
    shared = owned.join(tops, "source").select(
        "keyword", "frequency", (F.col("frequency") / F.col("_top")).alias("frequency_normalized"), "source"
    )
    kept = shared.where(F.length("keyword") > min_chars)
    place = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(("task", "method", "cso"))])
    ordered = kept.withColumn("_place", place)
    numbered = dense_id(ordered, ["_place", F.desc("frequency"), "keyword"], "trie_id").drop("_place")
    release(counts)
    return numbered


def extended_candidates(keywords: DataFrame, vectors: DataFrame, threshold: float = SCORE_THRESHOLD, times: str | None = None) -> DataFrame:
    """`(keyword, frequency, frequency_normalized, embedding)` of all paper keywords with a vector; with `times`, a row stands for so many."""
    good = keywords.where(F.col("score").cast("double") <= threshold)
    counts = keyword_frequency(good.select("keyword", *([times] if times else [])), times=times)
    return counts.join(vectors, "keyword")


def extended_dictionary(
    similar: DataFrame, threshold: float, order: Sequence[str] = SOURCE_PRECEDENCE_EXTENDED
) -> DataFrame:
    """`(keyword, source, core_keyword)` above a threshold, each keyword in its strongest source only."""
    above = similar.where(F.col("cos") > threshold).select("keyword", "source", "core_keyword")
    return by_precedence(above, order)


def merged_dictionary(core: DataFrame, extended: DataFrame) -> DataFrame:
    """`(keyword, source, dict, trie_id)`: core keywords and those extended ones that core lacks.

    Core ids come first in core order, extended ones follow by source and keyword.
    """
    new = keep_first(subtract(extended, core).select("keyword", "source"), "keyword", ["source"])
    both = core.select("keyword", "source", F.lit("core").alias("dict"), F.col("trie_id").alias("_at")).unionByName(
        new.select("keyword", "source", F.lit("extended").alias("dict"), F.lit(0).cast("long").alias("_at"))
    )
    return dense_id(both, ["dict", "_at", "source", "keyword"], "trie_id").drop("_at")


def dictionary_counts(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("source", "dict").agg(F.count(F.lit(1)).alias("n_keywords"))


def negative_documents(
    docs: DataFrame, key: str, text: str, core: DataFrame, max_hits: int = NEGATIVE_MAX_HITS
) -> DataFrame:
    """Cleaned documents of more than ten words with fewer than `max_hits` core keyword hits.

    The scan hands the documents on, so they are read and cleaned once and meet no join;
    rows that repeat a key are judged each by its own text.
    """
    cleaned = docs.withColumn(text, abstract_clean(text)).where(word_count(text) > MIN_ABSTRACT_WORDS)
    nested = cleaned.select(key, text, F.struct(*cleaned.columns).alias("_row"))
    return substring_hits(nested, key, text, core, keep=["_row"]).where(F.size("hits") < max_hits).select("_row.*")


def negative_keywords(extracted: DataFrame, lowest: int = NEGATIVE_MIN_FREQUENCY, highest: int = 2**62) -> DataFrame:
    """Keywords whose frequency over the negative documents lies in the range."""
    counts = extracted.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.where(F.col("frequency").between(lowest, highest))


def split_by_negative(dictionary: DataFrame, negative: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionary without the negative keywords, and the removed rows. The negative keywords are found once, not once for each side."""
    negative = durable(negative.select("keyword").distinct())
    removed = dictionary.join(negative, "keyword", "left_semi")
    return subtract(dictionary, negative), removed
