"""Lemmatisation by a look-up table and the sample clean built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import split_words, without_stop_words
from termweave.operators.skew import salted_join


def lemmatise(df: DataFrame, words: str, lemmas: DataFrame, **split: int) -> DataFrame:
    """Replace each word of the list column `words` that `lemmas(word, lemma)` knows.

    Only distinct words per list meet the table, frequent words in pieces; the
    order is restored inside the row from a map of the changed words. Rows are told
    by their words, so equal lists meet the table once and no key is needed. A word
    that stands in the table more than once gets its smallest lemma.
    """
    lemmas = lemmas.where(F.col("word").isNotNull() & F.col("lemma").isNotNull()).groupBy("word").agg(F.min("lemma").alias("lemma"))
    lemmas = lemmas.where(F.col("word") != F.col("lemma"))
    told = df.withColumn("_list", F.md5(F.array_join(words, "\u0001")))
    distinct = told.select("_list", F.explode(F.array_distinct(words)).alias("word"))
    changed = salted_join(distinct, lemmas, "word", **split)
    maps = changed.groupBy("_list").agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("_lemmas"))
    looked_up = F.transform(words, lambda w: F.coalesce(F.element_at("_lemmas", w), w))
    joined = told.join(maps, "_list", "left").drop("_list")
    return joined.withColumn(words, F.when(F.col("_lemmas").isNull(), F.col(words)).otherwise(looked_up)).drop("_lemmas")


def clean_sample(
    df: DataFrame, key: str, text: str, lemmas: DataFrame | None = None, stop_words: list[str] | None = None
) -> DataFrame:
    """Sample text: lemmas where a table is given, no stop words, lower case."""
    worded = df.withColumn("_words", split_words(text))
    if lemmas is not None:
        worded = lemmatise(worded, "_words", lemmas)
    cleaned = F.lower(F.array_join(without_stop_words("_words", stop_words), " "))
    return worded.withColumn(text, cleaned).drop("_words")
