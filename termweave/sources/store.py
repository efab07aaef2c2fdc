"""Stored prefix tables: one table for all dictionaries, cut by dictionary and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.dictionary import phrase_entries
from termweave.operators.prefixes import prefix_rows
from termweave.sources.writers import write_parquet


def prefix_store(dictionary: DataFrame, weight: str | None = None) -> DataFrame:
    """Prefix rows per dictionary and source in one pass over `dictionary(keyword, source, dict, trie_id[, weight])`.

    A part made of several sources or of both dictionaries is the union of its
    partitions (see `load_part`).
    """
    parts = ["dict", "source"]
    return prefix_rows(phrase_entries(dictionary, "keyword", "trie_id", weight, by=parts), by=parts)


def save_store(dictionary: DataFrame, path: str, weight: str | None = None) -> None:
    write_parquet(prefix_store(dictionary, weight), path, "dict", "source")


def load_part(spark: SparkSession, path: str, dict_name: str | None = None, source: str | None = None) -> DataFrame:
    """Prefix table of one part; the filters prune partitions.

    A prefix that several partitions share becomes one row; a phrase in two
    partitions keeps value and weight of its later insertion. The result is what
    `PhraseDictionary.from_prefixes` takes.
    """
    stored = spark.read.parquet(path)
    if dict_name:
        stored = stored.where(F.col("dict") == dict_name)
    if source:
        stored = stored.where(F.col("source") == source)
    return stored.groupBy("prefix", "depth").agg(
        F.max("is_terminal").alias("is_terminal"),
        F.max_by("value", "last_ord").alias("value"),
        F.max_by("weight", "last_ord").alias("weight"),
        F.min("first_ord").alias("first_ord"),
        F.min("ord").alias("ord"),
        F.max("last_ord").alias("last_ord"),
    )
