"""TF-IDF over a fixed phrase vocabulary as DataFrame arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.text import tfidf_words
from termweave.operators import scan
from termweave.operators.dictionary import PhraseDictionary
from termweave.operators.skew import salted_join
from termweave.session import durable


def vocabulary(df: DataFrame, phrase: str = "keyword", value: str = "trie_id", longest: int = 4) -> PhraseDictionary:
    """Phrases of one to `longest` words; entries are compared as they are written."""
    words = F.split(F.col(phrase), " ")
    return PhraseDictionary.build(df.where(F.size(words) <= longest), phrase, value, normalise=False)


def term_counts(
    docs: DataFrame, key: str, text: str, vocab: PhraseDictionary, stop_words: list[str] | None = None, **limits: int
) -> DataFrame:
    """`(key, phrase_id, tf)`: how often each vocabulary phrase occurs, overlaps included. A row's phrases are counted where it is read."""
    words = docs.select(key, tfidf_words(text, stop_words).alias("words"))
    found = scan.phrase_hits(words, key, vocab, overlapping=True, **limits)
    counted = found.select(F.col(key).alias("_key"), F.col("hits.value").alias("_ids")).mapInArrow(_counted, f"_key {docs.schema[key].dataType.simpleString()}, phrase_id long, tf long")
    return counted.groupBy(F.col("_key").alias(key), "phrase_id").agg(F.sum("tf").alias("tf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row and phrase."""
    for batch in batches:
        ids = batch.column("_ids")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
        counts = pa.table({"row": row, "id": ids.flatten()}).group_by(["row", "id"]).aggregate([([], "count_all")])
        counts = counts.combine_chunks()
        columns = [batch.column("_key").take(counts["row"].combine_chunks()), counts["id"].combine_chunks(), counts["count_all"].combine_chunks()]
        yield pa.RecordBatch.from_arrays(columns, names=["_key", "phrase_id", "tf"])


def document_frequency(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """`(phrase_id, df, n_docs, idf)` with smooth idf: ln((1 + n) / (1 + df)) + 1."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    frequency = counts.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("df")).withColumn("n_docs", n)
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    return frequency.withColumn("idf", idf)


def tfidf(
    docs: DataFrame, key: str, text: str, vocab: PhraseDictionary, stop_words: list[str] | None = None, **limits: int
) -> DataFrame:
    """`(key, phrase_id, tf, idf, tfidf)`, each document scaled to length one."""
    counts = durable(term_counts(docs, key, text, vocab, stop_words, **limits))  # the texts are scanned once
    idf = document_frequency(counts, docs).select("phrase_id", "idf")
    return scaled(by_phrase(counts, idf, vocab, **limits), key)


def by_phrase(counts: DataFrame, phrases: DataFrame, vocab: PhraseDictionary, how: str = "inner", **limits: int) -> DataFrame:
    """`counts` with the columns that `phrases` has for each phrase of the vocabulary."""
    if vocab.size().fits(limits.get("max_prefixes", scan.MAX_PREFIXES)):
        # One row per vocabulary phrase, whose number was just checked.
        return counts.join(F.broadcast(phrases), "phrase_id", how)
    return salted_join(counts, phrases, "phrase_id", how)


def scaled(counts: DataFrame, key: str) -> DataFrame:
    """`(key, phrase_id, tf, idf, tfidf)` of counts with their idf, each document scaled to length one."""
    weighted = counts.withColumn("_w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    return weighted.select(key, "phrase_id", "tf", "idf", (F.col("_w") / length).alias("tfidf"))
