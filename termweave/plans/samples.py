"""Positive and negative samples, corpus scoring and comparison, full-text nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.fixed import MIN_ABSTRACT_WORDS, MIN_SAMPLE_CHARS, PLOT_MAX_MEAN, PLOT_MIN_TOTAL, SCORE_THRESHOLD
from termweave.functions.ids import NAMESPACES, hashed_id
from termweave.functions.text import abstract_clean, fulltext_clean, keywords_up_to_score, name_and_description, paper_id_of_file, word_count
from termweave.operators.compare import sample_statistics
from termweave.operators.dictionary import PhraseDictionary
from termweave.operators.frequency import subtract
from termweave.operators.graph import match_pattern, to_edges, to_nodes
from termweave.operators.keyphrase import extract_keywords
from termweave.operators.language import keep_language
from termweave.operators.lemma import clean_sample
from termweave.operators.skew import keep_first, keyed_values, smallest_n

METRICS = ("n_hits", "ratio", "mean_weight", "total_weight")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly `n` rows in the order of a seeded hash of the key; the same rows on every run."""
    return smallest_n(df, F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key, n)


def bernoulli_sample(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """Each row with the given chance, decided by a seeded hash of its key."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.where(digits.cast("long") < F.lit(percent * 2**32 // 100))


def ai_work_ids(works_concepts: DataFrame, concepts: DataFrame, names: tuple[str, str, str], min_score: float = 0.2, strict: bool = False) -> DataFrame:
    """Works tagged with one of three concepts.

    The score bound belongs to the last name only, as AND binds tighter than OR;
    `strict` applies it to all names.
    """
    first, second, third = (F.col("display_name") == name for name in names)
    scored = F.col("score") > min_score
    wanted = (first | second | third) & scored if strict else first | second | (third & scored)
    joined = works_concepts.join(concepts.withColumnRenamed("id", "concept_id"), "concept_id")
    return joined.where(wanted).select("work_id")


def positive_sample(papers: DataFrame, *described: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """`(id, text)`: abstracts and name-plus-description texts of more than twenty characters, cleaned."""
    texts = [papers.select("id", F.col("abstract").alias("text"))]
    texts += [d.select("id", name_and_description("name", "description").alias("text")) for d in described]
    long_enough = reduce(DataFrame.unionByName, texts).where(F.length("text") > MIN_SAMPLE_CHARS)
    return clean_sample(long_enough, "id", "text", lemmas)


def negative_sample(
    works: DataFrame, known: DataFrame, ai_works: DataFrame, language: str = "en", lemmas: DataFrame | None = None
) -> DataFrame:
    """`(id, text)`: works in neither exclusion set, cleaned, long enough and in the language."""
    outside = subtract(subtract(works, known, "id"), ai_works, "id")
    cleaned = outside.withColumn("text", abstract_clean("text")).where(word_count("text") > MIN_ABSTRACT_WORDS)
    kept = keep_language(cleaned, language, "lang", "text")
    return clean_sample(kept.select("id", "text"), "id", "text", lemmas)


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def positive_keyword_lists(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """`(n_id, keyword)`: good keywords of each node, one row each."""
    good = F.col("score").cast("double") <= threshold
    found = match_pattern(nodes, edges, keywords, "HAS_KEYWORD", good)
    return keyed_values(found, "n_id", keyword=F.col("t_keyword"))


def negative_keyword_lists(docs: DataFrame, key: str, text: str, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """`(key, keywords)`: names of the extracted keywords up to the threshold."""
    extracted = extract_keywords(docs, key, text)
    return extracted.select(key, keywords_up_to_score("keywords", threshold).alias("keywords"))


def score_corpus(docs: DataFrame, key: str, text: str, dictionary: PhraseDictionary, **limits: int) -> DataFrame:
    return dictionary.word_metrics(docs, key, text, **limits)


def plot_range(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("total_weight") > PLOT_MIN_TOTAL) & (F.col("mean_weight") < PLOT_MAX_MEAN))


def compare_samples(scored: DataFrame, samples: DataFrame, key: str, sample: str) -> DataFrame:
    """Mean and deviation of the four metrics per sample, inside the plotted range."""
    return sample_statistics(plot_range(scored).join(samples, key), sample, METRICS)


def fulltext_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """`(file, text, paper_id, arxiv_id)`: files that belong to a paper, one per paper."""
    named = files.withColumn("arxiv_id", paper_id_of_file("file"))
    known = papers.select(F.col("id").alias("paper_id"), "arxiv_id")
    return keep_first(named.join(known, "arxiv_id"), "paper_id", ["file"])


def fulltext_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fulltext nodes and HAS_FULLTEXT edges; nodes whose text fails the gate keep a null text."""
    hashed = files.withColumn("id", hashed_id("arxiv_id", NAMESPACES["fulltext"]))
    nodes = to_nodes(hashed.select("id", fulltext_clean("text").alias("text")), "id", "Fulltext")
    edges = to_edges(hashed.select("paper_id", "id"), "paper_id", "id", "HAS_FULLTEXT")
    return nodes, edges
