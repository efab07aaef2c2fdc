"""Enrichment of papers from a relational bibliography.

Joins on the papers carry no broadcast hint: adaptive execution broadcasts a side
only after measuring it and splits skewed partitions. Fact tables are cut down to
the papers' keys by semi joins before anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.ids import NAMESPACES, hashed_id
from termweave.functions.text import last_path_part
from termweave.operators.graph import to_edges, to_nodes
from termweave.operators.skew import keyed_values, salted_join

def external_ids(papers: DataFrame, locations: DataFrame, site: str = "arxiv") -> DataFrame:
    """Adds `openalex_id` by the last part of the landing page; null where unknown."""
    known = locations.where(F.contains("landing_page_url", F.lit(site))).select(
        last_path_part("landing_page_url").alias("arxiv_id"), F.col("work_id").alias("openalex_id")
    )
    return papers.join(known, "arxiv_id", "left")


def of_keys(facts: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a fact table whose `column` is among the non-null keys, each once."""
    wanted = keys.select(F.col(key).alias(column)).dropna().distinct()
    return facts.join(wanted, column, "left_semi")


def with_works(papers: DataFrame, works: DataFrame, dropped: tuple[str, ...] = (), suffix: str = "_openalex") -> DataFrame:
    """Work columns on the papers; clashing names get the suffix.

    Papers without a work meet nothing; dealt by their own id, they do not lie in one task.
    """
    matching = of_keys(works, "id", papers, "openalex_id").drop(*dropped)
    renamed = matching.select([F.col(c).alias(c + suffix if c in papers.columns else c) for c in matching.columns])
    spread = papers.withColumn("_dealt", F.xxhash64(F.coalesce("openalex_id", "id")))
    met = renamed.withColumn("_met", F.xxhash64("id" + suffix))
    equal = (spread["openalex_id"] == met["id" + suffix]) & (spread["_dealt"] == met["_met"])
    return spread.join(met, equal, "left").drop("_dealt", "_met")


def translate(edges: DataFrame, column: str, papers: DataFrame, name: str, external: str = "openalex_id") -> DataFrame:
    """Replace an external work id by the paper id; edges without a paper drop out."""
    ids = papers.select(F.col(external).alias(column), F.col("id").alias(name)).dropna()
    return salted_join(edges, ids, column).drop(column)


def authorship_edges(papers: DataFrame, authorships: DataFrame) -> DataFrame:
    rows = of_keys(authorships, "work_id", papers, "openalex_id").select(
        "work_id", "author_id", "author_position", "institution_id"
    )
    translated = translate(rows, "work_id", papers, "paper_id")
    named = translated.withColumn("author_id", hashed_id("author_id", NAMESPACES["author"]))
    return to_edges(named, "author_id", "paper_id", "AUTHORS")


def authorship_records(papers: DataFrame, authorships: DataFrame) -> DataFrame:
    """`(work_id, author_id, author_position, institution_id)`: the records of each work, one row each."""
    return of_keys(authorships, "work_id", papers, "openalex_id").drop("raw_affiliation_string")


def author_nodes(papers: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """Each known author once, with hashed id; used for nodes and affiliations."""
    written = of_keys(authorships, "work_id", papers, "openalex_id")
    kept = of_keys(authors, "id", written, "author_id").drop("display_name_alternatives")
    return kept.withColumn("id_md5", hashed_id("id", NAMESPACES["author"]))


def author_export(authors: DataFrame) -> DataFrame:
    return to_nodes(authors.withColumnRenamed("id", "openalex_id"), "id_md5", "Author")


def institution_export(authors: DataFrame, institutions: DataFrame) -> DataFrame:
    kept = of_keys(institutions, "id", authors, "last_known_institution")
    hashed = kept.withColumn("id_md5", hashed_id("id", NAMESPACES["institution"]))
    return to_nodes(hashed.withColumnRenamed("id", "openalex_id"), "id_md5", "Institution")


def affiliation_edges(authors: DataFrame) -> DataFrame:
    named = authors.select(
        "id_md5", hashed_id("last_known_institution", NAMESPACES["institution"]).alias("institution")
    ).dropna()
    return to_edges(named, "id_md5", "institution", "AFFILIATED_WITH")


def citations(papers: DataFrame, references: DataFrame) -> DataFrame:
    """References that start at one of the papers: `(work_id, referenced_work_id)`."""
    return of_keys(references, "work_id", papers, "openalex_id").select("work_id", "referenced_work_id")


def citation_edges(papers: DataFrame, references: DataFrame) -> DataFrame:
    """Citations with both ends among the papers, as paper ids."""
    inside = of_keys(citations(papers, references), "referenced_work_id", papers, "openalex_id")
    started = translate(inside, "work_id", papers, "citing")
    ended = translate(started, "referenced_work_id", papers, "cited")
    return to_edges(ended, "citing", "cited", "CITES")


def citation_records(papers: DataFrame, references: DataFrame) -> DataFrame:
    """`(work_id, citation)`: the citations of each work, one row each."""
    return keyed_values(citations(papers, references), "work_id", citation=F.col("referenced_work_id"))
