"""Keyword nodes and HAS_KEYWORD edges from scored keyword columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.ids import NAMESPACES, hashed_id
from termweave.operators.graph import to_edges


def keyword_list(df: DataFrame, id_column: str, keywords: str, source: str) -> DataFrame:
    """`(node_id, keyword, score, source)` of one scored keyword column."""
    return df.select(F.col(id_column).alias("node_id"), F.inline(keywords)).select(
        "node_id", "keyword", "score", F.lit(source).alias("source")
    )


def all_keywords(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def keyword_nodes(keywords: DataFrame) -> DataFrame:
    """Distinct keywords with their hashed id."""
    distinct = keywords.where(F.col("keyword") != "").select("keyword").distinct()
    return distinct.select(hashed_id("keyword", NAMESPACES["keyword"]).alias("id"), "keyword")


def keyword_edges(keywords: DataFrame) -> DataFrame:
    """One edge per keyword row; the id is a hash, so no join with the nodes is needed."""
    named = keywords.select("node_id", hashed_id("keyword", NAMESPACES["keyword"]).alias("keyword_id"), "score", "source")
    return to_edges(named, "node_id", "keyword_id", "HAS_KEYWORD")
