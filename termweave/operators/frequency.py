"""Keyword frequencies and precedence between keyword sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.skew import salted_join


def occurrences(times: str | None) -> Column:
    """How often the rows of a group occur; with `times`, a row stands for so many."""
    return F.sum(times) if times else F.count(F.lit(1))


def keyword_frequency(keywords: DataFrame, by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """`(…by, keyword, frequency, frequency_normalized)`, the share of the most frequent keyword.

    Counting combines on the map side. The maximum is one value (a scalar
    subquery) or one row per group joined back. With `times`, a row stands for so many.
    """
    counts = keywords.groupBy(*by, "keyword").agg(occurrences(times).alias("frequency"))
    if not by:
        top = counts.agg(F.max("frequency")).scalar()
        return counts.withColumn("frequency_normalized", F.col("frequency") / top)
    tops = counts.groupBy(*by).agg(F.max("frequency").alias("_top"))
    shared = counts.join(tops, list(by))
    return shared.withColumn("frequency_normalized", F.col("frequency") / F.col("_top")).drop("_top")


def keyword_documents(keywords: DataFrame, id_column: str, lowest: int, highest: int, **split: int) -> DataFrame:
    """`(keyword, frequency, id)`: the documents of every keyword whose frequency lies in the range, one row each."""
    counts = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"))
    wanted = counts.where(F.col("frequency").between(lowest, highest))
    return salted_join(keywords, wanted, "keyword", **split).select("keyword", "frequency", id_column)


def subtract(df: DataFrame, other: DataFrame, key: str = "keyword") -> DataFrame:
    """Rows of `df` whose key is not in `other`; null keys of `other` exclude nothing."""
    return df.join(other.select(key).dropna().distinct(), key, "left_anti")


def by_precedence(df: DataFrame, order: Sequence[str], key: str = "keyword", source: str = "source") -> DataFrame:
    """Keep for each key only the rows of its strongest source.

    Equals chained anti-joins, source after source, in a single pass: the strongest
    rank per key combines on the map side.
    """
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(order)])
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [key, "_rank"], "left_semi").select(*df.columns)
