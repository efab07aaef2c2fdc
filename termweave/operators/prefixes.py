"""The word prefixes of phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_steps(entries: DataFrame, *columns: str) -> DataFrame:
    exploded = entries.select(*columns, "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("depth"))
    prefix = F.array_join(F.slice("words", F.lit(1), F.col("depth")), " ")
    return exploded.withColumn("prefix", prefix).withColumn("_ends", F.col("depth") == F.size("words")).drop("words")


def prefix_rows(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct word prefix; minima and maxima combine on the map side."""
    steps = prefix_steps(entries, *by, "value", "weight", "ord", "last_ord")
    return steps.groupBy(*by, "prefix", "depth").agg(
        F.max("_ends").alias("is_terminal"),
        F.max(F.when(F.col("_ends"), F.col("value"))).alias("value"),
        F.max(F.when(F.col("_ends"), F.col("weight"))).alias("weight"),
        F.min("ord").alias("first_ord"),
        F.max(F.when(F.col("_ends"), F.col("ord"))).alias("ord"),
        F.max(F.when(F.col("_ends"), F.col("last_ord"))).alias("last_ord"),
    )
