"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has no nested values."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    )


def write_csv(df: DataFrame, path: str, parts: int | None = None) -> None:
    """CSV with header; `parts` fixes the number of part files."""
    flat = flat_columns(df)
    if parts:
        flat = flat.repartition(parts)
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
