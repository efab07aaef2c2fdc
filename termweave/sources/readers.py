"""Scans with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources import json_array

TRIPLES = "start_id string, relationship string, end_id string"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of records per file; ids stay strings by schema.

    Uncompressed files are split. Closing braces are the line ends of a text scan, so a
    split always starts behind one. The first pass notes, for each split, how far it goes
    up and down in strings and brackets; the driver adds that up, a few numbers per
    split; the second pass then knows where the records of each split lie. Only those
    that cross a split are put together by a shuffle. Elements of the array that are no
    objects give no rows, a broken record gives nulls. The splits of the two passes must
    be the same: file settings may not change before the result is computed.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    outlines = pieces.mapInArrow(json_array.outline, json_array.OUTLINE).collect()
    states = spark.sparkContext.broadcast(json_array.states([tuple(r) for r in outlines]))
    parts = pieces.mapInArrow(json_array.cut(states), json_array.PARTS)
    whole = parts.where("origin IS NULL").select("text")
    crossing = parts.where("origin IS NOT NULL").groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    records = whole.unionByName(crossing.select(F.array_join(F.col("p")["text"], "").alias("text")))
    return records.where(F.startswith("text", F.lit("{"))).select(F.from_json("text", schema).alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str, spread: int | None = None) -> DataFrame:
    """JSON Lines, also compressed (`.json.gz`, by suffix).

    Gzip files are read by one task each; `spread` redistributes the rows after.
    """
    df = spark.read.schema(schema).json(path)
    return df.repartition(spread) if spread else df


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV file or folder of part files with a header.

    Files are split. Only `multi_line` lets quoted fields span lines, and then one
    task reads each file.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Headerless `start, relationship, end` CSV."""
    return spark.read.schema(TRIPLES).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_query(
    spark: SparkSession, query: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, splits: int = 200, **options: str
) -> DataFrame:
    """Result of a query on a relational database; the caller supplies every connection option.

    With a numeric column `split_by` and its `bounds` (which only place the splits,
    rows beyond them are read too) `splits` connections read at once; else one does.
    """
    if "url" not in options:
        raise ValueError("a JDBC url is needed")
    if (split_by is None) != (bounds is None):
        raise ValueError("split_by and bounds are needed together")
    reader = spark.read.format("jdbc").options(**options)
    if split_by is None:
        return reader.option("query", query).load()
    placed = {"partitionColumn": split_by, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": splits}
    return reader.option("dbtable", f"({query}) q").options(**placed).load()


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Paths of the files with an extension; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder).select("path")


def register_keys(df: DataFrame, key: str, view: str) -> DataFrame:
    """Distinct non-null keys as a temporary view, for joins written in SQL."""
    keys = df.select(key).dropna().distinct()
    keys.createOrReplaceTempView(view)
    return keys


def with_stored_columns(df: DataFrame, stored: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns an earlier run computed, matched by key instead of by row position."""
    return df.join(stored.select(key, *columns), key, "left")


def first_rows(df: DataFrame, n: int | None, *order_by: Column | str) -> DataFrame:
    """Test cut: the first `n` rows in a declared order, everything where `n` is None."""
    return df if n is None else df.orderBy(*order_by).limit(n)


def balanced_scan(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows only where the input has fewer splits than there are cores.

    A large table has more splits than cores and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.col(key)) if df.rdd.getNumPartitions() < cores else df
