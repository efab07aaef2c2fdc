"""A corpus pipeline of five operators: from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import lines, minhash, ordinal, pii
from termweave.llm.common import same_text
from termweave.llm.queries import graded_labels, packed
from termweave.session import durable, release, ship_package


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """`docs` with its columns of the given names renamed, and an empty table with the names as they were."""
    taken = {c: f"{c}_of_the_table" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(taken), docs.limit(0)


def _back(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, in its order, from a table that `_apart` renamed."""
    return docs.select(*[F.col(f"{c}_of_the_table" if f"{c}_of_the_table" in docs.columns else c).alias(c) for c in like.columns])


def _nested(docs: DataFrame) -> DataFrame:
    """`(row, id, hash)`: whole rows beside what a stage's verdicts are found by, so that no column of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), same_text("text").alias("hash"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents that are left, selects. Any other column is handed on, whatever its name."""
    model = ordinal.fit(docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    renamed, like = _apart(docs, "expected_grade", "tail", "selected")
    return _back(ordinal.rate(renamed, model).where("selected"), like)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their boilerplate lines; `n_chars` follows the text. Any other column is handed on, whatever its name."""
    judged = lines.judge(docs).where("kept").select(F.col("doc_id").alias("judged_id"), F.col("text_hash").alias("judged_hash"), F.col("removed_lines").alias("gone")).dropDuplicates(["judged_id", "judged_hash"])
    kept = _nested(docs).join(judged, F.col("id").eqNullSafe(F.col("judged_id")) & (F.col("hash") == F.col("judged_hash")))
    renamed, like = _apart(docs, "removed_lines")
    rows = kept.select("row.*", F.col("gone").alias("gone_from_the_text")).toDF(*renamed.columns, "removed_lines")
    return _back(lines.without_lines(rows).withColumn("n_chars", F.char_length("text").cast("long")), like)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Rows that repeat an id and a text are one document; rows that repeat an id with
    another text go only if the texts are linked; rows without an id stay. Any other
    column is handed on, whatever its name.
    """
    grouped = minhash.near_duplicates(docs, shingle=5, percent=80)
    kept = grouped.where("first AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count(F.lit(1)).alias("times"))
    rows = _nested(docs).join(kept, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    once, more = rows.where("times = 1"), rows.where("times > 1").dropDuplicates(["id", "hash"])
    return once.select("row.*").unionByName(more.select("row.*")).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kind; `n_chars` follows the text. Any other column is handed on, whatever its name."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence and the place they are packed to. Other columns are not read."""
    return packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Neither the classifier's fit nor the tokenizer can be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again; a table goes when the next one is written."""
    ship_package(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
