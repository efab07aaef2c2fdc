"""Nested raw records to node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.ids import NAMESPACES, hashed_id, slug
from termweave.functions.text import markup_clean


def listed_edges(df: DataFrame, id_column: str, items: str, pick: Column | None, parent: str, child: str, kind: str) -> DataFrame:
    """Edges from a list column: `(parent, child, child_md5)`; rows without items drop out."""
    exploded = df.select(F.col(id_column).alias(parent), F.explode(items).alias("item"))
    name = slug(pick if pick is not None else F.col("item"))
    named = exploded.select(parent, name.alias(child)).dropna()
    return named.withColumn(f"{child}_md5", hashed_id(child, NAMESPACES[kind]))


def normalise_records(
    papers: DataFrame, methods: DataFrame, repos: DataFrame, datasets: DataFrame, areas: DataFrame
) -> dict[str, DataFrame]:
    """All node and edge tables of the raw collections, as one lazy plan each."""
    clean = {c: markup_clean(c) for c in ("title", "abstract") if c in papers.columns}
    papers = papers.withColumns(clean).withColumn("id", hashed_id("paper_url"))
    methods = methods.withColumns({"name": slug("name"), "description": markup_clean("description")})
    methods = methods.withColumn("id", hashed_id("name", NAMESPACES["method"]))
    repos = repos.withColumn("id", hashed_id("repo_url", NAMESPACES["repo"])).withColumn("paper_id", hashed_id("paper_url"))
    datasets = datasets.withColumns({"id": hashed_id("url"), "description": markup_clean("description")})
    areas = areas.withColumn("id_md5", hashed_id("id", NAMESPACES["area"]))
    tasks = areas.select(F.col("id_md5").alias("area_id_md5"), F.inline("tasks")).select(
        "id",
        "name",
        markup_clean("description").alias("description"),
        "area_id_md5",
        hashed_id("id", NAMESPACES["task"]).alias("id_md5"),
    )
    return {
        "papers": papers,
        "methods": methods,
        "repos": repos,
        "datasets": datasets,
        "areas": areas,
        "tasks": tasks,
        "datasets_tasks": listed_edges(datasets, "id", "tasks", F.col("item.task"), "dataset_id", "task_id", "task"),
        "papers_tasks": listed_edges(papers, "id", "tasks", None, "paper_id", "task_id", "task"),
        "papers_methods": listed_edges(papers, "id", "methods", F.col("item.name"), "paper_id", "method_id", "method"),
        "papers_repos": repos.select(F.col("id").alias("repo_id"), "paper_id"),
        "tasks_areas": tasks.select(F.col("id_md5").alias("id"), F.col("area_id_md5").alias("area")),
    }
