"""Property-graph shapes as DataFrames: bulk-load export, pattern match, hierarchy walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import durable, release


def id_first(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(id_column, *[c for c in df.columns if c != id_column])


def to_nodes(df: DataFrame, id_column: str, label: str) -> DataFrame:
    """Bulk-load node shape: `id:ID` first, properties, `:LABEL` last."""
    named = df.withColumn(id_column, F.col(id_column).cast("string")).withColumnRenamed(id_column, "id:ID")
    return id_first(named, "id:ID").withColumn(":LABEL", F.lit(label))


def to_edges(df: DataFrame, start: str, end: str, edge_type: str, **constants: str) -> DataFrame:
    """Bulk-load edge shape: `:START_ID`, `:END_ID`, properties, constant tags, `:TYPE`."""
    properties = [c for c in df.columns if c not in (start, end)]
    return df.select(
        F.col(start).cast("string").alias(":START_ID"),
        F.col(end).cast("string").alias(":END_ID"),
        *properties,
        *[F.lit(v).alias(k) for k, v in constants.items()],
        F.lit(edge_type).alias(":TYPE"),
    )


def with_id_spaces(df: DataFrame, **spaces: str) -> DataFrame:
    """Put id spaces into the headers, all at once: `with_id_spaces(df, START_ID="authors")`."""
    renames = {}
    for column in df.columns:
        space = spaces.get(column.rsplit(":", 1)[-1])
        if space:
            renames[column] = f"{column}({space})"
    return df.withColumnsRenamed(renames)


def node_scan(nodes: DataFrame, label: str, *required: str) -> DataFrame:
    """Nodes of a label whose `required` properties are all present."""
    return nodes.where(F.col("label") == label).dropna(subset=list(required) or None, how="any")


def match_pattern(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, edge_type: str, where: Column | None = None
) -> DataFrame:
    """`(n)-[r:TYPE]->(t) WHERE …`: one row per matching edge, with edge multiplicity.

    `nodes(id, …)`, `edges(src, dst, type, …)`, `targets(id, …)`; node columns come
    out as `n_*`, target columns as `t_*`. Edges are filtered before both joins.
    """
    kept = edges.where(F.col("type") == edge_type)
    if where is not None:
        kept = kept.where(where)
    sources = nodes.select([F.col(c).alias(f"n_{c}") for c in nodes.columns])
    ends = targets.select([F.col(c).alias(f"t_{c}") for c in targets.columns])
    return kept.join(sources, kept["src"] == sources["n_id"]).join(ends, F.col("dst") == F.col("t_id")).drop("src", "dst", "type")


#: From this level on the number of edge starts is looked up, to tell a long path from a cycle.
CYCLE_CHECK_LEVEL = 32


def topic_levels(
    triples: DataFrame,
    root: str,
    relationship: str = "superTopicOf",
    max_levels: int | None = None,
    visit_once: bool = False,
) -> DataFrame:
    """`(level, end_id)`: every edge end reached from `root`, level by level.

    A level expands the *set* of the previous level's ends, so a topic met on two
    levels is expanded on both, as its frequency counts double later on. With
    `visit_once` a topic is expanded only the first time, which also ends cycles.
    Levels go on until one is empty, or up to `max_levels` where the caller wants a
    cut. A path that visits no topic twice has at most as many edges as there are
    edge starts, so more levels than that show a cycle, which raises an error.
    Each level is made durable, so the plan does not grow with the depth and only
    a yes/no answer per level reaches the driver.
    """
    edges = triples.where(F.col("relationship") == relationship).select("start_id", "end_id")
    spark = triples.sparkSession
    frontier = spark.createDataFrame([(root,)], "start_id string")
    seen = frontier
    levels = []
    level, longest = 0, None
    while max_levels is None or level < max_levels:
        level += 1
        if max_levels is None and not visit_once and level > CYCLE_CHECK_LEVEL:
            longest = longest or edges.select("start_id").distinct().count()
            if level > longest:
                raise ValueError(f"the topics below {root} hold a cycle")
        reached = durable(edges.join(frontier, "start_id", "left_semi").select(F.lit(level).alias("level"), "end_id"))
        if reached.isEmpty():
            break
        levels.append(reached)
        frontier = reached.select(F.col("end_id").alias("start_id")).distinct()
        if visit_once:
            frontier = durable(frontier.join(seen, "start_id", "left_anti"))
            seen = seen.unionByName(frontier)
    empty = spark.createDataFrame([], "level int, end_id string")
    return reduce(DataFrame.unionByName, levels, empty)


def topic_closure(triples: DataFrame, root: str, relationship: str = "superTopicOf") -> DataFrame:
    """Distinct topics below `root`; a cycle back to the root makes it one of them.

    A topic with one parent is below the root if that parent is, so such topics point to
    their parent and the pointers are doubled until they lead to a topic with several
    parents, with none, or to the root: a chain takes a logarithmic number of rounds.
    Only the topics with several parents are then walked, level by level. Pointers that
    run in a cycle end nowhere and stop with the longest possible chain.
    """
    edges = durable(triples.where(F.col("relationship") == relationship).select("start_id", "end_id").where("start_id IS NOT NULL AND end_id IS NOT NULL").distinct())
    parents = durable(edges.groupBy("end_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_id").alias("up")))
    single = (F.col("n") == 1) & (F.col("end_id") != F.lit(root))
    pointers = durable(parents.where(single).select(F.col("end_id").alias("topic"), "up"))
    for _ in range(pointers.count().bit_length() + 1):
        ahead = pointers.select(F.col("topic").alias("up"), F.col("up").alias("next"))
        moved = durable(pointers.join(ahead, "up", "left").select("topic", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("_moved")))
        release(pointers)
        pointers = moved
        if moved.where("_moved").isEmpty():
            break
    heads = pointers.select(F.col("topic").alias("start_id"), F.col("up").alias("head"))
    joints = parents.where(~single).select("end_id")
    between = edges.join(joints, "end_id", "left_semi").join(heads, "start_id", "left").select(F.coalesce("head", "start_id").alias("start_id"), F.lit(relationship).alias("relationship"), "end_id")
    walked = topic_levels(durable(between.distinct()), root, relationship, visit_once=True).select("end_id").distinct()
    reached = durable(walked.unionByName(triples.sparkSession.createDataFrame([(root,)], "end_id string")).distinct())
    below = pointers.join(reached.withColumnRenamed("end_id", "up"), "up", "left_semi").select(F.col("topic").alias("end_id"))
    return below.unionByName(walked).distinct()


def load_counts(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Rows per `:LABEL` or `:TYPE` over all exported tables."""
    tagged = [df.select(F.col(f"`{tag}`").alias("kind")) for df in tables.values()]
    return reduce(DataFrame.unionByName, tagged).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
