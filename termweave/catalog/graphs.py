"""Record normalisation, graph export, pattern match and hierarchy walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.catalog.registry import documents, query, sql_id, sql_words, table
from termweave.functions.ids import hashed_id
from termweave.functions.text import dictionary_words
from termweave.operators import graph
from termweave.plans.records import listed_edges, normalise_records
from termweave.session import durable
from termweave.sources.readers import balanced_scan

SQL_DOC_ID = sql_id("'http://papers.example/' || doc_id")


def raw_records(spark, sf):
    """Raw nested collections made of the driver's tables."""
    paper = F.lit("http://papers.example/")
    papers = documents(spark, sf).select(
        F.concat(paper, "doc_id").alias("paper_url"),
        F.col("text").alias("abstract"),
        F.array(F.concat_ws(" ", F.lit("Task"), "lang"), F.concat_ws(" ", F.lit("Task"), "source")).alias("tasks"),
        F.when(F.col("lang") != "en", F.array(F.struct(F.concat_ws(" ", F.lit("Method"), F.col("n_chars") % 7).alias("name")))).alias("methods"),
    )
    methods = table(spark, sf, "part").select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.concat(F.lit("<p>"), "p_type", F.lit(" *  of</p> "), "p_brand").alias("description")
    )
    repos = table(spark, sf, "pages").select(F.col("url").alias("repo_url"), F.concat(paper, "page_id").alias("paper_url"))
    datasets = table(spark, sf, "supplier").select(
        F.concat(F.lit("http://data.example/"), "s_suppkey").alias("url"),
        F.col("s_name").alias("description"),
        F.array(F.struct(F.concat_ws(" ", F.lit("Task"), "s_nationkey").alias("task"))).alias("tasks"),
    )
    nation = table(spark, sf, "nation").select(
        "n_regionkey",
        F.struct(F.concat(F.lit("t"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("  about\n"), "n_name").alias("description")).alias("task"),
    )
    # 25 nations in 5 regions: fixed-size tables of the schema.
    listed = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("task")).alias("tasks"))
    areas = table(spark, sf, "region").join(listed, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.lower("r_name").alias("id"), F.col("r_name").alias("name"), "tasks"
    )
    return papers, methods, repos, datasets, areas


@query(
    "normalise_records",
    f"""SELECT 'papers_tasks' AS edge, {SQL_DOC_ID} AS src, {sql_id("'task/' || replace(lower(t), ' ', '-')")} AS dst
        FROM (SELECT doc_id, unnest(['Task ' || lang, 'Task ' || source]) AS t FROM documents)
    UNION ALL SELECT 'papers_methods', {SQL_DOC_ID}, {sql_id("'method/method-' || (n_chars % 7)")} FROM documents WHERE lang <> 'en'
    UNION ALL SELECT 'papers_repos', {sql_id("'http://papers.example/' || page_id")}, {sql_id("'repo/' || url")} FROM pages
    UNION ALL SELECT 'datasets_tasks', {sql_id("'http://data.example/' || s_suppkey")}, {sql_id("'task/task-' || s_nationkey")} FROM supplier
    UNION ALL SELECT 'tasks_areas', {sql_id("'task/t' || n_nationkey")}, {sql_id("'area/' || lower(r_name)")} FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'methods', {sql_id("'method/' || replace(lower(p_name || ' ' || p_partkey), ' ', '-')")}, regexp_replace(regexp_replace('<p>' || p_type || ' *  of</p> ' || p_brand, '<[^<]+?>|\\*|\n|\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') FROM part
    UNION ALL SELECT 'tasks', {sql_id("'task/t' || n_nationkey")}, 'about ' || n_name FROM nation""",
)
def normalise(spark, sf):
    tables = normalise_records(*raw_records(spark, sf))
    picks = {
        "papers_tasks": ("paper_id", "task_id_md5"),
        "papers_methods": ("paper_id", "method_id_md5"),
        "papers_repos": ("paper_id", "repo_id"),
        "datasets_tasks": ("dataset_id", "task_id_md5"),
        "tasks_areas": ("id", "area"),
        "methods": ("id", "description"),
        "tasks": ("id_md5", "description"),
    }
    parts = [
        tables[name].select(F.lit(name).alias("edge"), F.col(src).alias("src"), F.col(dst).alias("dst"))
        for name, (src, dst) in picks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "explode_edges",
    f"""SELECT {SQL_DOC_ID} AS paper_id, word AS task_id, {sql_id("'task/' || word")} AS task_id_md5
    FROM (SELECT doc_id, unnest(list_distinct({sql_words('text')})) AS word FROM documents)""",
)
def explode_edges(spark, sf):
    papers = documents(spark, sf).select(
        hashed_id(F.concat(F.lit("http://papers.example/"), "doc_id")).alias("id"), F.array_distinct(dictionary_words("text")).alias("tasks")
    )
    return listed_edges(papers, "id", "tasks", None, "paper_id", "task_id", "task")


@query(
    "unnest_structs",
    f"""SELECT {sql_id("'area/' || lower(r_name)")} AS area_id_md5, 't' || n_nationkey AS id, n_name AS name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def unnest_structs(spark, sf):
    tasks = normalise_records(*raw_records(spark, sf))["tasks"]
    return tasks.select("area_id_md5", "id", "name")


def part_nodes(spark, sf):
    parts = table(spark, sf, "part").select("p_name", "p_brand", hashed_id(F.concat_ws(" ", "p_name", "p_partkey"), "method/").alias("id"))
    return graph.to_nodes(parts, "id", "Method")


def order_edges(spark, sf):
    lines = balanced_scan(table(spark, sf, "lineitem"), "l_orderkey").select(
        hashed_id("l_orderkey").alias("paper"), hashed_id("l_partkey", "method/").alias("method"), F.col("l_quantity").alias("score")
    )
    return graph.to_edges(lines, "paper", "method", "HAS_METHOD", source="order")


SQL_PART_NODES = f"""SELECT {sql_id("'method/' || p_name || ' ' || p_partkey")} AS "id:ID", p_name, p_brand, 'Method' AS ":LABEL" FROM part"""
SQL_ORDER_EDGES = f"""SELECT {sql_id("l_orderkey::VARCHAR")} AS ":START_ID", {sql_id("'method/' || l_partkey")} AS ":END_ID",
    l_quantity AS score, 'order' AS source, 'HAS_METHOD' AS ":TYPE" FROM lineitem"""


@query("nodes_export", SQL_PART_NODES)
def nodes_export(spark, sf):
    return part_nodes(spark, sf)


@query("edges_export", SQL_ORDER_EDGES)
def edges_export(spark, sf):
    return order_edges(spark, sf)


@query(
    "header_idspace",
    f"""SELECT ":START_ID" AS ":START_ID(papers)", ":END_ID" AS ":END_ID(methods)", score, source, ":TYPE" FROM ({SQL_ORDER_EDGES})""",
)
def header_idspace(spark, sf):
    return graph.with_id_spaces(order_edges(spark, sf), START_ID="papers", END_ID="methods")


@query(
    "load_counts",
    """SELECT 'Method' AS kind, count(*) AS rows FROM part UNION ALL SELECT 'Author', count(*) FROM customer
    UNION ALL SELECT 'Paper', count(*) FROM documents""",
)
def load_counts(spark, sf):
    tables = {
        "methods": part_nodes(spark, sf),
        "authors": graph.to_nodes(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "Author"),
        "papers": graph.to_nodes(table(spark, sf, "documents").select("doc_id"), "doc_id", "Paper"),
    }
    return graph.load_counts(tables, ":LABEL")


@query("edge_counts", "SELECT 'HAS_METHOD' AS kind, count(*) AS rows FROM lineitem UNION ALL SELECT 'HAS_TASK', count(*) FROM orders")
def edge_counts(spark, sf):
    orders = graph.to_edges(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "HAS_TASK")
    return graph.load_counts({"lines": order_edges(spark, sf), "orders": orders}, ":TYPE")


@query(
    "pattern_match",
    """SELECT o_orderkey AS n_id, o_orderpriority AS n_title, l_discount AS score, p_partkey AS t_id, p_name AS t_keyword
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_discount <= 0.05 AND l_returnflag = 'A'""",
)
def pattern_match(spark, sf):
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    edges = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"),
        F.col("l_partkey").alias("dst"),
        F.when(F.col("l_returnflag") == "A", "HAS_KEYWORD").otherwise("HAS_TASK").alias("type"),
        F.col("l_discount").alias("score"),
    )
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("keyword"))
    return graph.match_pattern(nodes, edges, targets, "HAS_KEYWORD", F.col("score") <= 0.05)


@query(
    "node_scan",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer WHERE c_mktsegment <> 'MACHINERY'",
)
def node_scan(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("Task").alias("label"), F.col("c_name").alias("name"), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("description")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("Method").alias("label"), F.col("s_name").alias("name"), F.col("s_name").alias("description")
    )
    return graph.node_scan(customers.unionByName(suppliers), "Task", "name", "description").drop("label")


def topics(spark, sf):
    """Topic triples: region over nation over customer and supplier, suppliers over the parts they sold."""
    relation = F.lit("superTopicOf").alias("relationship")

    def triples(df, start, end):
        return df.select(F.col(start).cast("string").alias("start_id"), relation, F.col(end).cast("string").alias("end_id"))

    nation = table(spark, sf, "nation")
    places = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = table(spark, sf, "lineitem").select(F.format_string("Supplier#%09d", "l_suppkey").alias("s"), F.concat(F.lit("part "), "l_partkey").alias("p")).distinct()
    other = triples(nation, "n_name", "n_nationkey").withColumn("relationship", F.lit("relatedEquivalent"))
    parts = [triples(places, "r_name", "n_name"), triples(customers, "n_name", "c_name"), triples(suppliers, "n_name", "s_name"), triples(sold, "s", "p"), other]
    return reduce(DataFrame.unionByName, parts)


SQL_TOPICS = """topics AS (
    SELECT r_name AS start_id, n_name AS end_id FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT format('Supplier#{:09d}', l_suppkey), 'part ' || l_partkey FROM lineitem)"""


@query(
    "topic_levels",
    f"""WITH {SQL_TOPICS},
    l1 AS (SELECT end_id FROM topics WHERE start_id = 'ASIA'),
    l2 AS (SELECT end_id FROM topics WHERE start_id IN (SELECT end_id FROM l1)),
    l3 AS (SELECT end_id FROM topics WHERE start_id IN (SELECT end_id FROM l2)),
    l4 AS (SELECT end_id FROM topics WHERE start_id IN (SELECT end_id FROM l3))
    SELECT 1 AS level, end_id FROM l1 UNION ALL SELECT 2, end_id FROM l2 UNION ALL SELECT 3, end_id FROM l3 UNION ALL SELECT 4, end_id FROM l4""",
)
def topic_levels(spark, sf):
    # The triples are derived here and read once per level, so they are written first.
    return graph.topic_levels(durable(topics(spark, sf)), "ASIA")


@query(
    "topic_closure",
    f"""WITH RECURSIVE {SQL_TOPICS},
    closure(end_id) AS (SELECT end_id FROM topics WHERE start_id = 'ASIA' UNION SELECT t.end_id FROM closure c JOIN topics t ON t.start_id = c.end_id)
    SELECT DISTINCT end_id FROM closure""",
)
def topic_closure(spark, sf):
    return graph.topic_closure(durable(topics(spark, sf)), "ASIA")
