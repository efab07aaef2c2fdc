"""Bibliography joins, key sets, grouped records and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.catalog.registry import query, sql_id, table
from termweave.functions.ids import hashed_id
from termweave.operators.compare import share
from termweave.operators.frequency import subtract
from termweave.plans import bibliography as bib
from termweave.plans.samples import ai_work_ids
from termweave.sources.readers import register_keys, with_stored_columns


def _id(letter, column):
    return F.concat(F.lit(letter), column)


def papers_raw(spark, sf):
    """Orders as papers."""
    return table(spark, sf, "orders").select(hashed_id("o_orderkey", "paper-").alias("id"), F.col("o_orderkey").cast("string").alias("arxiv_id"), F.col("o_orderpriority").alias("title"))


def locations(spark, sf):
    """Two thirds of the orders as known works, half of those on the wanted site."""
    site = F.when(F.col("o_orderstatus") == "F", "http://arxiv.org/abs/").otherwise("http://other.example/abs/")
    return table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        _id("W", "o_orderkey").alias("work_id"), F.concat(site, "o_orderkey").alias("landing_page_url")
    )


def papers(spark, sf):
    return bib.external_ids(papers_raw(spark, sf), locations(spark, sf))


def works(spark, sf):
    return table(spark, sf, "orders").select(
        _id("W", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("cited"), F.lit("x").alias("display_name")
    )


def authorships(spark, sf):
    return table(spark, sf, "lineitem").select(
        _id("W", "l_orderkey").alias("work_id"),
        _id("A", "l_suppkey").alias("author_id"),
        F.col("l_linenumber").cast("string").alias("author_position"),
        F.col("l_returnflag").alias("institution_id"),
        F.lit("raw").alias("raw_affiliation_string"),
    )


def authors(spark, sf):
    return table(spark, sf, "supplier").select(
        _id("A", "s_suppkey").alias("id"),
        F.when(F.col("s_nationkey") > 2, _id("I", "s_nationkey")).alias("last_known_institution"),
        F.lit("[]").alias("display_name_alternatives"),
    )


def institutions(spark, sf):
    return table(spark, sf, "nation").select(_id("I", "n_nationkey").alias("id"), F.col("n_name").alias("name"))


def references(spark, sf):
    return table(spark, sf, "lineitem").select(_id("W", "l_orderkey").alias("work_id"), _id("W", "l_partkey").alias("referenced_work_id"))


SQL_PAPERS = f"""papers AS (
    SELECT {sql_id("'paper-' || o_orderkey")} AS id, o_orderkey::VARCHAR AS arxiv_id, o_orderpriority AS title,
           CASE WHEN o_orderstatus = 'F' THEN 'W' || o_orderkey END AS openalex_id FROM orders)"""


@query(
    "enrich_left",
    f"""WITH {SQL_PAPERS} SELECT papers.*, 'W' || o_orderkey AS id_openalex, o_orderstatus AS title_openalex, o_totalprice AS cited
    FROM papers LEFT JOIN orders ON openalex_id = 'W' || o_orderkey""",
)
def enrich_left(spark, sf):
    return bib.with_works(papers(spark, sf), works(spark, sf), dropped=("display_name",))


SQL_AUTHORSHIP_EDGES = f"""SELECT {sql_id("'author/A' || l_suppkey")} AS ":START_ID", id AS ":END_ID",
    l_linenumber::VARCHAR AS author_position, l_returnflag AS institution_id, 'AUTHORS' AS ":TYPE"
    FROM lineitem JOIN papers ON openalex_id = 'W' || l_orderkey"""


@query("translate_edges", f"WITH {SQL_PAPERS} {SQL_AUTHORSHIP_EDGES}")
def translate_edges(spark, sf):
    return bib.authorship_edges(papers(spark, sf), authorships(spark, sf))


@query(
    "keyset_semi",
    "SELECT 'W' || l_orderkey AS work_id, 'W' || l_partkey AS referenced_work_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def keyset_semi(spark, sf):
    return bib.citations(papers(spark, sf), references(spark, sf)).select("work_id", "referenced_work_id")


@query(
    "keyset_view",
    "SELECT 'W' || l_orderkey AS work_id, 'W' || l_partkey AS referenced_work_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def keyset_view(spark, sf):
    register_keys(papers(spark, sf), "openalex_id", "paper_keys")
    references(spark, sf).createOrReplaceTempView("reference_facts")
    return spark.sql("SELECT r.* FROM reference_facts r LEFT SEMI JOIN paper_keys k ON r.work_id = k.openalex_id")


@query(
    "records_by_key",
    """SELECT 'W' || l_orderkey AS work_id, 'A' || l_suppkey AS author_id, l_linenumber::VARCHAR AS author_position, l_returnflag AS institution_id
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def records_by_key(spark, sf):
    return bib.authorship_records(papers(spark, sf), authorships(spark, sf))


@query(
    "values_by_key",
    """SELECT 'W' || l_orderkey AS work_id, 'W' || l_partkey AS citation
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def values_by_key(spark, sf):
    return bib.citation_records(papers(spark, sf), references(spark, sf))


SQL_CITATION_EDGES = """SELECT a.id AS ":START_ID", b.id AS ":END_ID", 'CITES' AS ":TYPE" FROM lineitem
    JOIN papers a ON a.openalex_id = 'W' || l_orderkey JOIN papers b ON b.openalex_id = 'W' || l_partkey"""


@query("citation_edges", f"WITH {SQL_PAPERS} {SQL_CITATION_EDGES}")
def citation_edges(spark, sf):
    return bib.citation_edges(papers(spark, sf), references(spark, sf))


SQL_AUTHORS = f"""authors AS (SELECT 'A' || s_suppkey AS id, CASE WHEN s_nationkey > 2 THEN 'I' || s_nationkey END AS inst,
    {sql_id("'author/A' || s_suppkey")} AS id_md5 FROM supplier
    WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'))"""


@query("author_nodes", f"""WITH {SQL_AUTHORS} SELECT id_md5 AS "id:ID", id AS openalex_id, inst AS last_known_institution, 'Author' AS ":LABEL" FROM authors""")
def author_nodes(spark, sf):
    return bib.author_export(bib.author_nodes(papers(spark, sf), authorships(spark, sf), authors(spark, sf)))


@query(
    "institution_nodes",
    f"""WITH {SQL_AUTHORS} SELECT {sql_id("'institution/I' || n_nationkey")} AS "id:ID", 'I' || n_nationkey AS openalex_id, n_name AS name, 'Institution' AS ":LABEL"
    FROM nation WHERE 'I' || n_nationkey IN (SELECT inst FROM authors)""",
)
def institution_nodes(spark, sf):
    known = bib.author_nodes(papers(spark, sf), authorships(spark, sf), authors(spark, sf))
    return bib.institution_export(known, institutions(spark, sf))


@query(
    "affiliation_edges",
    f"""WITH {SQL_AUTHORS} SELECT id_md5 AS ":START_ID", {sql_id("'institution/' || inst")} AS ":END_ID", 'AFFILIATED_WITH' AS ":TYPE" FROM authors WHERE inst IS NOT NULL""",
)
def affiliation_edges(spark, sf):
    return bib.affiliation_edges(bib.author_nodes(papers(spark, sf), authorships(spark, sf), authors(spark, sf)))


@query(
    "bibliography_enrichment",
    f"""WITH {SQL_PAPERS}, {SQL_AUTHORS},
    per AS (SELECT 'W' || l_orderkey AS work_id, count(*) AS n_lines FROM lineitem GROUP BY 1)
    SELECT papers.id, arxiv_id, openalex_id, o_totalprice AS cited, coalesce(n_lines, 0) AS n_authorships, coalesce(n_lines, 0) AS n_citations
    FROM papers LEFT JOIN orders ON openalex_id = 'W' || o_orderkey LEFT JOIN per ON work_id = openalex_id""",
)
def bibliography_enrichment(spark, sf):
    found = papers(spark, sf)
    enriched = bib.with_works(found, works(spark, sf), dropped=("display_name", "title"))

    def sizes(records, name):
        return records.groupBy(F.col("work_id").alias("openalex_id")).agg(F.count(F.lit(1)).alias(name))

    written = sizes(bib.authorship_records(found, authorships(spark, sf)), "n_authorships")
    cited = sizes(bib.citation_records(found, references(spark, sf)), "n_citations")
    joined = enriched.join(written, "openalex_id", "left").join(cited, "openalex_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_authorships", "n_citations")]
    return joined.select("id", "arxiv_id", "openalex_id", "cited", *counts)


@query(
    "stored_columns_join",
    f"""WITH {SQL_PAPERS} SELECT id, arxiv_id, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS stored
    FROM papers JOIN orders ON arxiv_id = o_orderkey::VARCHAR""",
)
def stored_columns_join(spark, sf):
    stored = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").cast("string").alias("arxiv_id"), F.col("o_totalprice").alias("stored"))
    return with_stored_columns(papers_raw(spark, sf).select("id", "arxiv_id"), stored, "arxiv_id", "stored").select("id", "arxiv_id", "stored")


@query(
    "anti_exclusions",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    AND o_orderkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""",
)
def anti_exclusions(spark, sf):
    lines = table(spark, sf, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    parts = lines.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("id"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return subtract(subtract(orders, returned, "id"), parts, "id")


CONCEPTS = ("ECONOMY", "SMALL", "LARGE")


@query(
    "concept_join",
    """SELECT 'W' || l_orderkey AS work_id FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_type = 'ECONOMY' OR p_type = 'SMALL' OR p_type = 'LARGE' AND l_discount > 0.02""",
)
def concept_join(spark, sf):
    return ai_work_ids(works_concepts(spark, sf), concepts(spark, sf), CONCEPTS, min_score=0.02)


@query(
    "concept_join_strict",
    """SELECT 'W' || l_orderkey AS work_id FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE (p_type = 'ECONOMY' OR p_type = 'SMALL' OR p_type = 'LARGE') AND l_discount > 0.02""",
)
def concept_join_strict(spark, sf):
    return ai_work_ids(works_concepts(spark, sf), concepts(spark, sf), CONCEPTS, min_score=0.02, strict=True)


def works_concepts(spark, sf):
    return table(spark, sf, "lineitem").select(_id("W", "l_orderkey").alias("work_id"), F.col("l_partkey").alias("concept_id"), F.col("l_discount").alias("score"))


def concepts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("display_name"))


@query(
    "coverage",
    f"""WITH {SQL_PAPERS} SELECT round(avg((openalex_id IS NOT NULL)::INT), 6) AS with_id, round(count(DISTINCT openalex_id) / count(*), 6) AS distinct_ids,
    round(avg((title = '5-LOW')::INT), 6) AS low FROM papers""",
)
def coverage(spark, sf):
    found = papers(spark, sf)
    return found.agg(
        F.round(share(F.col("openalex_id").isNotNull()), 6).alias("with_id"),
        F.round(F.countDistinct("openalex_id") / F.count(F.lit(1)), 6).alias("distinct_ids"),
        F.round(share(F.col("title") == "5-LOW"), 6).alias("low"),
    )


@query(
    "duplicate_count",
    "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates, count(*) AS rows FROM lineitem",
)
def duplicate_count(spark, sf):
    # Counting distinct keys through a grouping combines on the map side and spills.
    per_key = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.sum("n").alias("rows"))


@query(
    "distinct_keys",
    "SELECT DISTINCT l_suppkey FROM lineitem",
)
def distinct_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey").distinct()
