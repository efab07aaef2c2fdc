"""Sources and sinks: what is written is what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalog.graphs import SQL_ORDER_EDGES, order_edges
from termweave.catalog.registry import documents, phrase_table, query, sql_phrases, sql_prefixes, sql_words, table
from termweave.functions.text import dictionary_words, inverted_index_text
from termweave.session import scratch_path
from termweave.sources import readers, store, writers


@query(
    "json_round_trip",
    f"SELECT doc_id::VARCHAR AS id, lang, {sql_words('text')} AS words FROM documents",
)
def json_round_trip(spark, sf):
    path = scratch_path(spark)
    docs = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "lang", dictionary_words("text").alias("words"))
    writers.write_json(docs, path)
    return readers.read_json_lines(spark, path, "id string, lang string, words array<string>")


@query("json_gzip", "SELECT event_id, event_type, props FROM events")
def json_gzip(spark, sf):
    path = scratch_path(spark)
    table(spark, sf, "events").select("event_id", "event_type", "props").write.option("compression", "gzip").json(path)
    return readers.read_json_lines(spark, path, "event_id long, event_type string, props string", spread=8)


@query("json_array", "SELECT n_regionkey AS region, n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def json_array(spark, sf):
    """One JSON array of records per file, here one file per region."""
    path = scratch_path(spark)
    records = table(spark, sf, "nation").select("n_regionkey", F.struct(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")).alias("r"))
    arrays = records.groupBy("n_regionkey").agg(F.to_json(F.collect_list("r")).alias("value")).select("value")
    arrays.repartition(5).write.text(path)
    return readers.read_json_array(spark, path, "region int, id string, name string")


@query("csv_round_trip", "SELECT doc_id, text, source FROM documents")
def csv_round_trip(spark, sf):
    """Whole texts with line breaks and quotes through CSV."""
    path = scratch_path(spark)
    writers.write_csv(documents(spark, sf).select("doc_id", "text", "source"), path)
    return readers.read_csv(spark, path, "doc_id long, text string, source string", multi_line=True)


@query("csv_parts", "SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings")
def csv_parts(spark, sf):
    """A fixed number of part files; arrays travel as JSON text."""
    path = scratch_path(spark)
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    writers.write_csv(vectors, path, parts=4)
    back = readers.read_csv(spark, path, "vec_id long, label int, embedding string")
    return back.withColumn("embedding", F.from_json("embedding", "array<double>"))


@query("triples_scan", "SELECT c_name AS start_id, 'superTopicOf' AS relationship, c_mktsegment AS end_id FROM customer")
def triples_scan(spark, sf):
    path = scratch_path(spark)
    table(spark, sf, "customer").select("c_name", F.lit("superTopicOf"), "c_mktsegment").write.csv(path)
    return readers.read_triples(spark, path)


@query("parquet_round_trip", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def parquet_round_trip(spark, sf):
    """Partitioned table; the filter prunes partitions."""
    path = scratch_path(spark)
    writers.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, "l_returnflag")
    back = readers.read_parquet(spark, path).where("l_returnflag = 'A'")
    return back.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("graph_csv", SQL_ORDER_EDGES)
def graph_csv(spark, sf):
    """Bulk-load edges with their header, read back."""
    path = scratch_path(spark)
    writers.write_csv(order_edges(spark, sf), path)
    return readers.read_csv(spark, path, "`:START_ID` string, `:END_ID` string, score double, source string, `:TYPE` string")


@query("file_listing", "SELECT 'part-' || n_regionkey AS folder FROM nation GROUP BY n_regionkey")
def file_listing(spark, sf):
    """Files of a folder by extension: one text file per region."""
    path = scratch_path(spark)
    regions = table(spark, sf, "nation").select("n_regionkey", "n_name")
    regions.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = readers.list_files(spark, f"{path}/*", ".txt")
    return files.select(F.concat(F.lit("part-"), F.regexp_extract("path", "n_regionkey=(\\d+)", 1)).alias("folder"))


SQL_STORED = f"""{sql_phrases()}, {sql_prefixes()}"""


@query("prefix_store", f"WITH {SQL_STORED} SELECT prefix, depth::INT AS depth, is_terminal, value, round(weight, 6) AS weight FROM prefixes")
def prefix_store(spark, sf):
    """All depths with values and weights of one part of a stored table that holds two."""
    path = scratch_path(spark)
    rows = phrase_table(spark, sf).select("keyword", "weight", F.col("value").alias("trie_id"), F.lit("benchmark").alias("source"))
    both = rows.withColumn("dict", F.lit("core")).unionByName(rows.withColumn("dict", F.lit("extended")).where("keyword < 'm'"))
    store.save_store(both, path, weight="weight")
    part = store.load_part(spark, path, dict_name="core", source="benchmark")
    return part.select("prefix", "depth", "is_terminal", "value", F.round("weight", 6).alias("weight"))


@query(
    "inverted_index_text",
    f"""SELECT conv_id, turn, array_to_string(w, ' ') AS positional,
        array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i, 'p': list_position(w, w[i])}}), lambda s: s.i = s.p), lambda s: w[s.i]), ' ') AS keys
    FROM (SELECT conv_id, turn, {sql_words('text')} AS w FROM conversations)""",
)
def inverted_index(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", dictionary_words("text").alias("w"))
    positions = F.transform(
        F.array_distinct("w"),
        lambda k: F.struct(k, F.filter(F.transform("w", lambda w, i: F.when(w == k, i)), lambda i: i.isNotNull())),
    )
    indexed = words.select("conv_id", "turn", F.to_json(F.struct(F.map_from_entries(positions).alias("InvertedIndex"))).alias("json"))
    return indexed.select(
        "conv_id", "turn", inverted_index_text("json", positional=True).alias("positional"), inverted_index_text("json").alias("keys")
    )


@query("props_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def props_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
