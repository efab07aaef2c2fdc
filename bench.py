"""Time the headline queries: one JSON line, seconds per query (all rows computed; the better of two runs, after one query as warm-up)."""

from __future__ import annotations

import json
import os
import sys
import time

from termweave import build_session
from termweave.catalog import QUERIES

HEADLINE = [
    "aggregate_search_info",
    "sample_stats",
    "trie_search",
    "trie_search_joined",
    "trie_search_lemmas",
    "aggregate_search_info_joined",
    "search_list",
    "search_metrics",
    "phrase_doc_matrix",
    "tfidf_vocab",
    "multi_pattern_hits",
    "similar_phrases",
    "similar_phrases_cells",
    "threshold_sweep",
    "keyphrases_term_stats",
    "keyphrases_top10",
    "core_dictionary",
    "merged_dictionary",
    "negative_sample",
    "normalise_records",
    "bibliography_enrichment",
    "citation_edges",
    "topic_levels",
    "node_ids",
    "edges_export",
    "language_id",
    "balanced_sample",
    "group_count_rows",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "termweave-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES[HEADLINE[0]], spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(min(run(QUERIES[name], spark, sf_dir) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
