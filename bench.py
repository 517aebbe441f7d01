"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from loomgrid import plans

HEADLINE = [
    "files_manifest", "drift", "line_offsets", "ownership_range_join", "span_merge", "range_subtract", "graph_merge_first_wins", "unit_edges", "edge_status_matrix", "query_graph_kind",
    "call_resolution", "rollup_directed", "lca_dependencies", "subtree_units", "find_term", "resolve_name", "catalog_symbols", "tfidf_topk", "cochange_pairs", "soft_modularity",
    "usage_max_then_sum", "layer_chunks_budget", "corpus_sizes",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    plans.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
