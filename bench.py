"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

#: One or more queries of each family; others can be named on the command line. Each runs once to warm up and once for its figure.
#: Indexes and clustered tables that a first run lays out count too: their seconds stand under ``builds`` and in the total.
HEADLINE = [
    "hotspots_churn",
    "recently_relevant",
    "cochange_coupling",
    "ownership_decay",
    "audit_risk",
    "pr_risk",
    "tiered_match",
    "telemetry_coverage",
    "usage_trend_half",
    "trend_regression",
    "search_exact_prefix_substring",
    "bm25_topk",
    "phrase_search",
    "prefix_search",
    "substring_index",
    "tiered_search",
    "composed_search",
    "index_references",
    "call_graph_depth2",
    "call_graph_roles",
    "ppr_topk",
    "strongest_way",
    "interval_container",
    "impact_risk",
    "snapshot_diff",
    "cdc_apply",
    "federated_hotspots",
    "contract_risk",
    "fuzzy_alias",
    "suffix_resolve",
    "stream_debounce_session",
    "eval_recall_mrr",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loam.plans import catalog
    from loam.sources import search_store, writers

    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        for turn in (first, took):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            turn[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
        print(name, first[name], took[name], file=sys.stderr)
    builds = {n: round(s, 3) for n, s in [*search_store.BUILDS, *writers.BUILDS]}
    total = round(sum(took.values()) + sum(builds.values()), 3)
    print(json.dumps({"metric": "headline queries and what they lay out, total seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "builds": builds, "first": first}))
    spark.stop()


if __name__ == "__main__":
    main()
