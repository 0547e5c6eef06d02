"""Time the headline queries once each and print one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from lakeqa.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "linearize_csv linearize_json tokenize vocab_normalize lexical_postings bm25_stats bm25_topk "
    "bm25_two_field bm25_stemmed dense_topk dense_accuracy dense_passages zoom_requests zoom_two_stage "
    "rerank_requests rerank_merge context_assemble context_budget parse_answer cache_lookup cache_misses "
    "complete_requests cost_per_query cost_estimate topk_accuracy answer_metrics split_easy_hard run_record "
    "report_flat "
    "report_pivot ranked_accuracy answered_run"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lakeqa-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python's workers before timing.
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").count()
    timings = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
