"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "changed_docs", "chunk_docs", "reading_order", "upsert_chunks", "hash_embed", "bm25_topk", "vector_topk", "dense_topk",
    "rrf_fuse", "rerank_topk", "knowledge_query", "cache_semantic", "best_fact", "extract_facts", "eval_summary",
    "transcript_clean", "rate_limit", "token_budget", "latency_hist", "usage_delta", "semantic_dedup", "stream_rate",
    "stream_admission", "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shelfmark.plans import catalog

    spark.read.parquet(f"{folder}/documents.parquet").count()  # JVM and file cache are warm
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:20s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
