"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from ledgerloom import queries as base

HEADLINE = ["r5_bm25_topk", "r16_greedy_budget", "r14_rank_fusion", "m2_supersede_by_key", "r27_lineage", "jn8_anaphoric", "jn9_previous_holder", "ag1_delivery_ledger", "ag9_failure_runs", "ag14_percentiles", "wn8_turns", "jn10_shared_words", "x1_redaction", "m1_insert_or_ignore"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            base.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    prompts = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "prompts_per_sec": round(prompts / took["r5_bm25_topk"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
