"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` (default 8) over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1).
Each query is executed end to end into Spark's ``noop`` sink (full plan, nothing collected to the
driver): one warm-up run, then the median of ``$BENCH_REPEATS`` (default 3) timed runs.
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A3_product_rollup_orders",     # rating-scored line items -> product rollup
    "C4_rating_scorer",             # row-level scoring of every line item
    "A6_timeseries_day_all",        # daily series per team x product
    "A1_statistics",                # global statistics with distinct days
    "R3_alerts_events",             # fused alert aggregate + rules
    "R2_suggestions_all_rows",      # suggestions over every row
    "W1_top_comments",              # windowed top-N per product x polarity
    "W2_keywords",                  # tokenize whole texts, count, top-N
    "C5_lexicon_scorer",            # native lexicon scoring of whole texts
    "A16_class_metrics",            # confusion-matrix metrics
    "J1_top_products_timeseries",   # top-N semi join + series
    "BULK_import_product_summary",  # the reference's bulk import: ingest, score, store, summarise
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from feedlens.plans import all_queries
    from feedlens.session import clear_scratch, get_spark
    from feedlens.sources.fixtures import INPUT_PARTITIONS
    spark = get_spark(f"local[{cpus}]", app="feedlens-bench", shuffle_partitions=max(cpus, 8),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"), INPUT_PARTITIONS: str(cpus)})
    qs = all_queries()
    timings: dict[str, float] = {}
    only = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x]
    names = only or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t0
        clear_scratch(spark)
        return took
    for name in names:                                   # warm-up pass over every query first
        run(name)
    for name in names:
        timings[name] = round(statistics.median(run(name) for _ in range(repeats)), 4)
    # Scoring throughput, comparable with the reference's reviews/s (rows counted outside timing).
    throughput = {}
    for name in ("C4_rating_scorer", "C5_lexicon_scorer"):
        if name in timings and timings[name] > 0:
            rows = qs[name](spark, sf_dir).count()
            throughput[name] = round(rows / timings[name], 1)
    if "BULK_import_product_summary" in timings:          # reviews ingested = one per document
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        throughput["BULK_import_product_summary"] = round(docs / timings["BULK_import_product_summary"], 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall_sec", "value": round(sum(timings.values()), 4),
                      "unit": "sec", "queries": timings, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "repeats": repeats, "rows_per_sec": throughput}))


if __name__ == "__main__":
    main()
