"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import spindrel.queries as Q

HEADLINE = ("or_bm25", "and_bm25", "not_query", "phrase_exact", "phrase_slop", "fuzzy_1", "prefix", "wildcard", "numeric_range", "date_range", "match_all_sort", "search_after_page", "facet_terms", "facet_range", "acl_filter", "total_hits", "project_fields", "suggest_complete", "suggest_correct", "analyze_standard", "upsert_latest")
WARM_RUNS = 5


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(f) -> float:
        start = time.perf_counter()
        f()
        return round(time.perf_counter() - start, 4)

    spark.range(10).count()
    for mapping in (Q.DOCUMENTS, Q.PARTS, Q.ORDERS):
        times[f"build_{mapping.name}"] = clock(lambda m=mapping: Q.index(spark, sf_dir, m))
    for name in HEADLINE:
        run = lambda n=name: Q.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[f"{name}_cold"] = clock(run)
        times[name] = statistics.median(clock(run) for _ in range(WARM_RUNS))
    total = round(sum(times[n] for n in HEADLINE), 4)
    print(json.dumps({"metric": "sum of warm medians of headline queries", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
