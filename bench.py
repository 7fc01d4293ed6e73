"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. A warm-up, then the median of three runs."""

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ("bbox_range_join", "nearest_rows_topk", "locate_best", "locate_candidates", "chain_topology", "forward_fill", "unique_key_match", "length_order_stats", "findings_report", "locate_many_farms", "adaptive_range_join")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from solaraddr.plans.reports import QUERIES as known

    def run(name: str) -> float:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - began

    # one run warms up the JVM and the file cache; of the next three the median counts
    took = {}
    for name in QUERIES:
        run(name)
        took[name] = round(sorted(run(name) for _ in range(3))[1], 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
