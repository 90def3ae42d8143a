"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEAT and BENCH_QUERIES set the run.

The rows that queries start from (listings, postings, rendered pages) are derived and written once beforehand; that time is
reported apart.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "report_vendor", "report_price_band", "report_value_ranking", "report_modality_location", "summary", "dedup_listings",
    "cap_per_term", "enrich_listings", "enrich_postings", "parse_posted_at", "clean_text_listing", "category_price_stats",
    "extract_containers", "extract_listings", "extract_postings",
)
PREPARED = ("raw_listings", "raw_postings", "listing_details", "posting_details", "listing_pages", "posting_pages", "result_pages")


def main() -> None:
    from checks import sample_tables
    from checks.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    started = time.time()
    sample_tables.prepare(spark, sf_dir, PREPARED, 2 * int(cpus))
    derivation = time.time() - started
    runs = {name: [] for name in names}
    for number in range(repeat + 1):  # the first round warms up and is not counted
        for name in names:
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if number or not repeat:
                runs[name].append(time.time() - started)
    seconds = {name: round(statistics.median(times), 3) for name, times in runs.items()}
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query seconds, warm session", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "repeat": repeat,
        "derivation_sec": round(derivation, 3),
        "spread": {name: [round(min(times), 3), round(max(times), 3)] for name, times in runs.items()},
    }))


if __name__ == "__main__":
    main()
