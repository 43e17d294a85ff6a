"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query runs unmeasured first, so that none pays for the session's start. Each time is the median of
three runs; a query whose runs have taken REPEAT_S together is not run again.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthlake.catalog import registry  # noqa: E402
from hearthlake.session import build_session  # noqa: E402

HEADLINE = [
    "median_price_m2", "parse_price_text", "numeric_columns", "resolve_place", "extract_counts_from_prose",
    "extraction_precision", "dedup_first_wins", "dedup_key", "survivorship_merge", "dup_cluster_stats",
    "numeric_repair", "pending_antijoin", "amenity_edges", "amenity_matrix", "flag_or_fold", "one_hot",
    "feature_matrix", "exact_percentiles", "pearson_matrix_long", "redundant_pairs", "group_split",
    "regression_metrics", "ridge_fit", "html_fields", "sanitize_response", "token_estimate",
]


REPEAT_S = 15


def measure(run) -> float:
    times: list[float] = []
    while len(times) < 3 and sum(times) < REPEAT_S:
        start = time.time()
        run()
        times.append(time.time() - start)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()

    def run(name: str) -> None:
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("parse_price_text")
    times = {}
    for name in names:
        times[name] = measure(lambda: run(name))  # noqa: B023
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
