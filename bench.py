"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, all headline queries by default).
"""

from __future__ import annotations

import json
import os
import time

from sparkprep.queries import QUERIES
from sparkprep.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "q01_dq_score",
    "q05_outlier_counts",
    "q06_metrics_bundle",
    "q09_infer_schema",
    "q11_impute_missing",
    "q15_dedup",
    "q16_dedup_keep_first",
    "q18_outlier_impute",
    "q19_outlier_drop_sequential",
    "q20_outlier_drop_simultaneous",
    "q21_rename_merge_split",
    "q25_plan_scores",
    "q28_apply_full_plan",
    "q29_before_after",
    "q30_sample_hash_topk",
    "q34_std_dates",
    "q41_json_roundtrip",
    "q45_value_containment",
    "q46_infer_logic",
    "q48_run_reports",
    "q50_stream_windowed_quality",
    "q57_full_run",
    "v05_films",
    "v07_ecommerce",
]


def run(spark, name: str) -> float:
    """Seconds to build the query and produce every row of its result."""
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/nation.parquet").count()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    seconds = {name: round(run(spark, name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries, first run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
