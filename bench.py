"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (cores), BENCH_RUNS (timed
runs per query, the best one counts; one warm-up run precedes them).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans.registry import all_queries  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = [
    "read_parquet_count",
    "missing_pct",
    "nunique",
    "numeric_summary",
    "categorical_top10",
    "profile_lineitem",
    "profile_events",
    "histogram",
    "box_stats",
    "events_per_day",
    "top_k_categories",
    "vertical_stack",
    "hjoin_inner",
    "hjoin_outer",
    "hjoin_outer_null_keys",
    "dedupe_first",
    "keep_frequent_values",
    "impute_median",
    "iqr_clip",
    "type_casts",
    "expand_datetime_lineitem",
    "mask_pii_documents",
    "apply_cleaning_plan",
    "corr_with_target",
    "stratified_split",
    "fold_counts",
    "scale_numeric",
    "onehot_rare",
    "encode_label",
    "metric_f1_macro",
    "metric_roc_auc_lineitem",
    "metric_regression",
    "best_run",
    "metric_summary",
    "question_coverage",
    "cleaning_plan",
    "knn_predict_embeddings",
    "train_linreg",
    "train_rf_cls",
]


def run(query, spark, folder: str) -> float:
    """Seconds to compute every row of a query without sending the rows anywhere."""
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__sql__files__maxPartitionBytes="2m",
        spark__sql__files__openCostInBytes="64k",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in HEADLINE:
        run(queries[name], spark, folder)
        seconds[name] = round(min(run(queries[name], spark, folder) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds (warm)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
