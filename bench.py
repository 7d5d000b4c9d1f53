"""Times the named queries: one JSON line on stdout.

``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local threads), ``BENCH_QUERIES`` (comma-separated keys),
``BENCH_SHARED_DIR`` (staged tables; a new local folder by default).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from wardline.catalog import QUERIES
from wardline.session import build_session

HEADLINE = [
    "stay_history", "join_left_dimension", "join_left_fanout_map", "join_left_normalized_key", "union_all_by_name",
    "default_code_label", "join_left_from_pivot", "join_right_embeddings", "agg_count_pivot", "agg_mean_vector",
    "win_admission_no", "win_days_since_discharge", "win_dense_code_index", "normalize_unknown", "bin_rare_categories",
    "one_hot_encode", "stratified_group_split", "join_semi_split", "join_anti_split", "agg_describe", "agg_median",
    "agg_boxplot_stats", "agg_histogram", "agg_welch_ttest", "differential_codes", "build_sequences", "pad_sequences",
    "lag_features", "impute_median", "standardize", "target_encode", "row_to_text", "metric_roc_auc",
    "metric_regression", "subgroup_classification", "subgroup_regression", "threshold_sweep", "fit_mortality_gbt",
    "fit_los_gbt", "permutation_importance_auc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or HEADLINE
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the workers
    times = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)
    }))
    spark.stop()


if __name__ == "__main__":
    main()
