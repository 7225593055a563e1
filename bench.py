"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query
runs once to warm up and once timed; a timed run evaluates every output column.
"""

from __future__ import annotations

import json
import os
import time

from areapanel.catalog import QUERIES
from areapanel.session import build_session

HEADLINE = [
    "persistence_baseline", "create_label", "yearly_threshold", "ingest_incidents", "load_points_incidents",
    "multi_pivot_panel", "crime_panel", "violation_panel", "spatial_join", "join_bases", "group_mean_features",
    "crime_base", "acs_base", "education_shares", "describe_stats", "median_by_column", "boxplot_stats", "corr_matrix",
    "pct_rank", "top_decile", "times_in_top_decile", "quantile_bins", "process_features", "process_splits",
    "temporal_splits", "metrics_grid", "roc_auc", "pr_curve", "bias_crosstab", "leaderboard", "knn_score", "train_logistic",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = run(name)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
