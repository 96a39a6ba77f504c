"""Headline queries, timed once each after a warm-up; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fraudloom.catalog import all_queries
from fraudloom.session import build_session

HEADLINE = (
    "threshold_sweep", "partner_metrics", "roc_curve", "mean_roc_curve", "cv_partner_performance", "lift_report",
    "cost_matrix", "period_windows", "shared_attribute_edges", "bipartite_edges", "duplicated_filter",
    "geo_distance_features", "date_feature_bundle", "kv_expand", "match_scores_indel", "application_features",
    "woe_encode", "ordered_target_encode", "scale_robust", "window_features", "outlier_hbos", "outlier_knn",
    "outlier_iforest", "train_model", "stream_velocity",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["label_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
