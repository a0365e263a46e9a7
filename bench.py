"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyrisk import build_session  # noqa: E402
from tallyrisk.catalog import QUERIES, SQL  # noqa: E402

# Each has a SQL statement of the same result; together they cover every operator family.
HEADLINE = [
    "ops_summary",
    "ops_alerts",
    "latency_rank_percentile",
    "monitoring_run",
    "log_valid_rows",
    "safe_ratios",
    "rowwise_stats",
    "validate_split",
    "installment_measures",
    "payload_hash",
    "agg_numeric_all",
    "agg_map_driven",
    "agg_stat_vocab",
    "agg_two_level",
    "agg_status_slices",
    "group_stats_broadcast",
    "win_transform_sum",
    "win_last_k",
    "win_trend_slope",
    "join_left_child_aggs",
    "join_distinct_pairs",
    "onehot_low_card",
    "factorize",
    "impute_auto",
    "standardize",
    "threshold_optimal",
    "roc_auc",
    "cv_fold_metrics",
    "score_to_log",
    "drift_ks",
    "feat_application",
    "feat_bureau",
    "feat_previous",
    "feat_pos",
    "feat_installments",
    "feat_credit_card",
    "client_features",
    "stream_ops_windows",
]


def run(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if wanted == ["all"]:
        wanted = list(SQL)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("FATAL")
    run(QUERIES["ops_summary"](spark, sf_dir))  # start-up of the JVM and the Python side is not timed
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
