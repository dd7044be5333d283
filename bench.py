"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import all_queries
from tidewatch.session import local_session

HEADLINE = [
    "monthly_feature_table",
    "feature_one_to_many",
    "feature_z_score_sum_trx",
    "feature_cnt_trx_n_day",
    "feature_sum_rapid_movement",
    "feature_many_small_trx",
    "counterparty_explanations",
    "counterparty_concentration",
    "monthly_customer_insights",
    "activity_trace",
    "distribution_profile",
    "account_nodes",
    "scored_activities",
    "built_alerts",
    "feature_stability",
    "trigger_feature_drift",
    "monthly_alert_percentage",
    "name_matches",
    "scored_account_pairs",
    "resolved_parties",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    times: dict[str, float] = {}
    for name in wanted:
        spent = []
        for i in range(runs + 1):  # the first run warms up
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                spent.append(time.time() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(spent), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
