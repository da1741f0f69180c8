"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then once timed, into a sink that only drains the
rows. Fits, that of the row pipeline too, run anew each time; nothing is cached between the runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lendlens.plans.catalog import QUERIES  # noqa: E402
from lendlens.session import build_session  # noqa: E402

HEADLINES = [
    "load_summary", "engineer_features_row", "engineer_features_customer", "customer_history",
    "risk_level_performance", "business_metrics", "correlation_matrix", "risk_variation",
    "stratified_split", "fit_ridge", "score_linear", "shadow_score", "roc_auc",
    "evaluate_comprehensive", "evaluate_business", "stream_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
