"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from tallyfield.registry import QUERIES
from tallyfield.session import build_session, clear_work

HEADLINE = (
    "h1_subscription_history",
    "h2_activity_timeline",
    "h3_ranking_load",
    "h4_score_panel",
    "h5_score_change",
    "h8_monthly_panel",
    "h9_size_segments",
    "h12_daily_segment_content",
    "h19_regression_impact",
    "h19_sampled_impact",
    "h20_gompertz_fits",
    "h21_usage_ratio",
    "c6_fuzzy_join",
    "c7_fuzzy_join_distance",
    "d7_table_profile",
    "e2_ledger_running_total",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            # The tables are small: keep partitions of this size apart, so that all cores have work.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
