"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""
import json
import os
import time

from barloom.plans.catalog import QUERIES
from barloom.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "trade_funnel", "resample_ticks", "cleaning_report", "asof_completed_bar", "atr_seed_mean_tr", "bollinger", "trade_summary", "bulk_breakdown",
    "equity_and_drawdown", "mae_mfe", "first_touch_exit", "trade_context", "search_threshold", "filter_sweep", "outcome_summary", "bootstrap_pvalue",
)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
