"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewright.queries import QUERIES
from tidewright.session import local_session

HEADLINE = (
    "series_by_region", "quality_report", "feature_frame", "rolling", "rolling_mad", "decompose_p7", "seasonality_detect", "leaderboard",
    "residual_diagnostics", "structured_summary", "long_rolling", "long_rolling_mad", "long_quantiles", "ets_backtest", "arima_backtest", "gbt_backtest", "all_models_leaderboard",
)


def run(name: str, query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="12g", partitions=int(cpus))
    chosen = {name: QUERIES[name] for name in HEADLINE}
    try:
        from tidewright.llm.queries import QUERIES as corpus

        chosen |= corpus
    except ImportError:
        pass
    spark.range(1000).groupBy().count().collect()  # start-up is not a query's time
    times = {name: run(name, query, spark, sf_dir) for name, query in chosen.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
