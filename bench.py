"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full to a no-op sink. The one-time table builds are
timed as entries of their own, so no query hides its input's cost.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crosstape.plans import REGISTRY, common  # noqa: E402
from crosstape.session import build_session  # noqa: E402

HEADLINE = (
    "daily_bars ema20 rsi14 relative_strength breadth50 chart_patterns size_bands band_scores candidates allocation decorrelated "
    "barrier_labels backtest_labels structural_exits rule_sweep breakout_edge_by_band feature_information paired_blocks weight_variants "
    "impact_sensitivity literature_variants latest_filing filing_features announcement_features visible_sessions document_tone "
    "company_mentions stock_sentiment position_state wallet quality_assertions position_stream"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("crosstape-bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        t = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    # Start the executors and the code generator before anything is timed.
    spark.range(1000).selectExpr("sum(id)").collect()
    timed("build_bars", lambda: common.bars(spark, sf_dir))
    timed("build_features", lambda: common.features(spark, sf_dir))
    timed("build_trades", lambda: common.trades(spark, sf_dir))
    for name in names:
        timed(name, lambda: REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
