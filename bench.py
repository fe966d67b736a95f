"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tapeloom import catalog
from tapeloom.session import local_session

HEADLINE = [
    "bar01_resample", "bar08_session_closes", "jn02_monthly_to_daily", "feat01_returns", "feat10_envelope", "feat12_macd", "feat22_volume_profile",
    "rank01_cross_section", "rank03_decile_bins", "lbl06_direction", "lbl08_spec_labels", "ev02_decile_audit", "ev07_classification",
    "sig13_deoverlap", "sig17_vol_target", "wf03_session_folds", "pf03_alpha", "pf05_risk_summary", "bar16_panel", "reg06_regime_table", "pf11_weighted_equity", "str01_stream_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # session warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
