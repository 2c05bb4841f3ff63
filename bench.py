"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated, optional).
Each query is timed once after a warm-up query; the noop sink computes every row and column.
"""

import json
import os
import time

from panelwright.plans import QUERIES
from panelwright.session import local_session

HEADLINE = [
    "a13_composites_to_monthly", "b20_key_identity", "c10_fold_scaler", "d01_bounded_ffill", "d04_history_windows", "d06_affected_by_invalid", "d16_allocate_days_to_months",
    "d20_ordered_decile", "e01_climatology", "e03_midrank_vs_history", "e08_analysis_master", "e08_eligibility_flags", "e14_empirical_rank", "g03_grouped_metrics",
    "g10_residual_diagnostics", "h03_paired_bootstrap", "h12_rank_bootstrap", "i02_global_importance", "i11_site_group_shares", "j02_shift_summary", "j04_kendall_tau_b",
    "j07_site_run_comparison", "j12_within_site_overlap", "k01_ridge_grid", "k06_cv_bootstrap_compare", "k10_contrast_bootstrap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["a02_require_columns"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
