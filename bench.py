"""Benchmark of the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Each query is built and fully executed into the no-op sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from verdictframe.catalog import load_all
from verdictframe.catalog.base import run
from verdictframe.session import local_session

HEADLINE = (
    "met_08_fairness_bundle", "met_13_robustness", "met_14_severe_behavior", "unc_03_bootstrap_big", "unc_05_accuracy_drop_big",
    "gate_03_binary_verdict_big", "gate_06_robustness_verdict_big", "row_02_prepare_fairness", "gen_01_char_swap", "gen_07_flip_labels",
    "gen_12_manifest", "doc_08_documentation_verdict", "int_08_integrity_verdict", "int_09_artifact_status", "sco_05_bands_v4",
    "sco_12_score_or_withhold", "life_01_replay_status", "stu_10_correlations", "stu_16_audit_confusion", "agr_04_fleiss", "agr_06_kripp_interval",
    "agr_17_comparison_summary", "plan_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
